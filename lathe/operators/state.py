"""Keyed state of pages and pictures: lookups, insert-if-absent, upserts, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = "url string, status string, error_type string, processed_at string, last_attempt string, depth long, content_hash string"


def with_status(pages: DataFrame, state: DataFrame, absent: str = "not_found", blank: str = "pending") -> DataFrame:
    """Pages with their stored status: ``absent`` without a row, ``blank`` for an empty one."""
    known = state.select("url", F.coalesce(F.nullif("status", F.lit("")), F.lit(blank)).alias("status"), F.col("content_hash").alias("stored_hash"))
    return pages.join(known, "url", "left").withColumn("status", F.coalesce("status", F.lit(absent)))


def stored_hash(status: Column, content_hash: Column) -> Column:
    """The hash that counts for skipping: of successes, if there is one."""
    return F.when((status == "success") & (content_hash != ""), content_hash)


def to_process(pages: DataFrame, state: DataFrame, incremental: bool) -> DataFrame:
    """Pages that are due: all but earlier successes, which only an incremental run looks at again."""
    looked = with_status(pages, state)
    return looked if incremental else looked.filter("status <> 'success'")


def changed_only(pages: DataFrame, state: DataFrame) -> DataFrame:
    """Pages (url, region_hash) whose content region differs from the stored hash."""
    known = state.select("url", stored_hash(F.col("status"), F.col("content_hash")).alias("_stored")).filter("_stored IS NOT NULL")
    return pages.join(known, "url", "left").filter(~F.coalesce(F.col("_stored") == F.col("region_hash"), F.lit(False))).drop("_stored")


def unseen(candidates: DataFrame, state: DataFrame) -> DataFrame:
    """Insert-if-absent: candidates (url, depth) without a row yet, at their least depth."""
    return candidates.groupBy("url").agg(F.min("depth").alias("depth")).join(state.select("url"), "url", "left_anti")


def upsert(state: DataFrame, delta: DataFrame) -> DataFrame:
    """State with the rows of ``delta`` in place of the old ones; one writer per batch, so no conflicts."""
    return state.join(delta.select("url"), "url", "left_anti").unionByName(delta)


def requeue(state: DataFrame, include_success: bool) -> DataFrame:
    """(url, depth) to take up again: failures, pending and empty rows; empty ones at depth 0."""
    status = F.coalesce("status", F.lit(""))
    wanted = status.isin("failure", "pending", "") | (F.lit(include_success) & (status == "success"))
    return state.filter(wanted).select("url", F.when(status == "", 0).otherwise(F.coalesce("depth", F.lit(0))).cast("long").alias("depth"))


def requeue_tally(state: DataFrame, include_success: bool) -> DataFrame:
    known = ("failure", "pending", "", "success")
    return state.agg(F.count_if(F.coalesce("status", F.lit("")).isin(*(known if include_success else known[:3]))).alias("requeued"), F.count_if(~F.coalesce("status", F.lit("")).isin(*known)).alias("errors"))


def status_tally(state: DataFrame) -> DataFrame:
    return state.groupBy("status", "error_type").agg(F.count("*").alias("n"))


def visited_count(pages: DataFrame, pictures: DataFrame) -> DataFrame:
    return pages.select("url").unionAll(pictures.select("url")).agg(F.count("*").alias("visited"))
