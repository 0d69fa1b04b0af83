"""JSON-lines corpora: page rows, meta rows, single-file export."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lathe.operators import records


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.trim("value") != "")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page rows; other kinds and malformed lines are left out.

    A cheap text test keeps other lines from the JSON reader.  Lines may be of any length.
    """
    rows = _lines(spark, path).filter(F.contains("value", F.lit('"page"'))).select(F.from_json("value", records.FIELDS + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("_r"))
    return rows.filter("_r.record_type = 'page' AND _r._bad IS NULL").select("_r.*").drop("_bad")


def read_page_keys(spark: SparkSession, path: str) -> DataFrame:
    """(url, title, content_hash, depth) for the history, without the bodies."""
    return read_pages(spark, path).select("url", "title", "content_hash", "depth")


def last_meta(spark: SparkSession, path: str) -> DataFrame:
    """The last meta row that can be read."""
    rows = _lines(spark, path).filter(F.contains("value", F.lit('"crawl_meta"'))).withColumn("_at", F.monotonically_increasing_id())
    parsed = rows.select("_at", F.from_json("value", records.META).alias("_r")).filter("_r.record_type = 'crawl_meta'")
    return parsed.orderBy(F.col("_at").desc()).limit(1).select("_r.*")


def append(rows: DataFrame, path: str) -> None:
    records.json_lines(rows).write.mode("append").text(path)


def count_pages(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).filter(F.contains("value", F.lit('"record_type":"page"'))).count()


def sequenced(rows: DataFrame) -> DataFrame:
    """Rows with their order of arrival (partition, then place)."""
    return rows.withColumn("seq", F.monotonically_increasing_id())


def write_final(rows: DataFrame, path: str) -> None:
    """Finalized rows as a folder of text parts whose names keep the order."""
    records.json_lines(rows).write.mode("overwrite").text(path)


def export_file(ordered: DataFrame, file: str) -> int:
    """One local text file from an ordered table with column ``value`` or ``line``, renamed into place when complete.

    Rows stream through the driver a partition at a time.
    """
    column = next(c for c in ("value", "line", "section") if c in ordered.columns)
    end = "" if column == "section" else "\n"
    n = 0
    with open(file + ".tmp", "w", encoding="utf-8") as out:
        for row in ordered.select(column).toLocalIterator():
            out.write(row[0] + end)
            n += 1
    os.replace(file + ".tmp", file)
    return n


def last_per_url(rows: DataFrame) -> DataFrame:
    """Window form of ``records.last_wins``."""
    order = Window.partitionBy("url").orderBy(F.col("seq").desc())
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
