"""Crawl history: latest and as-of crawl, difference of two crawls, retention, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathe.operators import records

KEEP = 10


def latest(crawls: DataFrame) -> DataFrame:
    """The crawl of greatest id of every site."""
    return records.last_wins(crawls, "site_key", "id")


def as_of(crawls: DataFrame, cutoff: str) -> DataFrame:
    """Of every site the newest crawl that ended at or before ``cutoff``.

    Ends are compared as texts: a crawl that ended within the second of a
    whole-second cutoff counts as ended by then, as '.' sorts before 'Z'.
    """
    others = [c for c in crawls.columns if c != "site_key"]
    best = crawls.filter(F.col("crawl_ended_at") <= cutoff).groupBy("site_key").agg(F.max_by(F.struct(*others), F.struct("crawl_ended_at", "id")).alias("_row"))
    return best.select("site_key", *[F.col(f"_row.{c}").alias(c) for c in others])


def as_of_each(requests: DataFrame, crawls: DataFrame) -> DataFrame:
    """As-of join: (site_key, since) with the id of the newest crawl that ended by then, null if none did.

    One sorted pass per site: both sides are stacked and the last id seen is
    carried on, instead of joining every request with every crawl.
    """
    a = crawls.select("site_key", F.col("crawl_ended_at").alias("_t"), F.lit(0).alias("_kind"), F.col("id").alias("_id"), F.lit(None).cast("string").alias("since"))
    b = requests.select("site_key", F.col("since").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_id"), "since")
    order = Window.partitionBy("site_key").orderBy("_t", "_kind", "_id").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("crawl_id", F.last("_id", ignorenulls=True).over(order)).filter("_kind = 1").select("site_key", "since", "crawl_id")


def difference(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(kind, url, title, content_hash, prior_hash, depth) by a full outer join on the URL.

    Unchanged pages are listed too; ``entries`` drops and ``tally`` counts them.
    """
    cols = ["title", "content_hash", "depth"]
    c = current.select("url", F.lit(True).alias("_now"), *[F.col(x).alias(f"_c_{x}") for x in cols])
    b = baseline.select("url", F.lit(True).alias("_then"), *[F.col(x).alias(f"_b_{x}") for x in cols])
    gone = F.col("_now").isNull()
    kind = F.when(gone, "removed").when(F.col("_then").isNull(), "added").when(F.col("_c_content_hash").eqNullSafe(F.col("_b_content_hash")), "unchanged").otherwise("changed")
    pick = lambda x: F.when(gone, F.col(f"_b_{x}")).otherwise(F.col(f"_c_{x}"))
    both = c.join(b, "url", "full_outer").withColumn("kind", kind)
    return both.select("kind", "url", *[pick(x).alias(x) for x in cols], F.when(F.col("kind") == "changed", F.col("_b_content_hash")).otherwise("").alias("prior_hash"))


def entries(found: DataFrame, limit: int = 0, offset: int = 0) -> DataFrame:
    """A page of the difference without unchanged rows, by kind and URL."""
    n, o = records.clamp(limit, offset)
    return found.filter("kind <> 'unchanged'").orderBy("kind", "url").offset(o).limit(n)


def tally(found: DataFrame) -> DataFrame:
    return found.agg(F.count_if(F.col("kind") == "unchanged").alias("unchanged"), F.count_if(F.col("kind") != "unchanged").alias("total"))


def pages_of(history: DataFrame, crawl: DataFrame) -> DataFrame:
    """Pages of the crawls in ``crawl`` (id): one row per site, so Spark broadcasts it and prunes by crawl_id."""
    return history.join(crawl.select(F.col("id").alias("crawl_id")), "crawl_id", "left_semi")


def crawl_difference(crawls: DataFrame, history: DataFrame, site_key: str, since: str) -> DataFrame:
    """Difference of a site's latest crawl and its crawl as of ``since``; empty if either is missing or both are one."""
    own = crawls.filter(F.col("site_key") == site_key)
    now, then = latest(own), as_of(own, since)
    pair = now.select("site_key", F.col("id").alias("now_id")).join(then.select("site_key", F.col("id").alias("then_id")), "site_key").filter("now_id <> then_id")
    return difference(pages_of(history, pair.select(F.col("now_id").alias("id"))), pages_of(history, pair.select(F.col("then_id").alias("id"))))


def retained(crawls: DataFrame, keep: int = KEEP) -> DataFrame:
    """The newest ``keep`` crawls of every site."""
    return records.newest(crawls, keep, "site_key", [F.col("id").desc()])


def cascade(history: DataFrame, kept: DataFrame) -> DataFrame:
    """Page rows of the crawls that are kept."""
    return history.join(kept.select(F.col("id").alias("crawl_id")), "crawl_id", "left_semi")


def freshness(crawls: DataFrame, now: str) -> DataFrame:
    """Age in whole seconds of every site's latest crawl."""
    age = F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp(F.to_timestamp("crawl_ended_at"))
    return latest(crawls).select("site_key", "id", "crawl_ended_at", age.cast("long").alias("age_seconds"))
