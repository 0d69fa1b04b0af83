"""Tables kept by key and by crawl: page and picture state, crawl history."""

from __future__ import annotations

import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.operators import history, state

CRAWLS = "id long, site_key string, crawl_started_at string, crawl_ended_at string, total_pages long, mode string"
PAGES = "crawl_id long, url string, title string, content_hash string, depth long"


class KeyedTable:
    """State as numbered Parquet versions; the highest complete one counts, so readers never see half a write."""

    def __init__(self, spark: SparkSession, path: str, schema: str = state.PAGE):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs()
        if not fs.exists(p):
            return []
        names = [f.getPath() for f in fs.listStatus(p)]
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n.getName()[1:]) for n in names if n.getName().startswith("v") and fs.exists(make(n, "_SUCCESS")))

    def read(self) -> DataFrame:
        found = self.versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{found[-1]}") if found else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame) -> int:
        number = (self.versions() or [0])[-1] + 1
        names = [f.split()[0] for f in self.schema.split(", ")]
        rows.select(*names).write.mode("overwrite").parquet(f"{self.path}/v{number}")
        return number

    def upsert(self, delta: DataFrame) -> int:
        """Replace the rows of ``delta``'s keys; costs a rewrite of the table."""
        return self.write(state.upsert(self.read(), delta.select(*[f.split()[0] for f in self.schema.split(", ")])))

    def compact(self) -> int:
        """Delete all versions but the newest; returns how many."""
        fs, _ = self._fs()
        old = self.versions()[:-1]
        for v in old:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}"), True)
        return len(old)

    def wipe(self) -> None:
        fs, p = self._fs()
        fs.delete(p, True)


class History:
    """Crawls and their pages; pages are written first and the crawl's row last, which makes the crawl visible."""

    def __init__(self, spark: SparkSession, path: str, keep: int = history.KEEP):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._crawls = KeyedTable(spark, f"{self.path}/crawls", CRAWLS)

    def crawls(self) -> DataFrame:
        return self._crawls.read()

    def pages(self) -> DataFrame:
        ids = [r["id"] for r in self.crawls().select("id").collect()]
        if not ids:
            return self.spark.createDataFrame([], PAGES)
        # partition folders of crawls that are visible; at most ``keep`` per site
        found = self.spark.read.schema(PAGES).option("basePath", f"{self.path}/pages").parquet(*[f"{self.path}/pages/crawl_id={i}" for i in ids])
        return found.select("crawl_id", "url", "title", "content_hash", "depth")

    def record(self, site_key: str, started: str, ended: str, mode: str, pages: DataFrame) -> int:
        """Store a crawl's pages (url, title, content_hash, depth) and prune the site's old crawls."""
        if not site_key or not mode:
            raise ValueError("site_key and mode are required")
        crawls = self.crawls()
        number = (crawls.agg(F.max("id")).first()[0] or 0) + 1
        rows = pages.select("url", "title", "content_hash", F.col("depth").cast("long").alias("depth"))
        rows.write.mode("overwrite").parquet(f"{self.path}/pages/crawl_id={number}")
        total = self.spark.read.parquet(f"{self.path}/pages/crawl_id={number}").count()
        new = self.spark.createDataFrame([(number, site_key, started, ended, total, mode)], CRAWLS)
        everything = crawls.unionByName(new)
        kept = history.retained(everything, self.keep) if self.keep > 0 else everything
        before = {r["id"] for r in crawls.select("id").collect()}
        self._crawls.write(kept)
        gone = before - {r["id"] for r in self.crawls().select("id").collect()}
        fs, _ = self._crawls._fs()
        for i in gone:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pages/crawl_id={i}"), True)
        return number


def clean_below(base: str, target: str) -> None:
    """Delete a local output folder, but only strictly below its base."""
    b, t = Path(base).resolve(), Path(target).resolve()
    if b == t or b not in t.parents:
        raise ValueError(f"{t} is not below {b}")
    shutil.rmtree(t, ignore_errors=True)
