"""Sitemaps: indexes and URL sets."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions import urls
from lathe.storage import materialise

LONGEST = 10_000_000
PARSED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("locs", T.ArrayType(T.StringType()))])


def parse_text(body: str | None) -> tuple[str, list[str]]:
    """('index' | 'urlset' | 'error', locations); names are taken without their namespaces."""
    if body is None or len(body.encode("utf-8", "surrogatepass")) > LONGEST or "<!ENTITY" in body:
        return "error", []
    try:
        root = ET.fromstring(body.strip().encode("utf-8", "surrogatepass"))
    except ET.ParseError:
        return "error", []
    plain = lambda tag: tag.rpartition("}")[2]
    kind = {"sitemapindex": "index", "urlset": "urlset"}.get(plain(root.tag), "error")
    locs = [(x.text or "").strip() for entry in root if plain(entry.tag) in ("sitemap", "url") for x in entry if plain(x.tag) == "loc"]
    return kind, [x for x in locs if x] if kind != "error" else []


@F.pandas_udf(PARSED)
def parsed(body: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_text(b) for b in body], columns=["kind", "locs"])


def expand(start: DataFrame, bodies: DataFrame) -> DataFrame:
    """(loc) of all pages below the sitemaps ``start`` (url); ``bodies`` (url, body) holds what was fetched.

    Every sitemap is parsed once; indexes are followed level by level until
    nothing new turns up.
    """
    known = materialise(bodies.select("url", parsed("body").alias("_p")).select("url", "_p.kind", "_p.locs"), "sitemaps")
    frontier = materialise(start.select("url").distinct(), "sitemap-level")
    levels, seen = [frontier], frontier
    while True:
        below = known.filter("kind = 'index'").join(frontier, "url", "left_semi").select(F.explode("locs").alias("url")).distinct()
        frontier = materialise(below.join(seen, "url", "left_anti"), "sitemap-level")
        if frontier.isEmpty():
            break
        levels.append(frontier)
        seen = seen.union(frontier)
    return known.filter("kind = 'urlset'").join(seen, "url", "left_semi").select(F.explode("locs").alias("loc"))


def pages(locs: DataFrame, domain: str, prefix: str = "/", disallowed: list[str] = ()) -> DataFrame:
    """(url, depth 1) of the locations in scope, normalized.  Resource extensions are not looked at here."""
    kept = locs.filter(urls.in_scope(F.col("loc"), domain, prefix, disallowed)).select(urls.normalize(F.col("loc")).alias("url"))
    return kept.filter("url IS NOT NULL").distinct().withColumn("depth", F.lit(1).cast("long"))


def tally(locs: DataFrame, state: DataFrame, domain: str, prefix: str = "/") -> DataFrame:
    """How many locations are new and how many are not; each counts once, however many state rows it has."""
    known = pages(locs, domain, prefix).join(state.select("url").distinct().withColumn("_known", F.lit(True)), "url", "left")
    return known.agg(F.count_if(F.col("_known").isNull()).alias("queued"), F.count_if(F.col("_known").isNotNull()).alias("known"))
