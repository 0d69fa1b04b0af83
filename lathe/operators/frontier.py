"""Breadth-first expansion over links with a visited set, level by level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.functions import urls
from lathe.storage import discard, materialise


class NoSeeds(ValueError):
    """No start URL lies within the site's scope."""


def seeds(start: list[str] | DataFrame, spark, domain: str, prefix: str = "/") -> DataFrame:
    """(url, depth 0) of the start URLs (a list, or a table with ``url``) in scope, normalized; raises if none is."""
    rows = start.select("url") if isinstance(start, DataFrame) else spark.createDataFrame([(u,) for u in dict.fromkeys(start)], "url string")
    kept = rows.filter(urls.in_scope(F.col("url"), domain, prefix)).select(urls.normalize(F.col("url")).alias("url"), F.lit(0).cast("long").alias("depth")).distinct()
    if kept.isEmpty():
        raise NoSeeds(f"no start URL on {domain} below {prefix}")
    return kept


def out_links(pages: DataFrame, domain, prefix: str = "/", disallowed: list[str] = (), nofollow: bool = False, native: bool = False) -> DataFrame:
    """Distinct (src, dst) of pages (url, anchors): resolved, in scope, no resources, normalized.

    Filters stand before the normalization; ``native`` keeps to hrefs that begin
    with a slash and avoids the Python resolver.
    """
    a = pages.select("url", F.explode("anchors").alias("_a")).select(F.col("url").alias("src"), F.col("_a.href").alias("href"), F.col("_a.rel").alias("rel")).filter("href <> ''")
    if nofollow:
        a = a.filter(~urls.is_nofollow(F.col("rel")))
    target = urls.resolve_rooted(F.col("src"), F.col("href")) if native else urls.resolve(F.col("src"), F.col("href"))
    found = a.withColumn("_t", target).filter(F.col("_t").isNotNull() & ~urls.is_resource(F.col("_t")) & urls.in_scope(F.col("_t"), domain, prefix, disallowed))
    return found.select("src", urls.normalize(F.col("_t")).alias("dst")).filter("dst IS NOT NULL").distinct()


def expand(start: DataFrame, links: Callable[[DataFrame, int], DataFrame], max_depth: int = 0) -> DataFrame:
    """(url, depth) of everything reachable from ``start``; depth is the least number of links.

    ``links`` gives (src, dst) for a frontier.  Each level is one join of the
    frontier with the edges, an anti-join with the visited set and a written
    table, so the plan stays short however deep the graph is, and a lost
    executor costs one level.  ``max_depth`` bounds discovery, ends included.
    """
    frontier = materialise(start.groupBy("url").agg(F.min("depth").cast("long").alias("depth")), "frontier")
    levels, depth = [frontier], 0
    seen = frontier.select("url")
    while max_depth <= 0 or depth < max_depth:
        depth += 1
        found = links(frontier, depth - 1).select(F.col("dst").alias("url")).distinct()
        frontier = materialise(found.join(seen, "url", "left_anti").select("url", F.lit(depth).cast("long").alias("depth")), "frontier")
        if frontier.isEmpty():
            discard(frontier)
            break
        levels.append(frontier)
        seen = seen.union(frontier.select("url"))
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def expand_edges(start: DataFrame, edges: DataFrame, max_depth: int = 0) -> DataFrame:
    """``expand`` over a table of edges (src, dst)."""
    return expand(start, lambda frontier, _: edges.join(frontier.select(F.col("url").alias("src")), "src", "left_semi"), max_depth)


def fetchable(found: DataFrame, max_depth: int = 0) -> DataFrame:
    """Discovered pages with their verdict: what lies at the greatest depth is recorded but not fetched."""
    over = (F.col("depth") >= max_depth) if max_depth > 0 else F.lit(False)
    return found.withColumn("error_type", F.when(over, "Policy_MaxDepth"))
