"""Connected components of an edge table, by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.storage import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the least node of its part.

    Each round is a small number of aggregations over the edges; the number of
    rounds grows with the logarithm of the longest path.  Hubs do not gather
    into one row: minima are aggregated and joined back.
    """
    now = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while True:
        # large star: every larger neighbour of a node goes to the least of its neighbourhood
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        # small star: a node and its smaller neighbours go to the least of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).filter("x <> y").union(low.select(F.col("m").alias("x"), F.col("b").alias("y"))).distinct()
        new = materialise(small.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "edges")
        # a star forest: every b has one a, and no a is a b
        loose = new.groupBy("b").count().filter("count > 1").select("b").union(new.select("a").join(new.select(F.col("b").alias("a")), "a", "left_semi").select("a")).limit(1).count()
        discard(now)
        now = new
        if not loose:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
