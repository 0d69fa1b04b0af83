"""Tables in which URLs come several times: the queries give DuckDB's rows."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lathe.operators import pagetree

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """The pages of sf0.001 and, with other ids and texts, most of them again, in the order of the ids."""
    folder = str(tmp_path_factory.mktemp("repeats"))
    p = spark.read.parquet(f"{SF}/pages.parquet")
    top = p.agg(F.max("page_id")).first()[0] + 1
    again = [p.filter(f"page_id % 11 <> {k}").select((F.col("page_id") + k * top).alias("page_id"), "url", F.replace("html", F.lit("<title>"), F.lit(f"<title>{mark} "))) for k, mark in ((1, "z"), (2, "A"))]
    rows = [tuple(r) for r in p.union(again[0]).union(again[1]).orderBy("page_id").collect()]
    spark.createDataFrame(rows, p.schema).coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return folder


def both(spark, folder, name):
    """Rows of the query and of its SQL; one thread, so that DuckDB meets rows in the table's order."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    df = entry.queries()[name](spark, folder)
    found = con.execute(entry.oracle_sql()[name])
    at = [[c[0] for c in found.description].index(c) for c in df.columns]
    return Counter(map(tuple, df.collect())), Counter(tuple(r[i] for i in at) for r in found.fetchall())


def test_sitemap_counters(spark, repeated):
    got, want = both(spark, repeated, "a08_sitemap_counters")
    assert got == want


def test_detection_by_the_first_of_equal_urls(spark, repeated):
    got, want = both(spark, repeated, "j07_detection_lookup")
    assert got == want


def test_detection_by_a_page_that_has_html(spark):
    rows = [("http://h/a", None, 1), ("http://h/b", "<div class=rst-content>", 3), ("http://h/b", "<div class=md-main>", 2), ("http://g/", None, 4)]
    found = pagetree.detect(spark.createDataFrame(rows, "url string, html string, page_id long"), "page_id")
    assert {r["host"]: r["framework"] for r in found.collect()} == {"h": "mkdocs", "g": None}


def test_tree_sets(spark, repeated):
    got, want = both(spark, repeated, "u03_tree_sets")
    assert got == want


@pytest.mark.parametrize("name", ["w06_first_page", "s04_crawl_site"])
def test_first_of_equal_urls(spark, repeated, name):
    got, want = both(spark, repeated, name)
    assert got == want
