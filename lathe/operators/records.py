"""Page records: last-wins compaction, meta row, manifests, Markdown files as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.functions import text, urls

FIELDS = "record_type string, url string, title string, content string, headings array<string>, links array<string>, images array<string>, content_hash string, crawled_at string, depth long"
META = "record_type string, site_key string, allowed_domain string, crawl_started_at string, crawl_ended_at string, total_pages long"


def page_records(pages: DataFrame) -> DataFrame:
    """Record rows from (url, title, content, crawled_at, depth); pages without a body (null content) have none."""
    c = F.col("content")
    return pages.filter(c.isNotNull()).select(
        F.lit("page").alias("record_type"), "url", "title", "content", text.headings(c).alias("headings"), text.links(c).alias("links"), text.pictures(c).alias("images"),
        text.content_hash(c).alias("content_hash"), F.col("crawled_at").cast("string").alias("crawled_at"), F.col("depth").cast("long").alias("depth"),
    )


def last_wins(rows: DataFrame, key: str = "url", sequence: str = "seq") -> DataFrame:
    """The row of greatest sequence per key; the greatest row among equals.

    One aggregation that combines on the map side, so a key's rows travel once.
    """
    others = [c for c in rows.columns if c not in (key, sequence)]
    best = rows.groupBy(key).agg(F.max(F.struct(sequence, *others)).alias("_row"))
    return best.select(*[key if c == key else F.col(f"_row.`{c}`").alias(c) for c in rows.columns])


def meta(records: DataFrame, site_key: str, domain: str, started: str, ended: str) -> DataFrame:
    """One row: how many distinct pages, and the stamps."""
    return records.agg(F.count_distinct("url").alias("total_pages")).select(
        F.lit("crawl_meta").alias("record_type"), F.lit(site_key).alias("site_key"), F.lit(domain).alias("allowed_domain"), F.lit(started).alias("crawl_started_at"), F.lit(ended).alias("crawl_ended_at"), F.col("total_pages").cast("long").alias("total_pages"),
    )


def finalized(records: DataFrame, meta_row: DataFrame, sequence: str = "seq") -> DataFrame:
    """Compacted records in the order of their URLs, then the meta row."""
    kept = last_wins(records, "url", sequence).drop(sequence)
    both = kept.withColumn("_last", F.lit(0)).unionByName(meta_row.withColumn("_last", F.lit(1)), allowMissingColumns=True)
    return both.orderBy("_last", "url").drop("_last")


def json_lines(rows: DataFrame) -> DataFrame:
    """Rows as JSON text, null fields of the row's own kind kept, the other kind's left out."""
    names = lambda schema: [f.split()[0] for f in schema.split(", ")]
    build = lambda schema: F.to_json(F.struct(*[n for n in names(schema) if n in rows.columns]), {"ignoreNullFields": "false"})
    return rows.select(F.when(F.col("record_type") == "page", build(FIELDS)).otherwise(build(META)).alias("value"))


def manifest(records: DataFrame, site_key: str, domain: str) -> DataFrame:
    """(place, line) of the short manifest, in order."""
    bullets = records.select("url", F.concat(F.lit("- ["), text.escape_link_text(text.title_or_url(F.col("title"), F.col("url"))), F.lit("]("), F.col("url"), F.lit(")")).alias("line"))
    total = records.agg(F.count("*").alias("n"))
    head = total.select(F.posexplode(F.array(F.lit(f"# {site_key}"), F.lit(""), F.concat(F.lit(f"> Crawled documentation from {domain}. "), F.col("n").cast("string"), F.lit(" pages.")), F.lit(""), F.lit("## Pages"), F.when(F.col("n") == 0, "_No pages were successfully crawled._"))).alias("part", "line"))
    head = head.filter("line IS NOT NULL").select("part", F.lit("").alias("url"), "line")
    return head.unionByName(bullets.select(F.lit(9).alias("part"), "url", "line")).orderBy("part", "url").select("part", "url", "line")


def full_manifest(records: DataFrame, site_key: str, domain: str) -> DataFrame:
    """(part, url, section) of the manifest with the contents, in order."""
    head = records.sparkSession.createDataFrame([(0, "", f"# {site_key}\n\n> Full crawled content from {domain}.\n\n")], "part int, url string, section string")
    t = text.escape_heading(text.title_or_url(F.col("title"), F.col("url")))
    body = records.select(F.lit(1).alias("part"), "url", F.concat(F.lit("---\n\n# "), t, F.lit("\n\nURL: "), F.col("url"), F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n\n")).alias("section"))
    return head.unionByName(body).orderBy("part", "url")


def frontmatter(title: Column, url: Column, crawled_at: Column, content_hash: Column, depth: Column) -> Column:
    """YAML head of a Markdown file; plain scalars, quoted by the rules of ``text.yaml_scalar``."""
    quoted = F.when(content_hash == "", '""').otherwise(content_hash)
    return F.concat(F.lit("---\ntitle: "), text.yaml_scalar(title), F.lit("\nurl: "), url, F.lit("\ncrawled_at: "), crawled_at, F.lit("\ncontent_hash: "), quoted, F.lit("\ndepth: "), depth.cast("string"), F.lit("\n---\n\n"))


def markdown_files(records: DataFrame, domain: str, prefix: str, root: str) -> DataFrame:
    """(path, text) of the Markdown tree; pages out of scope have no file."""
    path = urls.output_path(F.col("url"), domain, prefix, root)
    head = frontmatter(F.col("title"), F.col("url"), F.col("crawled_at"), F.col("content_hash"), F.col("depth"))
    return records.select(path.alias("path"), F.concat(head, F.col("content")).alias("text")).filter("path IS NOT NULL")


def listing(records: DataFrame, limit: int = 0, offset: int = 0) -> DataFrame:
    """A page of the list of pages: lengths in bytes, ordered by URL."""
    n, o = clamp(limit, offset)
    rows = records.select("url", "title", "depth", "crawled_at", F.octet_length("content").cast("long").alias("content_length"))
    return rows.orderBy("url").offset(o).limit(n)


def clamp(limit: int, offset: int) -> tuple[int, int]:
    """Page sizes: 100 by default, 1000 at most."""
    return (100 if limit <= 0 else min(limit, 1000)), max(offset, 0)


def newest(rows: DataFrame, keep: int, by: str, order: list[Column]) -> DataFrame:
    """The first ``keep`` rows of every ``by`` in ``order``; a rank filter that Spark cuts before the shuffle as well."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_n") <= keep).drop("_n")
