"""Queries over page trees; SQL twins where the tables' plain markup allows one."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.functions import text, urls
from lathe.operators import pagetree
from lathe.plans import derived as d
from lathe.plans.registry import register



@register("x15_x16_x21_content_region")
def content_region(spark, sf_dir):
    """Title, region hash and counts of every page: one parse each."""
    facts = pagetree.facts_udf("article, main, body")
    rows = d.pages(spark, sf_dir).select("page_id", facts("html", F.lit(None).cast("string")).alias("f"))
    return rows.select("page_id", "f.title", "f.region_hash", "f.error_type", F.size("f.anchors").cast("long").alias("anchors"), F.size("f.pictures").cast("long").alias("pictures"))


@register("x14_tree_title", f"SELECT page_id, {d.s_unescape(d.s_title('html'))} AS title FROM pages")
def tree_title(spark, sf_dir):
    facts = pagetree.facts_udf("body")
    return d.pages(spark, sf_dir).select("page_id", facts("html", F.lit(None).cast("string"))["title"].alias("title"))


@register("x17_x18_framework")
def frameworks(spark, sf_dir):
    return d.pages(spark, sf_dir).select("page_id", pagetree.framework("html").alias("framework"))


@register("x19_readability")
def readability(spark, sf_dir):
    """Content regions found without a selector."""
    facts = pagetree.facts_udf("auto")
    return d.pages(spark, sf_dir).select("page_id", facts("html", F.lit(None).cast("string")).alias("f")).select("page_id", "f.region_hash", "f.error_type")


@register("x07_x20_markdown")
def to_markdown(spark, sf_dir):
    """Markdown of every page's article with hash, headings and links."""
    facts, convert = pagetree.facts_udf("article, body"), pagetree.markdown_udf("www.ththin.example.com", "/", "out")
    rows = d.pages(spark, sf_dir).select("page_id", "url", facts("html", F.lit(None).cast("string"))["content_html"].alias("content_html")).withColumn("content", convert("content_html", "url"))
    c = F.col("content")
    return rows.select("page_id", "content", text.content_hash(c).alias("content_hash"), text.headings(c).alias("headings"), text.links(c).alias("links"))


_H1 = d.s_unescape("regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '[ \\t\\r\\n]+', ' ', 'g')")


@register("x20_heading_of_article", f"SELECT page_id, trim(regexp_replace({_H1}, '([\\\\`*_\\[\\]])', '\\\\\\1', 'g')) AS heading FROM pages")
def heading_of_article(spark, sf_dir):
    """The first heading of the article's Markdown, with what Markdown would take for markup escaped."""
    facts, convert = pagetree.facts_udf("article"), pagetree.markdown_udf("x", "/", "out")
    rows = d.pages(spark, sf_dir).select("page_id", convert(facts("html", F.lit(None).cast("string"))["content_html"], F.col("url")).alias("content"))
    return rows.select("page_id", F.element_at(text.headings(F.col("content")), 1).alias("heading"))


_ONE_SITE = f"{d.s_normalize("'https://all.example.com/' || " + d.s_host('url') + " || " + d.s_path('url'))}"


@register("s04_crawl_site", f"SELECT url, arg_min({d.s_unescape(d.s_title('html'))}, raw) AS title, 0::BIGINT AS depth FROM (SELECT {_ONE_SITE} AS url, 'https://all.example.com/' || {d.s_host('url')} || {d.s_path('url')} AS raw, html FROM pages) GROUP BY url")
def crawl_site(spark, sf_dir):
    """A whole crawl of all stored pages, brought together below one host: its records; of equal URLs the least id is served."""
    from lathe import crawl
    from lathe.sources import config

    p = d.pages(spark, sf_dir).withColumn("url", F.concat(F.lit("https://all.example.com/"), urls.hostname(F.col("url")), urls.path(F.col("url"))))
    site = config.Site(start_urls=["https://all.example.com/"], allowed_domain="all.example.com", content_selector="article, body")
    done = crawl.crawl(spark, "site", site, config.App(), crawl.offline_fetch(p, "page_id"), start=p.select("url"))
    return done.records.select(urls.normalize(F.col("url")).alias("url"), "title", "depth")
