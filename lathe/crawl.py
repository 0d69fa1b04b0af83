"""A whole crawl of one site: expansion, extraction, conversion, records, state and history."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.control import now_text
from lathe.functions import urls
from lathe.operators import frontier, pagetree, records, state
from lathe.sources import config, jsonl, robots
from lathe.sources.keyed import History, KeyedTable
from lathe.storage import materialise

#: From a frontier (url, depth) to (url, final_url, html, error_type); a missing page has a null html.
Fetch = Callable[[DataFrame], DataFrame]


def offline_fetch(pages: DataFrame, *ties: str) -> Fetch:
    """Serve pages (url, html) of a stored corpus by their normalized URLs; of equals, what has HTML, then the least (url, ``ties``) wins."""
    place = F.struct(F.col("html").isNull().alias("bare"), "url", *ties)
    known = pages.groupBy(urls.normalize(F.col("url")).alias("_n")).agg(F.min_by("html", place).alias("html"), F.min(place)["url"].alias("final_url"))

    def fetch(level: DataFrame) -> DataFrame:
        joined = level.join(known, level["url"] == known["_n"], "left")
        return joined.select("url", F.coalesce("final_url", "url").alias("final_url"), "html", F.when(F.col("html").isNull(), "HTTP_404").alias("error_type"))

    return fetch


@dataclass
class Outcome:
    pages: DataFrame
    records: DataFrame
    state: DataFrame
    saved: int


def crawl(spark: SparkSession, site_key: str, site: config.Site, app: config.App, fetch: Fetch, table: KeyedTable | None = None, store: History | None = None, rules: DataFrame | None = None, sitemap_pages: DataFrame | None = None, resume: bool = False, incremental: bool = False, start: DataFrame | None = None) -> Outcome:
    """Crawl a site level by level.

    Each level: pages due by their stored state; depth and robots policy; fetch;
    scope after redirects; one parse per page, written once; unchanged regions
    leave an incremental run before links and Markdown; links give the next
    level.  Failures become state rows with a category.
    """
    resume = resume or incremental
    config.validate_site(site)
    settings = config.resolve(site, app)
    domain, prefix = site.allowed_domain, site.allowed_path_prefix
    out_dir = config.output_dir(app.output_base_dir, site_key) if app.output_base_dir else site_key
    started = now_text()
    if table is not None and not resume:
        table.wipe()
    old = table.read() if table is not None else spark.createDataFrame([], state.PAGE)
    level = frontier.seeds(site.start_urls if start is None else start, spark, domain, prefix)
    if resume:
        level = level.unionByName(state.requeue(old, incremental))
    if sitemap_pages is not None:
        level = level.unionByName(sitemap_pages)
    level = materialise(level.groupBy("url").agg(F.min("depth").alias("depth")), "level")
    facts = pagetree.facts_udf(site.content_selector, site.link_extraction_selectors)
    to_markdown = pagetree.markdown_udf(domain, prefix, out_dir)
    seen = level.select("url")
    done: list[DataFrame] = []
    detected: DataFrame | None = None
    # what a resumed crawl knew before is not discovered anew
    before = old.select("url") if resume else None
    while not level.isEmpty():
        due = state.to_process(level, old, incremental).select("url", "depth")
        judged = frontier.fetchable(due, site.max_depth)
        if rules is not None:
            judged = robots.check(judged, rules, settings["user_agent"]).withColumn("error_type", F.when(F.col("error_type").isNull() & ~F.col("robots_ok"), "Policy_Robots").otherwise(F.col("error_type"))).drop("robots_ok")
        stopped = judged.filter("error_type IS NOT NULL")
        got = fetch(judged.filter("error_type IS NULL").select("url", "depth")).join(judged.select("url", "depth"), "url")
        size = F.octet_length("html")
        late = F.when(F.col("error_type").isNotNull(), F.col("error_type")).when(~urls.in_scope(F.col("final_url"), domain, prefix, site.disallowed_path_patterns), "Policy_Scope").when(size > settings["max_page_size_bytes"], "Network_BodyRead")
        got = got.withColumn("error_type", late).withColumn("html", F.when(F.col("error_type").isNull(), F.col("html")))
        if site.content_selector in pagetree.AUTO:
            got = materialise(got, "fetched")
            fresh = pagetree.detect(got.filter("html IS NOT NULL").select(F.col("final_url").alias("url"), "depth", "html"))
            if detected is not None:  # a host keeps its first result
                fresh = fresh.join(detected.select("host"), "host", "left_anti").unionByName(detected)
            detected = materialise(fresh, "frameworks")
            names = detected.select("host", "framework")
            got = got.withColumn("host", urls.hostname(F.col("final_url"))).join(names, "host", "left").drop("host")
        else:
            got = got.withColumn("framework", F.lit(None).cast("string"))
        read = got.withColumn("_f", F.when(F.col("html").isNotNull(), facts("html", "framework"))).select(
            "url", "final_url", "depth", F.coalesce("error_type", "_f.error_type").alias("error_type"), F.col("_f.title").alias("title"), F.col("_f.content_html").alias("content_html"), F.col("_f.region_hash").alias("region_hash"), F.col("_f.anchors").alias("anchors"),
        )
        empty = [F.lit(None).cast(t).alias(n) for n, t in read.dtypes if n not in ("url", "depth", "error_type")]
        whole = materialise(read.unionByName(stopped.select("url", "depth", "error_type", *empty)), "parsed")
        fine = whole.filter("error_type IS NULL")
        if incremental:
            fine = state.changed_only(fine, old)
        done.append(whole.filter("error_type IS NOT NULL").unionByName(fine))
        links = frontier.out_links(fine.select(F.col("final_url").alias("url"), "anchors"), domain, prefix, site.disallowed_path_patterns, site.respect_nofollow)
        from_depth = fine.select(F.col("final_url").alias("src"), "depth")
        following = links.join(from_depth, "src").groupBy(F.col("dst").alias("url")).agg((F.min("depth") + 1).alias("depth"))
        if site.max_depth > 0:
            following = following.filter(F.col("depth") <= site.max_depth)
        following = following.join(seen, "url", "left_anti")
        if before is not None:
            following = following.join(before, "url", "left_anti")
        level = materialise(following, "level")
        seen = seen.union(level.select("url"))
    everything = done[0]
    for d in done[1:]:
        everything = everything.unionByName(d)
    ended = now_text()
    body = everything.filter("error_type IS NULL").withColumn("content", to_markdown("content_html", "final_url"))
    pages = materialise(body.select(F.col("final_url").alias("url"), "title", "content", F.lit(ended).alias("crawled_at"), "depth", "region_hash", F.col("url").alias("key")), "converted")
    rows = records.page_records(pages)
    delta = everything.select(
        "url", F.when(F.col("error_type").isNull(), "success").otherwise("failure").alias("status"), "error_type", F.when(F.col("error_type").isNull(), F.lit(ended)).alias("processed_at"),
        F.lit(ended).alias("last_attempt"), "depth", F.when(F.col("error_type").isNull(), F.col("region_hash")).alias("content_hash"),
    )
    new_state = state.upsert(old, delta)
    if table is not None:
        table.upsert(delta)
        new_state = table.read()
    kept = rows.withColumn("seq", F.lit(1).cast("long"))
    path = f"{out_dir}/{settings['jsonl_output_filename']}"
    if resume and app.output_base_dir and os.path.exists(path):
        kept = jsonl.read_pages(spark, path).withColumn("seq", F.lit(0).cast("long")).unionByName(kept)
    # two requests may end at one URL: the later record wins, the greater key among equals
    compact = materialise(records.last_wins(kept, "url", "seq").drop("seq"), "records")
    saved = rows.count()
    if app.output_base_dir:
        os.makedirs(out_dir, exist_ok=True)
        final = records.finalized(compact.withColumn("seq", F.lit(0)), records.meta(compact, site_key, domain, started, ended))
        jsonl.export_file(records.json_lines(final), path)
        jsonl.export_file(records.manifest(compact, site_key, domain), f"{out_dir}/llms.txt")
        jsonl.export_file(records.full_manifest(compact, site_key, domain), f"{out_dir}/llms-full.txt")
    if store is not None:
        store.record(site_key, started, ended, config.mode(resume, incremental), compact.select("url", "title", "content_hash", "depth"))
    return Outcome(pages, compact, new_state, saved)
