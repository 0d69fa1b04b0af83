"""Queries over state, history, frontier, records and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lathe.functions import durations, text, urls
from lathe.operators import frontier, history, politeness, records, state
from lathe.plans import derived as d
from lathe.plans.registry import register
from lathe.sources import sitemaps
from lathe.tables import table

def U():
    return F.col("url")



@register("q00_crawl_corpus", f"""
WITH scoped AS (
  SELECT page_id, {d.s_normalize('url')} AS url, {d.s_title('html')} AS title, sha256(html) AS content_hash FROM pages
  WHERE {d.s_scheme('url')} IN ('http', 'https') AND {d.s_host('url')} LIKE '%.example.%' AND {d.s_path('url')} LIKE '/%')
SELECT url, title, content_hash, page_id FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id DESC) AS n FROM scoped) WHERE n = 1""")
def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized, scoped pages, the last of equal URLs, with title and hash, in the order of their URLs."""
    p = d.pages(spark, sf_dir)
    scoped = p.filter(urls.scheme(U()).isin("http", "https") & urls.hostname(U()).contains(".example.") & urls.path(U()).startswith("/"))
    rows = scoped.select("page_id", urls.normalize(U()).alias("url"), text.simple_title(F.col("html")).alias("title"), text.sha256(F.col("html")).alias("content_hash"))
    return records.last_wins(rows, "url", "page_id").orderBy("url").select("url", "title", "content_hash", "page_id")


# --- scans over state and history


@register("s02_s03_seed_scan", f"""
SELECT DISTINCT {d.s_normalize('url')} AS url, 0::BIGINT AS depth FROM pages
WHERE {d.s_scheme('url')} IN ('http', 'https') AND {d.s_host('url')} LIKE 'blog.%' AND {d.s_path('url')} LIKE '/en/%'
  AND {d.s_normalize('url')} NOT IN (SELECT {d.s_normalize('url')} FROM pages WHERE page_id % 9 = 0)""")
def seed_scan(spark, sf_dir):
    p = d.pages(spark, sf_dir)
    kept = p.filter(urls.in_scope(U(), urls.hostname(U()), "/en/") & urls.hostname(U()).startswith("blog."))
    seen = p.filter("page_id % 9 = 0").select(urls.normalize(U()).alias("url"))
    return state.unseen(kept.select(urls.normalize(U()).alias("url"), F.lit(0).cast("long").alias("depth")), seen)


@register("s08_body_cap", "SELECT page_id, strlen(html)::BIGINT AS n_bytes, CASE WHEN strlen(html) > 4000 THEN 'Network_BodyRead' END AS error_type FROM pages")
def body_cap(spark, sf_dir):
    n = F.octet_length("html").cast("long")
    return d.pages(spark, sf_dir).select("page_id", n.alias("n_bytes"), F.when(n > 4000, "Network_BodyRead").alias("error_type"))


@register("s13_jsonl_scan", f"SELECT url, {d.s_title('html')} AS title, sha256(html) AS content_hash, (page_id % 4)::BIGINT AS depth FROM pages WHERE page_id % 10 <> 0")
def jsonl_scan(spark, sf_dir):
    """Rows written as JSON lines and read again; every tenth line is of another kind or broken."""
    p = d.pages(spark, sf_dir)
    kind = F.when(F.col("page_id") % 20 == 0, "crawl_meta").otherwise("page")
    line = F.to_json(F.struct(kind.alias("record_type"), "url", text.simple_title(F.col("html")).alias("title"), text.sha256(F.col("html")).alias("content_hash"), (F.col("page_id") % 4).alias("depth")))
    lines = p.select(F.when(F.col("page_id") % 20 == 10, F.substring(line, 1, 30)).otherwise(line).alias("value"))
    rows = lines.select(F.from_json("value", records.FIELDS + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("_r"))
    return rows.filter("_r.record_type = 'page' AND _r._bad IS NULL").select("_r.url", "_r.title", "_r.content_hash", "_r.depth")


@register("s15_page_status", f"WITH {d.S_STATE} SELECT p.url, coalesce(s.status, 'not_found') AS status FROM pages p LEFT JOIN state s USING (url)")
def page_status(spark, sf_dir):
    return state.with_status(d.pages(spark, sf_dir).select("url"), d.page_state(spark, sf_dir)).select("url", "status")


@register("s16_image_status", f"WITH {d.S_STATE} SELECT a.url, a.href, coalesce(CASE WHEN s.status = 'pending' THEN 'not_found' ELSE s.status END, 'not_found') AS status FROM (SELECT DISTINCT url, href FROM ({'WITH ' + d.S_ANCHORS} SELECT * FROM anchors)) a LEFT JOIN state s USING (url)")
def image_status(spark, sf_dir):
    """Pictures (here: link targets) by the state of their key; empty entries count as not found."""
    known = d.page_state(spark, sf_dir).withColumn("status", F.when(F.col("status") == "pending", "").otherwise(F.col("status")))
    return state.with_status(d.anchors(spark, sf_dir).select("url", "href").distinct(), known, blank="not_found").select("url", "href", "status")


@register("s17_stored_hash", f"WITH {d.S_STATE} SELECT url, CASE WHEN status = 'success' AND content_hash <> '' THEN content_hash END AS stored_hash FROM state")
def stored_hash(spark, sf_dir):
    return d.page_state(spark, sf_dir).select("url", state.stored_hash(F.col("status"), F.col("content_hash")).alias("stored_hash"))


@register("s18_requeue", f"WITH {d.S_STATE} SELECT url, depth FROM state WHERE status IN ('failure', 'pending', '')")
def requeue(spark, sf_dir):
    return state.requeue(d.page_state(spark, sf_dir), False)


@register("s18_requeue_incremental", f"WITH {d.S_STATE} SELECT url, depth FROM state")
def requeue_incremental(spark, sf_dir):
    return state.requeue(d.page_state(spark, sf_dir), True)


@register("s19_visited_count", f"WITH {d.S_STATE} SELECT (SELECT count(*) FROM state) + (SELECT count(*) FROM pages WHERE page_id % 3 = 0) AS visited")
def visited_count(spark, sf_dir):
    return state.visited_count(d.page_state(spark, sf_dir), d.pages(spark, sf_dir).filter("page_id % 3 = 0"))


@register("s20_pages_of_crawl", f"WITH {d.S_HISTORY} SELECT url, title, content_hash, depth FROM history WHERE crawl_id = 5")
def pages_of_crawl(spark, sf_dir):
    return d.page_history(spark, sf_dir).filter("crawl_id = 5").select("url", "title", "content_hash", "depth")


@register("s21_last_crawled", f"WITH {d.S_CRAWLS} SELECT site_key, max(crawl_ended_at) AS last_crawled FROM crawls GROUP BY site_key")
def last_crawled(spark, sf_dir):
    return history.latest(d.crawls(spark, sf_dir)).select("site_key", F.col("crawl_ended_at").alias("last_crawled"))


@register("s22_jobs_after_restart", f"WITH {d.S_JOBS} SELECT id, site_key, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status FROM jobs")
def jobs_after_restart(spark, sf_dir):
    return d.jobs(spark, sf_dir).select("id", "site_key", F.when(F.col("status") == "running", "failed").otherwise(F.col("status")).alias("status"))


# --- sinks as rows


@register("k02_finalize", f"""
WITH {d.S_STREAM}, kept AS (SELECT url, title FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq DESC) AS n FROM stream) WHERE n = 1)
SELECT 'page' AS record_type, url, title, NULL AS site_key, NULL::BIGINT AS total_pages FROM kept
UNION ALL SELECT 'crawl_meta', NULL, NULL, 'site', count(*) FROM kept""")
def finalize(spark, sf_dir):
    rows = d.record_stream(spark, sf_dir).withColumn("record_type", F.lit("page"))
    meta = records.meta(rows, "site", "example", "a", "b").select("record_type", "site_key", "total_pages")
    return records.finalized(rows, meta).select("record_type", "url", "title", "site_key", "total_pages")


@register("k05_manifest", f"""
WITH rows AS (SELECT url, {d.s_title('html')} AS title FROM pages)
SELECT 0::INTEGER AS part, '' AS url, '# site' AS line UNION ALL SELECT 1, '', '' UNION ALL SELECT 2, '', '> Crawled documentation from example.com. ' || (SELECT count(*) FROM rows)::VARCHAR || ' pages.'
UNION ALL SELECT 3, '', '' UNION ALL SELECT 4, '', '## Pages'
UNION ALL SELECT 9, url, '- [' || replace(replace(replace(replace(title, chr(92), chr(92) || chr(92)), '[', chr(92) || '['), ']', chr(92) || ']'), chr(10), ' ') || '](' || url || ')' FROM rows""")
def manifest(spark, sf_dir):
    return records.manifest(d.pages(spark, sf_dir).select("url", text.simple_title(F.col("html")).alias("title")), "site", "example.com")


@register("k06_full_manifest", f"""
WITH {d.S_MARKDOWN} SELECT 0::INTEGER AS part, '' AS url, '# site' || chr(10) || chr(10) || '> Full crawled content from example.com.' || chr(10) || chr(10) AS section
UNION ALL SELECT 1, url, '---' || chr(10) || chr(10) || '# ' || replace({d.s_title('p.html')}, chr(10), ' ') || chr(10) || chr(10) || 'URL: ' || url || chr(10) || chr(10) || content || chr(10) || chr(10) FROM md JOIN pages p USING (url)""")
def full_manifest(spark, sf_dir):
    rows = d.markdown(spark, sf_dir).join(d.pages(spark, sf_dir).select("url", text.simple_title(F.col("html")).alias("title")), "url")
    return records.full_manifest(rows, "site", "example.com")


@register("k07_markdown_tree")
def markdown_tree(spark, sf_dir):
    """Files (path, text) of all pages; YAML quoting has no SQL twin."""
    rows = d.markdown(spark, sf_dir).join(d.pages(spark, sf_dir).select("url", "html"), "url")
    rows = rows.select("url", text.simple_title(F.col("html")).alias("title"), "content", F.lit("2024-01-01T00:00:00Z").alias("crawled_at"), text.content_hash(F.col("content")).alias("content_hash"), F.lit(0).alias("depth"))
    head = records.frontmatter(F.col("title"), U(), F.col("crawled_at"), F.col("content_hash"), F.col("depth"))
    return rows.select(F.concat(urls.hostname(U()), F.lit(":"), urls.path(U())).alias("path"), F.concat(head, F.col("content")).alias("text"))


@register("k10_state_upsert", f"""
WITH {d.S_STATE}, delta AS (SELECT url, 'success' AS status, NULL::VARCHAR AS error_type, 7::BIGINT AS depth, sha256(url) AS content_hash FROM pages WHERE page_id % 3 = 0)
SELECT * FROM delta UNION ALL SELECT url, status, error_type, depth, content_hash FROM state WHERE url NOT IN (SELECT url FROM delta)""")
def state_upsert(spark, sf_dir):
    delta = d.pages(spark, sf_dir).filter("page_id % 3 = 0").select("url", F.lit("success").alias("status"), F.lit(None).cast("string").alias("error_type"), F.lit(7).cast("long").alias("depth"), text.sha256(U()).alias("content_hash"))
    return state.upsert(d.page_state(spark, sf_dir), delta)


@register("k11_history_insert", f"WITH {d.S_HISTORY} SELECT crawl_id, count(*) AS total_pages, count(DISTINCT url) AS urls FROM history GROUP BY crawl_id UNION ALL SELECT 10, count(*), count(DISTINCT url) FROM pages")
def history_insert(spark, sf_dir):
    new = d.pages(spark, sf_dir).select(F.lit(10).cast("long").alias("crawl_id"), "url")
    return d.page_history(spark, sf_dir).select("crawl_id", "url").unionByName(new).groupBy("crawl_id").agg(F.count("*").alias("total_pages"), F.count_distinct("url").alias("urls"))


# --- joins

S_CANDIDATES = f"""cand AS (SELECT DISTINCT {d.s_scheme('url')} || '://' || {d.s_authority('url')} || {d.s_encode('href')} AS url FROM anchors)"""


def _candidates(spark, sf_dir):
    return d.anchors(spark, sf_dir).select(urls.resolve_rooted(U(), F.col("href")).alias("url"), F.lit(1).cast("long").alias("depth"))


@register("j01_unseen_links", f"WITH {d.S_ANCHORS}, {S_CANDIDATES} SELECT url, 1::BIGINT AS depth FROM cand WHERE url NOT IN (SELECT {d.s_normalize('url')} FROM pages)")
def unseen_links(spark, sf_dir):
    return state.unseen(_candidates(spark, sf_dir), d.pages(spark, sf_dir).select(urls.normalize(U()).alias("url")))


S_DIFF = """d AS (
  SELECT CASE WHEN c.url IS NULL THEN 'removed' WHEN b.url IS NULL THEN 'added' WHEN c.content_hash = b.content_hash THEN 'unchanged' ELSE 'changed' END AS kind, coalesce(c.url, b.url) AS url,
    CASE WHEN c.url IS NULL THEN b.title ELSE c.title END AS title, CASE WHEN c.url IS NULL THEN b.content_hash ELSE c.content_hash END AS content_hash, CASE WHEN c.url IS NULL THEN b.depth ELSE c.depth END AS depth,
    CASE WHEN c.url IS NOT NULL AND b.url IS NOT NULL AND c.content_hash <> b.content_hash THEN b.content_hash ELSE '' END AS prior_hash
  FROM (SELECT * FROM history WHERE crawl_id = {now}) c FULL JOIN (SELECT * FROM history WHERE crawl_id = {then}) b ON c.url = b.url)"""


@register("j02_crawl_diff", f"WITH {d.S_HISTORY}, {S_DIFF.format(now=8, then=5)} SELECT * FROM d WHERE kind <> 'unchanged'")
def crawl_diff(spark, sf_dir):
    """Site net: its latest crawl against the one as of 2024-02-01T10:00:00Z."""
    return history.crawl_difference(d.crawls(spark, sf_dir), d.page_history(spark, sf_dir), "net", d.SINCE).filter("kind <> 'unchanged'").orderBy("kind", "url")


@register("j02_crawl_diff_subsecond", f"WITH {d.S_HISTORY}, {S_DIFF.format(now=7, then=4)} SELECT * FROM d WHERE kind <> 'unchanged'")
def crawl_diff_subsecond(spark, sf_dir):
    """Site com: the baseline ended half a second after the cutoff, which counts as by then."""
    return history.crawl_difference(d.crawls(spark, sf_dir), d.page_history(spark, sf_dir), "com", d.SINCE).filter("kind <> 'unchanged'").orderBy("kind", "url")


@register("j03_f08_resume_lookup", f"WITH {d.S_STATE} SELECT p.url, coalesce(s.status, 'not_found') AS status FROM pages p LEFT JOIN state s USING (url) WHERE coalesce(s.status, 'not_found') <> 'success'")
def resume_lookup(spark, sf_dir):
    return state.to_process(d.pages(spark, sf_dir).select("url"), d.page_state(spark, sf_dir), False).select("url", "status")


@register("j03_f09_incremental_skip", f"WITH {d.S_STATE} SELECT p.url, sha256(p.html) AS region_hash FROM pages p LEFT JOIN state s ON s.url = p.url AND s.status = 'success' WHERE s.content_hash IS NULL OR s.content_hash <> sha256(p.html)")
def incremental_skip(spark, sf_dir):
    return state.changed_only(d.pages(spark, sf_dir).select("url", text.sha256(F.col("html")).alias("region_hash")), d.page_state(spark, sf_dir))


@register("j04_picture_lookup", f"WITH {d.S_ANCHORS} SELECT a.page_id, a.href, CASE WHEN length(a.href) % 3 = 0 THEN 'images/' || substr(sha256(a.href), 1, 8) END AS local_path FROM anchors a")
def picture_lookup(spark, sf_dir):
    a = d.anchors(spark, sf_dir)
    known = a.filter(F.length("href") % 3 == 0).select("href").distinct().withColumn("local_path", F.concat(F.lit("images/"), F.substring(text.sha256(F.col("href")), 1, 8)))
    return a.join(known, "href", "left").select("page_id", "href", "local_path")


REQUESTS = "SELECT site_key, since FROM (SELECT DISTINCT site_key FROM crawls) CROSS JOIN (VALUES ('2023-12-31T00:00:00Z'), ('2024-01-01T10:00:00Z'), ('2024-02-02T00:30:00Z'), ('2025-01-01T00:00:00Z')) t(since)"


@register("j05_as_of_join", f"WITH {d.S_CRAWLS}, r AS ({REQUESTS}) SELECT r.site_key, r.since, (SELECT c.id FROM crawls c WHERE c.site_key = r.site_key AND c.crawl_ended_at <= r.since ORDER BY c.crawl_ended_at DESC, c.id DESC LIMIT 1) AS crawl_id FROM r")
def as_of_join(spark, sf_dir):
    c = d.crawls(spark, sf_dir)
    since = spark.createDataFrame([("2023-12-31T00:00:00Z",), ("2024-01-01T10:00:00Z",), ("2024-02-02T00:30:00Z",), ("2025-01-01T00:00:00Z",)], "since string")
    return history.as_of_each(c.select("site_key").distinct().crossJoin(F.broadcast(since)), c)


@register("j06_robots_lookup", f"SELECT url, CASE WHEN {d.s_path('url')} LIKE '/de/%' AND {d.s_path('url')} NOT LIKE '/de/1%' THEN FALSE ELSE TRUE END AS robots_ok FROM pages")
def robots_lookup(spark, sf_dir):
    from lathe.sources import robots

    p = d.pages(spark, sf_dir).select("url")
    body = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /de/\nAllow: /de/1\nSitemap: /map.xml\n"
    rules = p.select(F.lower(urls.authority(U())).alias("host")).distinct().withColumn("body", F.lit(body))
    return robots.check(p, rules, "lathe").select("url", "robots_ok")


#: What stands at the beginning of a body: marks of the five frameworks by attribute, class, script and text, and none.
MARKS = [
    '<div data-docusaurus="1">', '<p class="x theme-doc-markdown">', '<main data-md-component="m">', '<div class="md-main">', '<div class="rst-content">', '<script src="/rtd.js"></script>', '<p class="sphinxsidebar">',
    '<script src="/a/searchindex.js"></script>', '<p>Created using Sphinx</p>', '<div class="gitbook-root">', '<div class="markdown-section">', '<p>hosted on readthedocs.io</p>', '<p class="not-md-main">', "", "", "",
]


def _framework_sql(html: str) -> str:
    """The marks of ``pagetree.FRAMEWORKS``, as text of the page's source."""
    from lathe.operators.pagetree import FRAMEWORKS

    cases = []
    for name, attributes, classes, scripts, parts, _ in FRAMEWORKS:
        found = [f"regexp_matches({html}, '<[^>]*[ ]{a}[ =>]')" for a in attributes]
        found += [f"""regexp_matches({html}, 'class="([^"]*[ ])?{c.removesuffix("*")}{'' if c.endswith("*") else '[ "]'}')""" for c in classes]
        found += [f"""regexp_matches({html}, '<script[^>]*src="[^"]*{x.replace(".", "[.]")}')""" for x in scripts]
        found += [f"contains(lower({html}), '{x}')" for x in parts]
        cases.append(f"WHEN {' OR '.join(found)} THEN '{name}'")
    return f"CASE {' '.join(cases)} ELSE 'fallback' END"


@register("j07_detection_lookup", f"""
WITH marked AS (SELECT url, replace(html, '<body>', '<body>' || [{', '.join("'" + m + "'" for m in MARKS)}][page_id % {len(MARKS)} + 1]) AS html FROM pages),
first AS (SELECT {d.s_host('url')} AS host, arg_min(html, url) AS html FROM marked GROUP BY 1)
SELECT p.url, {_framework_sql('f.html')} AS framework FROM pages p JOIN first f ON f.host = {d.s_host('p.url')}""")
def detection_lookup(spark, sf_dir):
    """Framework of every page's host, decided by the host's first page, of equal URLs by the least id; the pages bear one of ``MARKS`` each."""
    from lathe.operators import pagetree

    mark = F.array(*map(F.lit, MARKS))[(F.col("page_id") % len(MARKS)).cast("int")]
    p = d.pages(spark, sf_dir).withColumn("html", F.replace("html", F.lit("<body>"), F.concat(F.lit("<body>"), mark)))
    found = pagetree.detect(p, "page_id")
    return p.select("url", urls.hostname(U()).alias("host")).join(found, "host").select("url", F.coalesce("framework", F.lit("fallback")).alias("framework"))


@register("j08_tree_compare", """
WITH l AS (SELECT url AS path, strlen(html)::BIGINT AS size, sha256(html) AS h FROM pages WHERE page_id % 7 <> 0),
r AS (SELECT url AS path, strlen(html || CASE WHEN page_id % 5 = 0 THEN 'x' ELSE '' END)::BIGINT AS size, sha256(CASE WHEN page_id % 5 = 0 THEN html || 'x' WHEN page_id % 6 = 0 THEN reverse(html) ELSE html END) AS h FROM pages WHERE page_id % 4 <> 0)
SELECT coalesce(l.path, r.path) AS path, CASE WHEN r.path IS NULL THEN 'only_left' WHEN l.path IS NULL THEN 'only_right' WHEN l.size <> r.size THEN 'size' WHEN l.h <> r.h THEN 'content' ELSE 'same' END AS verdict, l.size AS left_size, r.size AS right_size
FROM l FULL JOIN r ON l.path = r.path""")
def tree_compare(spark, sf_dir):
    from lathe.operators import trees

    p, n = d.pages(spark, sf_dir), F.col("page_id")
    rows = lambda html, keep: p.filter(keep).select(U().alias("path"), F.octet_length(html).cast("long").alias("size"), F.encode(html, "UTF-8").alias("content"))
    h = F.col("html")
    return trees.compare(rows(h, n % 7 != 0), rows(F.when(n % 5 == 0, F.concat(h, F.lit("x"))).when(n % 6 == 0, F.reverse(h)).otherwise(h), n % 4 != 0))


@register("j09_job_site", f"WITH {d.S_JOBS} SELECT j.id, j.site_key, j.status, s.domain FROM jobs j JOIN (SELECT 'site' || n_nationkey::VARCHAR AS site_key, lower(n_name) AS domain FROM nation) s USING (site_key)")
def job_site(spark, sf_dir):
    sites = table(spark, sf_dir, "nation").select(F.concat(F.lit("site"), F.col("n_nationkey").cast("string")).alias("site_key"), F.lower("n_name").alias("domain"))
    return d.jobs(spark, sf_dir).join(sites, "site_key").select("id", "site_key", "status", "domain")


@register("j10_cascade", f"WITH {d.S_HISTORY}, kept AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY site_key ORDER BY id DESC) AS n FROM crawls) WHERE n <= 2) SELECT crawl_id, url FROM history WHERE crawl_id IN (SELECT id FROM kept)")
def cascade(spark, sf_dir):
    return history.cascade(d.page_history(spark, sf_dir), history.retained(d.crawls(spark, sf_dir), 2)).select("crawl_id", "url")


S_BFS = """{edges}, bfs(node, depth) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT e.dst, b.depth + 1 FROM bfs b JOIN edges e ON e.src = b.node WHERE b.depth < {most}),
levels AS (SELECT node, min(depth) AS depth FROM bfs GROUP BY node)"""


def _bfs(spark, sf_dir, most: int = 0) -> DataFrame:
    e = d.edges(spark, sf_dir).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    start = spark.createDataFrame([("0", 0)], "url string, depth long")
    return frontier.expand_edges(start, e, most)


@register("j11_breadth_first", f"WITH RECURSIVE {S_BFS.format(edges=d.S_EDGES, most=16)} SELECT node, depth FROM levels")
def breadth_first(spark, sf_dir):
    return _bfs(spark, sf_dir).select(F.col("url").cast("long").alias("node"), "depth")


@register("j11_f07_depth_policy", f"WITH RECURSIVE {S_BFS.format(edges=d.S_EDGES, most=4)} SELECT node, depth, CASE WHEN depth >= 4 THEN 'Policy_MaxDepth' END AS error_type FROM levels")
def depth_policy(spark, sf_dir):
    """Pages at the greatest depth are found and recorded but not fetched."""
    return frontier.fetchable(_bfs(spark, sf_dir, 4), 4).select(F.col("url").cast("long").alias("node"), "depth", "error_type")


PATTERNS = ["^/de/.*[13579]$", "/1[0-9]\\.html$", "^/fr/2"]


@register("j12_f03_scope", f"""
SELECT url FROM pages WHERE {d.s_scheme('url')} IN ('http', 'https') AND {d.s_host('url')} LIKE 'www.%' AND {d.s_path('url')} LIKE '/%'
  AND NOT ({' OR '.join(f"regexp_matches({d.s_path('url')}, '{p}')" for p in PATTERNS)})""")
def scope(spark, sf_dir):
    return d.pages(spark, sf_dir).filter(urls.hostname(U()).startswith("www.") & urls.in_scope(U(), urls.hostname(U()), "/", PATTERNS)).select("url")


# --- aggregations


@register("a01_diff_counts", f"WITH {d.S_HISTORY}, {S_DIFF.format(now=9, then=6)} SELECT count(*) FILTER (kind = 'unchanged') AS unchanged, count(*) FILTER (kind <> 'unchanged') AS total FROM d")
def diff_counts(spark, sf_dir):
    return history.tally(history.crawl_difference(d.crawls(spark, sf_dir), d.page_history(spark, sf_dir), "org", "2024-02-02T00:30:00Z"))


@register("a02_crawl_meta", f"WITH {d.S_STREAM} SELECT 'crawl_meta' AS record_type, 'k' AS site_key, 'dom' AS allowed_domain, 'a' AS crawl_started_at, 'b' AS crawl_ended_at, count(DISTINCT url) AS total_pages FROM stream")
def crawl_meta(spark, sf_dir):
    return records.meta(d.record_stream(spark, sf_dir), "k", "dom", "a", "b")


@register("a03_summary", f"WITH {d.S_JOBS} SELECT count(*) FILTER (status = 'completed') AS success, count(*) FILTER (status = 'failed') AS failed, sum(pages_processed)::BIGINT AS pages FROM jobs")
def summary(spark, sf_dir):
    return d.jobs(spark, sf_dir).agg(F.count_if(F.col("status") == "completed").alias("success"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("pages_processed").alias("pages"))


@register("a04_distinct_links", f"WITH {d.S_ANCHORS} SELECT page_id, count(DISTINCT href) AS links FROM anchors GROUP BY page_id")
def distinct_links(spark, sf_dir):
    return d.anchors(spark, sf_dir).select("page_id", "href").distinct().groupBy("page_id").agg(F.count("*").alias("links"))


@register("a05_status_tally", f"WITH {d.S_STATE} SELECT status, error_type, count(*) AS n FROM state GROUP BY ALL")
def status_tally(spark, sf_dir):
    return state.status_tally(d.page_state(spark, sf_dir))


@register("a07_requeue_counters", f"WITH {d.S_STATE} SELECT count(*) FILTER (status IN ('failure', 'pending', '')) AS requeued, 0::BIGINT AS errors FROM state")
def requeue_counters(spark, sf_dir):
    return state.requeue_tally(d.page_state(spark, sf_dir), False)


@register("a08_sitemap_counters", f"""
WITH {d.S_STATE}, loc AS (SELECT DISTINCT {d.s_normalize('url')} AS url FROM pages WHERE {d.s_host('url')} LIKE 'm.%'), known AS (SELECT DISTINCT url FROM state)
SELECT count(*) FILTER (k.url IS NULL) AS queued, count(*) FILTER (k.url IS NOT NULL) AS known FROM loc LEFT JOIN known k USING (url)""")
def sitemap_counters(spark, sf_dir):
    locs = d.pages(spark, sf_dir).filter(urls.hostname(U()).startswith("m.")).select(U().alias("loc"))
    return sitemaps.tally(locs, d.page_state(spark, sf_dir), urls.hostname(F.col("loc")))


@register("a10_freshness", f"""
WITH {d.S_CRAWLS} SELECT site_key, id, crawl_ended_at, floor(epoch(TIMESTAMP '2024-04-01 00:00:00'))::BIGINT - floor(epoch(crawl_ended_at::TIMESTAMP))::BIGINT AS age_seconds
FROM (SELECT *, row_number() OVER (PARTITION BY site_key ORDER BY id DESC) AS n FROM crawls) WHERE n = 1""")
def freshness(spark, sf_dir):
    return history.freshness(d.crawls(spark, sf_dir), d.NOW)


@register("a11_progress", f"WITH {d.S_JOBS} SELECT site_key, count(*) AS jobs, count(*) FILTER (status = 'running') AS queued, sum(pages_processed)::BIGINT AS processed FROM jobs GROUP BY site_key")
def progress(spark, sf_dir):
    return d.jobs(spark, sf_dir).groupBy("site_key").agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "running").alias("queued"), F.sum("pages_processed").alias("processed"))


# --- windows


@register("w01_last_wins", f"WITH {d.S_STREAM} SELECT url, title, seq FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq DESC) AS n FROM stream) WHERE n = 1")
def last_wins(spark, sf_dir):
    return records.last_wins(d.record_stream(spark, sf_dir))


@register("w02_latest_crawl", f"WITH {d.S_CRAWLS} SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY site_key ORDER BY id DESC) AS n FROM crawls) WHERE n = 1")
def latest_crawl(spark, sf_dir):
    return history.latest(d.crawls(spark, sf_dir))


@register("w03_retention", f"WITH {d.S_CRAWLS} SELECT id, site_key FROM (SELECT *, row_number() OVER (PARTITION BY site_key ORDER BY id DESC) AS n FROM crawls) WHERE n <= 2")
def retention(spark, sf_dir):
    return history.retained(d.crawls(spark, sf_dir), 2).select("id", "site_key")


@register("w04_terminal_jobs", f"WITH {d.S_JOBS} SELECT id, status FROM jobs WHERE status = 'running' UNION ALL SELECT id, status FROM (SELECT id, status FROM jobs WHERE status <> 'running' ORDER BY completed_at DESC, job_no DESC LIMIT 100)")
def terminal_jobs(spark, sf_dir):
    """All active jobs and the newest 100 finished ones."""
    j = d.jobs(spark, sf_dir)
    done = F.col("status").isin("completed", "failed", "cancelled")
    newest = j.filter(done).orderBy(F.col("completed_at").desc(), F.col("job_no").desc()).limit(100)
    return j.filter(~done).unionByName(newest).select("id", "status")


@register("w05_as_of", f"WITH {d.S_CRAWLS} SELECT site_key, id, crawl_ended_at FROM (SELECT *, row_number() OVER (PARTITION BY site_key ORDER BY crawl_ended_at DESC, id DESC) AS n FROM crawls WHERE crawl_ended_at <= '{d.SINCE}') WHERE n = 1")
def as_of(spark, sf_dir):
    return history.as_of(d.crawls(spark, sf_dir), d.SINCE).select("site_key", "id", "crawl_ended_at")


@register("w06_first_page", f"SELECT {d.s_host('url')} AS host, min(url) AS url, arg_min(page_id, url) AS page_id FROM pages GROUP BY 1")
def first_page(spark, sf_dir):
    """Least URL of every host and its page, the least id of equals."""
    first = F.min(F.when(U().isNotNull() & F.col("page_id").isNotNull(), F.struct("url", "page_id")))
    return d.pages(spark, sf_dir).groupBy(urls.hostname(U()).alias("host")).agg(F.min("url").alias("url"), first["page_id"].alias("page_id"))


@register("w07_request_slots", """
WITH a AS (SELECT event_id, user_id, epoch_us(ts) AS arrival_us, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - 1 AS k FROM events)
SELECT event_id, user_id, arrival_us, max(arrival_us - 60000000 * k) OVER (PARTITION BY user_id ORDER BY arrival_us, event_id ROWS UNBOUNDED PRECEDING) + 60000000 * k AS slot_us FROM a""")
def request_slots(spark, sf_dir):
    a = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival_us"))
    return politeness.request_slots(a, 60_000_000, "user_id", "arrival_us", "event_id").select("event_id", "user_id", "arrival_us", "slot_us")


@register("w08_next_run", f"WITH {d.S_CRAWLS} SELECT site_key, epoch(crawl_ended_at::TIMESTAMP)::BIGINT AS last_run, floor(epoch(crawl_ended_at::TIMESTAMP))::BIGINT + 86400 AS next_run FROM crawls WHERE id > 6 ORDER BY next_run, site_key LIMIT 1".replace("epoch(crawl_ended_at::TIMESTAMP)::BIGINT AS", "floor(epoch(crawl_ended_at::TIMESTAMP))::BIGINT AS"))
def next_run(spark, sf_dir):
    last = history.latest(d.crawls(spark, sf_dir)).select("site_key", F.unix_timestamp(F.to_timestamp("crawl_ended_at")).alias("last_run"))
    return last.withColumn("next_run", durations.next_run(F.col("last_run"), F.lit(86_400).cast("long"), F.lit(0).cast("long"))).orderBy("next_run", "site_key").limit(1)


# --- order, pages, sets


@register("o01_depth_order", f"WITH {d.S_STATE} SELECT url, depth, row_number() OVER (ORDER BY depth, url) AS place FROM state")
def depth_order(spark, sf_dir):
    """Work in the order of depth.  The place is counted within depths first, so no single task ranks everything."""
    s = d.page_state(spark, sf_dir)
    sizes = s.groupBy("depth").agg(F.count("*").alias("_n"))
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.expr("b.depth < a.depth"), "left").groupBy("a.depth").agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    ranked = s.withColumn("_r", F.row_number().over(Window.partitionBy("depth").orderBy("url")))
    return ranked.join(before, "depth").select("url", "depth", (F.col("_before") + F.col("_r")).cast("long").alias("place"))


@register("o02_diff_page", f"WITH {d.S_HISTORY}, {S_DIFF.format(now=8, then=5)} SELECT kind, url FROM d WHERE kind <> 'unchanged' ORDER BY kind, url LIMIT 10 OFFSET 5")
def diff_page(spark, sf_dir):
    found = history.crawl_difference(d.crawls(spark, sf_dir), d.page_history(spark, sf_dir), "net", d.SINCE)
    return history.entries(found, 10, 5).select("kind", "url")


@register("o03_f21_list_pages", f"WITH {d.S_MARKDOWN} SELECT url, {d.s_title('html')} AS title, 0::BIGINT AS depth, 't' AS crawled_at, strlen(content)::BIGINT AS content_length FROM md JOIN pages USING (url) ORDER BY url LIMIT 20 OFFSET 3")
def list_pages(spark, sf_dir):
    rows = d.markdown(spark, sf_dir).join(d.pages(spark, sf_dir).select("url", text.simple_title(F.col("html")).alias("title")), "url")
    return records.listing(rows.select("url", "title", F.lit(0).cast("long").alias("depth"), F.lit("t").alias("crawled_at"), "content"), 20, 3)


@register("o04_recent_jobs", f"WITH {d.S_JOBS} SELECT id, site_key, status FROM jobs ORDER BY completed_at DESC, job_no DESC LIMIT 20")
def recent_jobs(spark, sf_dir):
    return d.jobs(spark, sf_dir).orderBy(F.col("completed_at").desc(), F.col("job_no").desc()).limit(20).select("id", "site_key", "status")


@register("o05_c08_sites", f"""
WITH {d.S_CRAWLS}, {d.S_JOBS}, sites AS (SELECT 'site' || n_nationkey::VARCHAR AS site_key, n_name AS domain FROM nation), active AS (SELECT DISTINCT site_key FROM jobs WHERE status = 'running')
SELECT s.site_key, s.domain, a.site_key IS NOT NULL AS crawling FROM sites s LEFT JOIN active a USING (site_key)""")
def sites(spark, sf_dir):
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("site"), F.col("n_nationkey").cast("string")).alias("site_key"), F.col("n_name").alias("domain"))
    active = d.jobs(spark, sf_dir).filter("status = 'running'").select("site_key").distinct().withColumn("_a", F.lit(True))
    return known.join(active, "site_key", "left").select("site_key", "domain", F.col("_a").isNotNull().alias("crawling")).orderBy("site_key")


@register("o06_u01_final_order", f"WITH {d.S_STREAM} SELECT DISTINCT url, 'page' AS record_type FROM stream UNION ALL SELECT NULL, 'crawl_meta'")
def final_order(spark, sf_dir):
    rows = d.record_stream(spark, sf_dir).withColumn("record_type", F.lit("page")).drop("title")
    return records.finalized(rows, spark.createDataFrame([("crawl_meta",)], "record_type string")).select("url", "record_type")


@register("u02_frontier_sources", f"""
WITH {d.S_STATE}, {d.S_ANCHORS}, {S_CANDIDATES}, everything AS (
  SELECT {d.s_normalize('url')} AS url, 0 AS depth FROM pages WHERE page_id % 10 = 0 UNION ALL SELECT url, depth FROM state WHERE status <> 'success' UNION ALL SELECT url, 1 FROM cand)
SELECT url, min(depth)::BIGINT AS depth FROM everything GROUP BY url""")
def frontier_sources(spark, sf_dir):
    seeds = d.pages(spark, sf_dir).filter("page_id % 10 = 0").select(urls.normalize(U()).alias("url"), F.lit(0).cast("long").alias("depth"))
    resumed = state.requeue(d.page_state(spark, sf_dir), False)
    return seeds.unionByName(resumed).unionByName(_candidates(spark, sf_dir)).groupBy("url").agg(F.min("depth").alias("depth"))


@register("u03_tree_sets", "SELECT 'common' AS side, url AS path FROM pages WHERE page_id % 2 = 0 AND page_id % 3 = 0 UNION ALL SELECT 'missing', url FROM pages WHERE page_id % 2 = 0 AND page_id % 3 <> 0")
def tree_sets(spark, sf_dir):
    """Two trees of pages compared; an entry is a page, so that pages of equal URLs stay apart."""
    from lathe.operators import trees

    p = d.pages(spark, sf_dir)
    left, right = (p.filter(f"page_id % {k} = 0").select(U().alias("path"), "page_id") for k in (2, 3))
    return trees.common_paths(left, right, "page_id").select(F.lit("common").alias("side"), "path").union(trees.missing_paths(left, right, "page_id").select(F.lit("missing"), "path"))


@register("u04_distinct_sitemaps", f"SELECT DISTINCT {d.s_scheme('url')} || '://' || {d.s_authority('url')} || '/sitemap.xml' AS url FROM pages")
def distinct_sitemaps(spark, sf_dir):
    from lathe.sources import robots

    line = F.concat(F.lit("user-agent: *\nsitemap: "), urls.scheme(U()), F.lit("://"), urls.authority(U()), F.lit("/sitemap.xml\n"))
    return robots.sitemaps(d.pages(spark, sf_dir).select(line.alias("body")))


@register("u05_selector_union", f"WITH {d.S_ANCHORS} SELECT DISTINCT page_id, {d.s_unescape('href')} AS href FROM anchors")
def selector_union(spark, sf_dir):
    """Anchors found by the page tree below several selectors, each once."""
    from lathe.operators import pagetree

    facts = pagetree.facts_udf("body", ["nav", "nav ul", "body"])
    rows = d.pages(spark, sf_dir).select("page_id", F.explode(facts("html", F.lit(None).cast("string"))["anchors"]).alias("a"))
    return rows.select("page_id", F.col("a.href").alias("href")).distinct()


@register("s10_s12_sitemaps", f"SELECT DISTINCT {d.s_normalize('url')} AS url, 1::BIGINT AS depth FROM pages WHERE {d.s_path('url')} LIKE '/%' AND {d.s_host('url')} LIKE '%.com'")
def sitemap_pages(spark, sf_dir):
    """An index per top-level domain names a sitemap per host; all are built from the pages, parsed and expanded."""
    p = d.pages(spark, sf_dir).select("url", urls.hostname(U()).alias("host"), d.site_of(U()).alias("top"))
    ns = ' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    escape = lambda c: F.replace(c, F.lit("&"), F.lit("&amp;"))
    sets = p.groupBy("top", "host").agg(F.concat(F.lit(f"<urlset{ns}>"), F.array_join(F.collect_list(F.concat(F.lit("<url><loc>"), escape(U()), F.lit("</loc></url>"))), ""), F.lit("</urlset>")).alias("body"))
    sets = sets.withColumn("url", F.concat(F.lit("https://"), F.col("host"), F.lit("/sitemap.xml")))
    index = sets.groupBy("top").agg(F.concat(F.lit(f"<sitemapindex{ns}>"), F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), F.col("url"), F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("body"))
    index = index.withColumn("url", F.concat(F.lit("https://example."), F.col("top"), F.lit("/sitemap.xml")))
    bodies = sets.select("url", "body").unionByName(index.select("url", "body"))
    locs = sitemaps.expand(index.filter("top = 'com'").select("url"), bodies)
    return sitemaps.pages(locs, urls.hostname(F.col("loc")))
