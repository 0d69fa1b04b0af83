"""Tables that the queries derive from the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.functions import text, urls
from lathe.tables import table

SITE_PATTERN = r"example\.([a-z]+)"

# --- SQL forms of the URL expressions


def s_scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1))"


def s_authority(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)"


def s_host(u: str) -> str:
    return f"regexp_replace({s_authority(u)}, ':[0-9]*$', '')"


def s_path(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"


def s_normalize(u: str) -> str:
    s, a, p = s_scheme(u), f"lower({s_authority(u)})", s_path(u)
    host = f"CASE WHEN ({s} = 'http' AND {a} LIKE '%:80') OR ({s} = 'https' AND {a} LIKE '%:443') THEN regexp_replace({a}, ':(80|443)$', '') ELSE {a} END"
    tail = f"CASE WHEN {p} = '' THEN '/' WHEN length({p}) > 1 AND {p} LIKE '%/' THEN regexp_replace({p}, '/$', '') ELSE {p} END"
    return f"CASE WHEN {s} <> '' AND {a} <> '' THEN {s} || '://' || ({host}) || ({tail}) END"


def s_title(h: str) -> str:
    t = f"regexp_replace(regexp_extract({h}, '(?is)<title[^>]*>(.*?)</title>', 1), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"
    return f"CASE WHEN {t} = '' THEN 'Untitled Page' ELSE {t} END"


def s_unescape(x: str) -> str:
    """Character references as the tables have them, the ampersand last."""
    named = x
    for name, char in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        named = f"regexp_replace({named}, '&{name};?', '{char}', 'g')"
    return named


def s_encode(x: str) -> str:
    """What is no character of a URL, percent-encoded."""
    return f"list_aggregate(list_transform(string_split({x}, ''), lambda c: CASE WHEN regexp_matches(c, '[A-Za-z0-9%/:?#\\[\\]@!$&''()*+,;=~._-]') THEN c ELSE url_encode(c) END), 'string_agg', '')"


def s_sanitize(x: str) -> str:
    """For names of ASCII letters, as in the tables."""
    clean = f"trim(regexp_replace(regexp_replace({x}, '[<>:\"/\\\\|?*\\x00-\\x1F]', '_', 'g'), '_+', '_', 'g'), '_ ')"
    short = f"trim(substr({clean}, 1, 100), '_ ')"
    return f"CASE WHEN trim({short}, '.') = '' THEN 'untitled' ELSE {short} END"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def site_of(url: Column) -> Column:
    return F.regexp_extract(url, SITE_PATTERN, 1)


# --- page state: a quarter of the pages each is a success, failure, pending, or absent

S_STATE = """state AS (
  SELECT url, CASE page_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'failure' ELSE 'pending' END AS status,
    CASE WHEN page_id % 4 = 1 THEN CASE WHEN page_id % 8 = 1 THEN 'HTTP_404' ELSE 'Network_Timeout' END END AS error_type, (page_id % 5)::BIGINT AS depth,
    CASE WHEN page_id % 4 = 0 THEN CASE WHEN page_id % 12 = 0 THEN 'stale' ELSE sha256(html) END ELSE '' END AS content_hash
  FROM pages WHERE page_id % 4 < 3)"""


def page_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    status = F.when(n % 4 == 0, "success").when(n % 4 == 1, "failure").otherwise("pending")
    return pages(spark, sf_dir).filter(n % 4 < 3).select(
        "url", status.alias("status"), F.when(n % 4 == 1, F.when(n % 8 == 1, "HTTP_404").otherwise("Network_Timeout")).alias("error_type"), (n % 5).alias("depth"),
        F.when(n % 4 == 0, F.when(n % 12 == 0, "stale").otherwise(text.sha256(F.col("html")))).otherwise("").alias("content_hash"),
    )


# --- history: three crawls of each of three sites

CRAWLS = [
    (3 * k + i + 1, site, f"2024-0{k + 1}-01T09:00:00Z", end, "full" if k == 0 else "incremental")
    for k in range(3)
    for i, (site, end) in enumerate([("com", f"2024-0{k + 1}-01T10:00:00.5Z"), ("net", f"2024-0{k + 1}-01T10:00:00Z"), ("org", f"2024-0{k + 1}-02T00:30:00.25Z")])
]
SINCE = "2024-02-01T10:00:00Z"
NOW = "2024-04-01T00:00:00Z"
S_CRAWLS = "crawls(id, site_key, crawl_started_at, crawl_ended_at, mode) AS (VALUES " + ", ".join(f"({i}::BIGINT, '{s}', '{a}', '{b}', '{m}')" for i, s, a, b, m in CRAWLS) + ")"
S_HISTORY = f"""{S_CRAWLS},
history AS (
  SELECT c.id AS crawl_id, p.url, {s_title('p.html')} AS title, (p.page_id % 4)::BIGINT AS depth,
    sha256(p.html) || CASE WHEN c.id > 3 AND p.page_id % 3 = 0 THEN '-' || c.id::VARCHAR ELSE '' END AS content_hash
  FROM pages p JOIN crawls c ON c.site_key = regexp_extract(p.url, 'example\\.([a-z]+)', 1)
  WHERE p.page_id % CASE WHEN c.id <= 3 THEN 7 WHEN c.id <= 6 THEN 5 ELSE 3 END <> 0)"""


def crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(CRAWLS, "id long, site_key string, crawl_started_at string, crawl_ended_at string, mode string")


def page_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).withColumn("site_key", site_of(F.col("url")))
    joined = p.join(crawls(spark, sf_dir).select("id", "site_key"), "site_key")
    divisor = F.when(F.col("id") <= 3, 7).when(F.col("id") <= 6, 5).otherwise(3)
    tail = F.when((F.col("id") > 3) & (F.col("page_id") % 3 == 0), F.concat(F.lit("-"), F.col("id").cast("string"))).otherwise("")
    return joined.filter(F.col("page_id") % divisor != 0).select(
        F.col("id").alias("crawl_id"), "url", text.simple_title(F.col("html")).alias("title"), (F.col("page_id") % 4).alias("depth"), F.concat(text.sha256(F.col("html")), tail).alias("content_hash")
    )


# --- replayed records

S_STREAM = f"""stream AS (
  SELECT url, {s_title('html')} AS title, page_id::BIGINT AS seq FROM pages
  UNION ALL SELECT url, {s_title('html')} || ' (again)', page_id + 1000000 FROM pages WHERE page_id % 6 = 0)"""


def record_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).select("page_id", "url", text.simple_title(F.col("html")).alias("title"))
    first = p.select("url", "title", F.col("page_id").alias("seq"))
    return first.unionByName(p.filter("page_id % 6 = 0").select("url", F.concat("title", F.lit(" (again)")).alias("title"), (F.col("page_id") + 1_000_000).alias("seq")))


# --- a link graph: a tree with edges back

S_EDGES = """edges AS (
  SELECT p.page_id::BIGINT AS src, q.page_id::BIGINT AS dst FROM pages p JOIN pages q ON q.page_id IN (2 * p.page_id + 1, 2 * p.page_id + 2)
  UNION SELECT page_id, page_id // 3 FROM pages)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).select("page_id")
    down = p.select(F.col("page_id").alias("src"), F.explode(F.array(F.col("page_id") * 2 + 1, F.col("page_id") * 2 + 2)).alias("dst"))
    there = down.join(p.select(F.col("page_id").alias("dst")), "dst", "left_semi").select("src", "dst")
    return there.union(p.select("page_id", F.expr("page_id div 3"))).distinct()


# --- anchors, Markdown

S_ANCHORS = "anchors AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)"


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


S_MARKDOWN = f"""md AS (
  SELECT page_id, url, '# ' || {s_title('html')} || chr(10) || chr(10) || '## ' || {s_host('url')} || chr(10) || chr(10) || '[self](' || url || ') ![i](/img/' || page_id::VARCHAR || '.png) ![](x)' AS content FROM pages)"""


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(
        F.lit("# "), text.simple_title(F.col("html")), F.lit("\n\n## "), urls.hostname(F.col("url")), F.lit("\n\n[self]("), F.col("url"), F.lit(") ![i](/img/"), F.col("page_id").cast("string"), F.lit(".png) ![](x)")
    )
    return pages(spark, sf_dir).select("page_id", "url", body.alias("content"))


S_JOBS = """jobs AS (
  SELECT o_orderkey::VARCHAR AS id, 'site' || (o_custkey % 25)::VARCHAR AS site_key, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status,
    epoch(o_orderdate)::BIGINT AS completed_at, o_orderkey::BIGINT AS job_no, o_custkey::BIGINT AS pages_processed FROM orders)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("running")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("site"), (F.col("o_custkey") % 25).cast("string")).alias("site_key"), status.alias("status"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("completed_at"), F.col("o_orderkey").cast("long").alias("job_no"), F.col("o_custkey").cast("long").alias("pages_processed"),
    )


def cases(names: str, rows: list[tuple]) -> tuple[str, list[tuple]]:
    """A VALUES list for SQL, from Python rows."""

    def lit(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else ("TRUE" if v else "FALSE") if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) cases({names})", rows
