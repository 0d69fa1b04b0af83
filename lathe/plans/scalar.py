"""Queries over the scalar expressions: URLs, names, Markdown, failures, durations, pictures, configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.functions import addresses, durations, errors, pictures, text, urls
from lathe.plans import derived as d
from lathe.plans.registry import register
from lathe.sources import config
from lathe.tables import table

def U():
    return F.col("url")

WS = "[ \\t\\n\\x0B\\f\\r]+"


def _frame(spark, schema: str, rows: list[tuple]):
    return spark.createDataFrame(rows, schema)


@register("x01_normalize", f"SELECT page_id, {d.s_normalize('url')} AS norm_url FROM pages")
def normalize(spark, sf_dir):
    return d.pages(spark, sf_dir).select("page_id", urls.normalize(U()).alias("norm_url"))


URL_CASES = ["HTTP://Docs.Example.COM:80/A/", "https://h.example:443", "https://h.example:8443/x/", "http://h:443/x", "https://h/a?q=1#f", "https://h//", "/relative", "mailto:x@y", "https:///nohost", "http://u@h/p/", "ftp://h/f/", "", "https://h/#"]
_SQL, _ROWS = d.cases("url", [(u,) for u in URL_CASES])


@register("x01_x02_normalize_cases", f"SELECT url, {d.s_normalize('url')} AS norm_url, {d.s_normalize('url')} IS NOT NULL AS absolute FROM {_SQL}")
def normalize_cases(spark, sf_dir):
    n = urls.normalize(U())
    return _frame(spark, "url string", _ROWS).select("url", n.alias("norm_url"), n.isNotNull().alias("absolute"))


@register("x03_resolve_rooted", f"WITH {d.S_ANCHORS} SELECT page_id, href, {d.s_scheme('url')} || '://' || {d.s_authority('url')} || {d.s_encode('href')} AS absolute FROM anchors")
def resolve_rooted(spark, sf_dir):
    """The general resolver; the tables' hrefs all begin with a slash, so that SQL can give the answer."""
    return d.anchors(spark, sf_dir).select("page_id", "href", urls.resolve(U(), F.col("href")).alias("absolute"))


@register("x04_extension", f"SELECT page_id, lower(regexp_extract({d.s_path('url')}, '(\\.[^./]*)$', 1)) AS ext FROM pages")
def extension(spark, sf_dir):
    return d.pages(spark, sf_dir).select("page_id", urls.extension(urls.path(U())).alias("ext"))


@register("x05_sanitize", f"SELECT page_id, {d.s_sanitize('url')} AS name FROM pages")
def sanitize(spark, sf_dir):
    return d.pages(spark, sf_dir).select("page_id", text.sanitize(U()).alias("name"))


NAMES = [("..",), ("",), ("a<b>c",), ("__x__",), ("  y ",), ("a/b\\c|d?e*f",), ("." * 5,), ("n" * 150,), ("ok.name",), ("_ _",)]
_NAME_SQL, _ = d.cases("name", NAMES)


@register("x05_sanitize_cases", f"SELECT name, {d.s_sanitize('name')} AS clean FROM {_NAME_SQL}")
def sanitize_cases(spark, sf_dir):
    return _frame(spark, "name string", NAMES).select("name", text.sanitize(F.col("name")).alias("clean"))


_P = d.s_path("url")
_BARE = f"CASE WHEN regexp_replace({_P}, '/$', '') = '' THEN '/' ELSE regexp_replace({_P}, '/$', '') END"
_LAST = "parts[len(parts)]"


@register("x06_output_path", f"""
WITH p AS (SELECT page_id, list_filter(string_split(ltrim(regexp_replace({_BARE}, '^/', ''), '/'), '/'), lambda x: x <> '') AS parts FROM pages)
SELECT page_id, 'out/' || CASE WHEN len(parts) = 0 THEN 'index.md' WHEN {_LAST} LIKE '%._%' THEN array_to_string(list_concat(parts[1:len(parts) - 1], [regexp_replace({_LAST}, '\\.[^.]*$', '') || '.md']), '/')
  ELSE array_to_string(list_concat(parts, ['index.md']), '/') END AS file FROM p""")
def output_path(spark, sf_dir):
    """Every page in the tree of its own host (segments in the tables need no cleaning)."""
    return d.pages(spark, sf_dir).select("page_id", urls.output_path(U(), urls.hostname(U()), "/", "out").alias("file"))


HREFS = [(h,) for h in ("", "#top", "//cdn.example/x", "mailto:a@b", "http://h/x", "a/b", "/foo:bar", "page.html#s", "x:y", "../up", "?q=1", "a:b/c", "./a:b")]
_HREF_SQL, _ = d.cases("href", HREFS)


@register("x08_rewrite_eligible", f"SELECT href, href <> '' AND href NOT LIKE '#%' AND href NOT LIKE '//%' AND NOT (instr(href, ':') > 0 AND (instr(href, '/') = 0 OR instr(href, ':') < instr(href, '/'))) AS eligible FROM {_HREF_SQL}")
def rewrite_eligible(spark, sf_dir):
    return _frame(spark, "href string", HREFS).select("href", urls.rewrite_eligible(F.col("href")).alias("eligible"))


@register("x09_x10_hashes", "SELECT page_id, sha256(html) AS html_hash, sha256(url) AS url_hash FROM pages")
def hashes(spark, sf_dir):
    return d.pages(spark, sf_dir).select("page_id", F.sha2(F.encode("html", "UTF-8"), 256).alias("html_hash"), text.sha256(U()).alias("url_hash"))


def _s_items(pattern: str) -> str:
    items = f"list_filter(list_transform(regexp_extract_all(content, '{pattern}', 2), lambda x: regexp_replace(x, '^{WS}|{WS}$', '', 'g')), lambda x: x <> '')"
    return f"CASE WHEN len({items}) > 0 THEN array_to_string({items}, chr(31)) END"


@register("x11_x13_markdown_items", f"WITH {d.S_MARKDOWN} SELECT page_id, {_s_items('(?m)^(#{1,6})\\s+(.+)$')} AS headings, {_s_items('(?:^|[^!])\\[([^\\]]*)\\]\\(([^)]+)\\)')} AS links, {_s_items('!\\[([^\\]]*)\\]\\(([^)]+)\\)')} AS images FROM md")
def markdown_items(spark, sf_dir):
    c = F.col("content")
    return d.markdown(spark, sf_dir).select("page_id", *[F.array_join(f(c), "\x1f").alias(n) for n, f in (("headings", text.headings), ("links", text.links), ("images", text.pictures))])


@register("x14_title", f"SELECT page_id, {d.s_title('html')} AS title FROM pages")
def title(spark, sf_dir):
    return d.pages(spark, sf_dir).select("page_id", text.simple_title(F.col("html")).alias("title"))


ERRORS = [
    (None, None, None, "None"), ("retry_failed", "x", None, "RetryFailed_Unknown"), ("retry_failed", "x", "server_http", "RetryFailed_HTTPServer"), ("retry_failed", "x", "client_http", "RetryFailed_HTTPClient"),
    ("retry_failed", "i/o timeout", "net", "RetryFailed_NetworkTimeout"), ("retry_failed", "dial: connection refused", "net", "RetryFailed_ConnectionRefused"), ("retry_failed", "no such host", "net", "RetryFailed_DNSLookup"), ("retry_failed", "eof", "net", "RetryFailed_NetworkOther"),
    ("client_http", "status 404 for x", None, "HTTP_404"), ("client_http", "status 403 for x", None, "HTTP_403"), ("client_http", "status 401 for x", None, "HTTP_401"), ("client_http", "status 429 for x", None, "HTTP_429"), ("client_http", "status 410 for x", None, "HTTP_4xx"), ("client_http", "404", None, "HTTP_4xx"),
    ("server_http", "502", None, "HTTP_5xx"), ("other_http", "304", None, "HTTP_OtherStatus"), ("robots", "", None, "Policy_Robots"), ("scope", "", None, "Policy_Scope"), ("max_depth", "", None, "Policy_MaxDepth"), ("selector", "", None, "Content_SelectorNotFound"),
    ("parsing", "bad URL and HTML", None, "Content_ParsingURL"), ("parsing", "bad HTML", None, "Content_ParsingHTML"), ("parsing", "bad JSON", None, "Content_ParsingJSON"), ("parsing", "bad XML", None, "Content_ParsingXML"), ("parsing", "?", None, "Content_ParsingOther"),
    ("markdown", "", None, "Content_Markdown"), ("filesystem", "", "permission", "Filesystem_Permission"), ("filesystem", "", "not_exist", "Filesystem_NotExist"), ("filesystem", "", "exist", "Filesystem_Exist"), ("filesystem", "", None, "Filesystem_Other"),
    ("database", "", None, "Database_Other"), ("semaphore_timeout", "", None, "Resource_SemaphoreTimeout"), ("request_creation", "", None, "Internal_RequestCreation"), ("body_read", "", None, "Network_BodyRead"), ("config", "", None, "Config_Validation"), ("non_html", "", None, "Content_NonHTML"),
    ("canceled", "", None, "System_ContextCanceled"), ("deadline", "waiting for semaphore", None, "Resource_SemaphoreTimeout"), ("deadline", "slow", None, "System_ContextDeadlineExceeded"), ("net_timeout", "", None, "Network_Timeout"), ("net", "Read TIMEOUT", None, "Network_TimeoutGeneric"),
    ("net", "Connection Refused", None, "Network_ConnectionRefused"), ("net", "no such host", None, "Network_DNSLookup"), ("net", "bad certificate", None, "Network_TLS"), ("net", "TLS alert", None, "Network_TLS"), ("net", "reset by peer", None, "Network_ConnectionReset"), ("net", "broken pipe", None, "Network_BrokenPipe"), ("blocked", "blocked address", None, "Unknown"),
]
#: Every kind with every message and cause, besides those.
FAILURE_KINDS = sorted({k for k, *_ in ERRORS if k}) + [None]
FAILURE_MESSAGES = sorted({m for _, m, *_ in ERRORS if m is not None} | {"deadline exceeded", "bad TLS certificate", "status 403 in HTML"}) + [None]
FAILURE_CAUSES = sorted({c for *_, c, _ in ERRORS if c} | {"net_timeout"}) + [None]


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


_ERROR_SQL = f"""(SELECT kind, message, cause, coalesce(message, '') AS m, lower(coalesce(message, '')) AS low
  FROM (SELECT unnest({_list(FAILURE_KINDS)}) AS kind), (SELECT unnest({_list(FAILURE_MESSAGES)}) AS message), (SELECT unnest({_list(FAILURE_CAUSES)}) AS cause))"""
_DIRECT_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in errors.DIRECT.items())


@register("x22_error_category", f"""
SELECT kind, message, cause, CASE
  WHEN kind IS NULL AND message IS NULL THEN 'None'
  WHEN kind = 'retry_failed' THEN 'RetryFailed_' || CASE WHEN cause IS NULL THEN 'Unknown' WHEN cause = 'server_http' THEN 'HTTPServer' WHEN cause = 'client_http' THEN 'HTTPClient'
    WHEN regexp_matches(m, '[tT]imeout|deadline exceeded') OR cause = 'net_timeout' THEN 'NetworkTimeout' WHEN m LIKE '%connection refused%' THEN 'ConnectionRefused' WHEN m LIKE '%no such host%' THEN 'DNSLookup' ELSE 'NetworkOther' END
  WHEN kind = 'client_http' THEN 'HTTP_' || CASE WHEN m LIKE '% 404 %' THEN '404' WHEN m LIKE '% 403 %' THEN '403' WHEN m LIKE '% 401 %' THEN '401' WHEN m LIKE '% 429 %' THEN '429' ELSE '4xx' END
  WHEN kind = 'parsing' THEN 'Content_Parsing' || CASE WHEN m LIKE '%URL%' THEN 'URL' WHEN m LIKE '%HTML%' THEN 'HTML' WHEN m LIKE '%JSON%' THEN 'JSON' WHEN m LIKE '%XML%' THEN 'XML' ELSE 'Other' END
  WHEN kind = 'filesystem' THEN 'Filesystem_' || CASE cause WHEN 'permission' THEN 'Permission' WHEN 'not_exist' THEN 'NotExist' WHEN 'exist' THEN 'Exist' ELSE 'Other' END
  ELSE CASE kind {_DIRECT_SQL} WHEN 'deadline' THEN CASE WHEN m LIKE '%semaphore%' THEN 'Resource_SemaphoreTimeout' ELSE 'System_ContextDeadlineExceeded' END WHEN 'net_timeout' THEN 'Network_Timeout'
    ELSE CASE WHEN low LIKE '%timeout%' THEN 'Network_TimeoutGeneric' WHEN low LIKE '%connection refused%' THEN 'Network_ConnectionRefused' WHEN low LIKE '%no such host%' THEN 'Network_DNSLookup' WHEN regexp_matches(low, 'tls|certificate') THEN 'Network_TLS'
      WHEN low LIKE '%reset by peer%' THEN 'Network_ConnectionReset' WHEN low LIKE '%broken pipe%' THEN 'Network_BrokenPipe' ELSE 'Unknown' END END END AS category FROM {_ERROR_SQL}""")
def error_category(spark, sf_dir):
    """The ladder over every kind, message and cause."""
    rows = spark.range(1)
    for name, values in (("kind", FAILURE_KINDS), ("message", FAILURE_MESSAGES), ("cause", FAILURE_CAUSES)):
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(v).cast("string") for v in values])))
    return rows.select("kind", "message", "cause", errors.category(F.col("kind"), F.col("message"), F.col("cause")).alias("category"))


@register("x23_s05_response_verdict", "SELECT o_orderkey AS id, 200 + o_orderkey % 400 AS status, CASE WHEN 200 + o_orderkey % 400 BETWEEN 200 AND 299 THEN 'ok' WHEN 200 + o_orderkey % 400 >= 500 OR 200 + o_orderkey % 400 = 429 THEN 'retry' ELSE 'fail' END AS verdict FROM orders")
def response_verdict(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (200 + F.col("o_orderkey") % 400).alias("status"))
    return rows.withColumn("verdict", errors.response_verdict(F.col("status")))


@register("x24_size_verdict", """
WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::BIGINT END AS declared, l_quantity::BIGINT AS received, CASE WHEN l_linenumber = 5 THEN 0 ELSE 20 END AS most FROM lineitem)
SELECT declared, received, most, CASE WHEN most > 0 AND declared > most THEN 'too_large_declared' WHEN most > 0 AND (received > most OR (received = most AND NOT coalesce(declared >= 0 AND declared <= most, FALSE))) THEN 'too_large' ELSE 'ok' END AS verdict, count(*) AS n FROM s GROUP BY ALL""")
def size_verdict(spark, sf_dir):
    n = F.col("l_linenumber")
    s = table(spark, sf_dir, "lineitem").select(F.when(n % 2 == 0, F.col("l_quantity").cast("long")).alias("declared"), F.col("l_quantity").cast("long").alias("received"), F.when(n == 5, 0).otherwise(20).alias("most"))
    return s.withColumn("verdict", errors.size_verdict(F.col("declared"), F.col("received"), F.col("most"))).groupBy("declared", "received", "most", "verdict").agg(F.count("*").alias("n"))


_LASTSEG = f"regexp_extract({_P}, '([^/]*)/*$', 1)"
_OWN = f"regexp_extract({_LASTSEG}, '(\\.[^.]*)$', 1)"


@register("x25_local_name", f"""
WITH t AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/avif; q=1' WHEN 2 THEN 'text/x' END AS kind FROM pages)
SELECT page_id, {d.s_sanitize(f"regexp_replace({_LASTSEG}, '\\.[^.]*$', '')")} || '_' || substr(sha256(url), 1, 8) ||
  CASE WHEN page_id % 4 = 0 THEN '.png' WHEN {_OWN} <> '' THEN {_OWN} WHEN page_id % 4 = 1 THEN '.avif' END AS name FROM t""")
def local_name(spark, sf_dir):
    n = F.col("page_id") % 4
    kind = F.when(n == 0, "image/png").when(n == 1, "image/avif; q=1").when(n == 2, "text/x")
    return d.pages(spark, sf_dir).select("page_id", pictures.local_name(U(), kind).alias("name"))


@register("x26_caption", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'figure' WHEN page_id % 3 = 1 THEN 'alt' ELSE '' END AS caption FROM pages")
def caption(spark, sf_dir):
    n = F.col("page_id") % 3
    return d.pages(spark, sf_dir).select("page_id", pictures.caption(F.when(n == 0, "  figure "), F.when(n == 1, " alt").when(n == 0, "no")).alias("caption"))


@register("x27_backoff", "SELECT l_linenumber AS attempt, least(l_tax::DOUBLE * 0 + 1.5 * pow(2, l_linenumber - 1), 30.0) AS delay, count(*) AS n FROM lineitem GROUP BY ALL")
def backoff(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("attempt"), durations.backoff(F.col("l_linenumber"), F.lit(1.5), F.lit(30.0)).alias("delay"))
    return rows.groupBy("attempt", "delay").agg(F.count("*").alias("n"))


@register("x28_jitter", "SELECT event_id, round(10 + (('0x' || left(md5(event_id::VARCHAR), 8))::UINTEGER / 4294967296.0::DOUBLE * 0.2::DOUBLE - 0.1::DOUBLE) * 10, 6) AS delay FROM events")
def jitter(spark, sf_dir):
    """Delays of 10 s, within a tenth, by the event's id."""
    return table(spark, sf_dir, "events").select("event_id", F.round(durations.jitter(F.lit(10.0), key=F.col("event_id")), 6).alias("delay"))


INTERVALS = ["30s", "5m", "1h", "24h", "1d", "7d", "1d12h", "2d6h30m", "1h30m", "500ms", "1.5h", "x", "", "5", "d", "1h1d", "3.s", "1d1.25h2m3s4ms"]
_INTERVAL_SQL = f"""(SELECT unnest({_list(INTERVALS)}) AS t UNION ALL
  SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 9)::VARCHAR || 'd' ELSE '' END || (o_custkey % 30)::VARCHAR || CASE o_orderkey % 5 WHEN 0 THEN 'h' WHEN 1 THEN 'm' WHEN 2 THEN 's' WHEN 3 THEN 'ms' ELSE '' END FROM orders)"""


@register("x29_parse_interval", f"""
SELECT t AS interval_text, CASE WHEN t <> '' AND regexp_matches(t, '^([0-9]+d)?([0-9]+([.][0-9]*)?(ms|s|m|h))*$') THEN
  coalesce(try_cast(regexp_extract(t, '^([0-9]+)d', 1) AS DOUBLE), 0) * 86400 + coalesce(list_sum(list_transform(regexp_extract_all(regexp_replace(t, '^[0-9]+d', ''), '[0-9.]+[a-z]+'),
    lambda x: regexp_extract(x, '^[0-9.]+')::DOUBLE * CASE regexp_extract(x, '[a-z]+$') WHEN 'h' THEN 3600 WHEN 'm' THEN 60 WHEN 's' THEN 1 ELSE 0 END + CASE WHEN x LIKE '%ms' THEN regexp_extract(x, '^[0-9.]+')::DOUBLE / 1000 ELSE 0 END)), 0) END AS seconds
FROM {_INTERVAL_SQL}""")
def parse_interval(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, ("h", "m", "s", "ms", ""))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    made = table(spark, sf_dir, "orders").select(F.concat(F.when(F.col("o_orderkey") % 3 == 0, F.concat((F.col("o_orderkey") % 9).cast("string"), F.lit("d"))).otherwise(""), (F.col("o_custkey") % 30).cast("string"), unit).alias("interval_text")).distinct()
    rows = _frame(spark, "interval_text string", [(t,) for t in INTERVALS]).unionAll(made)
    return rows.select("interval_text", durations.parse(F.col("interval_text")).alias("seconds"))


_S = "floor(l_extendedprice * 10)::BIGINT"


@register("x30_format_interval", f"""
SELECT l_orderkey, l_linenumber, CASE WHEN s < 60 THEN s::VARCHAR || 's' WHEN s < 3600 THEN (s // 60)::VARCHAR || 'm' WHEN s < 86400 THEN (s // 3600)::VARCHAR || 'h' || CASE WHEN s // 60 % 60 > 0 THEN (s // 60 % 60)::VARCHAR || 'm' ELSE '' END
  ELSE (s // 86400)::VARCHAR || 'd' || CASE WHEN s // 3600 % 24 > 0 THEN (s // 3600 % 24)::VARCHAR || 'h' ELSE '' END END AS shown FROM (SELECT l_orderkey, l_linenumber, {_S} AS s FROM lineitem)""")
def format_interval(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", durations.format(F.floor(F.col("l_extendedprice") * 10)).alias("shown"))


@register("x31_rfc3339", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || rtrim(rtrim(strftime(ts, '.%f'), '0'), '.') || 'Z' AS stamp FROM events")
def rfc3339(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", durations.rfc3339(F.col("ts").cast("timestamp")).alias("stamp"))


@register("x32_x33_escapes", """
WITH t AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '  ' WHEN page_id % 3 = 1 THEN '[a]' || chr(92) || chr(10) || 'b' ELSE 'plain' END AS title, url FROM pages), f AS (SELECT page_id, CASE WHEN trim(title) = '' THEN url ELSE trim(title) END AS t FROM t)
SELECT page_id, replace(replace(replace(replace(t, chr(92), chr(92) || chr(92)), '[', chr(92) || '['), ']', chr(92) || ']'), chr(10), ' ') AS link_text, replace(t, chr(10), ' ') AS heading FROM f""")
def escapes(spark, sf_dir):
    n = F.col("page_id") % 3
    t = text.title_or_url(F.when(n == 0, "  ").when(n == 1, "[a]\\\nb").otherwise("plain"), U())
    return d.pages(spark, sf_dir).select("page_id", text.escape_link_text(t).alias("link_text"), text.escape_heading(t).alias("heading"))


DOMAINS = [(h, p) for h in ("a.example.com", "example.com", "EXAMPLE.com", "badexample.com", "x.org") for p in ("*.example.com", "example.com", "*.", "*.ORG", "x.org")]
_DOMAIN_SQL, _ = d.cases("host, pattern", DOMAINS)


@register("x34_domain_match", f"SELECT host, pattern, CASE WHEN pattern LIKE '*.%' THEN suffix(lower(host), substr(lower(pattern), 2)) OR (length(pattern) > 2 AND lower(host) = substr(lower(pattern), 3)) ELSE lower(host) = lower(pattern) END AS hit FROM {_DOMAIN_SQL}")
def domain_match(spark, sf_dir):
    return _frame(spark, "host string, pattern string", DOMAINS).select("host", "pattern", urls.domain_matches(F.col("host"), F.col("pattern")).alias("hit"))


@register("x35_json_round_trip", "SELECT page_id, url, NULL::VARCHAR AS title, length(html)::BIGINT AS n FROM pages")
def json_round_trip(spark, sf_dir):
    line = F.to_json(F.struct("page_id", "url", F.lit(None).cast("string").alias("title"), F.length("html").cast("long").alias("n")), {"ignoreNullFields": "false"})
    return d.pages(spark, sf_dir).select(F.from_json(line, "page_id long, url string, title string, n long").alias("r")).select("r.*")


LEVELS = [(x,) for x in ("debug", " INFO ", "Warn", "warning", "error", "trace", "")]
_LEVEL_SQL, _ = d.cases("name", LEVELS)


@register("x36_log_level", f"SELECT name, CASE lower(trim(name)) WHEN 'debug' THEN 'debug' WHEN 'warn' THEN 'warn' WHEN 'warning' THEN 'warn' WHEN 'error' THEN 'error' ELSE 'info' END AS level FROM {_LEVEL_SQL}")
def log_level(spark, sf_dir):
    return _frame(spark, "name string", LEVELS).select("name", text.log_level(F.col("name")).alias("level"))


@register("x37_site_paths", f"SELECT n_name AS site, 'out/' || {d.s_sanitize('n_name')} AS output_dir, 'state/' || {d.s_sanitize('n_name')} || '_visited_db' AS state_path FROM nation")
def site_paths(spark, sf_dir):
    n = text.sanitize(F.col("n_name"))
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("site"), F.concat(F.lit("out/"), n).alias("output_dir"), F.concat(F.lit("state/"), n, F.lit("_visited_db")).alias("state_path"))


@register("x38_next_run", f"WITH {d.S_JOBS} SELECT id, coalesce(CASE WHEN status = 'completed' THEN completed_at END + 3600, 1700000000) AS next_run FROM jobs")
def next_run_of_jobs(spark, sf_dir):
    last = F.when(F.col("status") == "completed", F.col("completed_at"))
    return d.jobs(spark, sf_dir).select("id", durations.next_run(last, F.lit(3600).cast("long"), F.lit(1_700_000_000).cast("long")).alias("next_run"))


@register("x40_effective_config", """
WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'agent' END AS ua, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 3 = 1 END AS skip, (c_custkey % 4)::DOUBLE AS delay FROM customer)
SELECT c_custkey, CASE WHEN ua <> '' THEN ua ELSE 'default' END AS user_agent, coalesce(skip, TRUE) AS skip_images, CASE WHEN delay > 0 THEN delay ELSE 0.5 END AS delay FROM s""")
def effective_config(spark, sf_dir):
    n = F.col("c_custkey")
    s = table(spark, sf_dir, "customer").select("c_custkey", F.when(n % 2 == 0, "").otherwise("agent").alias("ua"), F.when(n % 3 != 0, n % 3 == 1).alias("skip"), (n % 4).cast("double").alias("delay"))
    return s.select("c_custkey", F.coalesce(F.nullif("ua", F.lit("")), F.lit("default")).alias("user_agent"), F.coalesce("skip", F.lit(None).cast("boolean"), F.lit(True)).alias("skip_images"), F.when(F.col("delay") > 0, F.col("delay")).otherwise(0.5).alias("delay"))


@register("x41_status_label", f"WITH {d.S_STATE} SELECT url, CASE WHEN status = 'pending' THEN 'unset' ELSE status END AS label FROM state")
def status_label(spark, sf_dir):
    s = F.when(F.col("status") == "pending", "").otherwise(F.col("status"))
    return d.page_state(spark, sf_dir).select("url", text.status_label(s).alias("label"))


# --- filters


@register("f01_f02_host_scope", f"SELECT page_id, {d.s_scheme('url')} IN ('http', 'https') AS web, {d.s_host('url')} = 'www.ththin.example.com' AS own FROM pages")
def host_scope(spark, sf_dir):
    return d.pages(spark, sf_dir).select("page_id", urls.scheme(U()).isin("http", "https").alias("web"), (urls.hostname(U()) == "www.ththin.example.com").alias("own"))


_EXTS = ", ".join(f"'{e}'" for e in urls.RESOURCE_EXTENSIONS)


@register("f04_resource_links", f"WITH t AS (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '/a.PNG' WHEN 1 THEN '/a.b/c' WHEN 2 THEN '.pdf' ELSE '' END AS url FROM pages WHERE url NOT LIKE '%?%' AND url NOT LIKE '%#%') SELECT page_id, lower(regexp_extract({_P}, '(\\.[^./]*)$', 1)) IN ({_EXTS}) AS resource FROM t")
def resource_links(spark, sf_dir):
    n = F.col("page_id") % 4
    tail = F.when(n == 0, "/a.PNG").when(n == 1, "/a.b/c").when(n == 2, ".pdf").otherwise("")
    rows = d.pages(spark, sf_dir).filter(~U().contains("?") & ~U().contains("#"))
    return rows.select("page_id", urls.is_resource(F.concat(U(), tail)).alias("resource"))


@register("f05_nofollow", "SELECT page_id, page_id % 3 = 1 AS nofollow FROM pages")
def nofollow(spark, sf_dir):
    n = F.col("page_id") % 3
    return d.pages(spark, sf_dir).select("page_id", urls.is_nofollow(F.when(n == 1, "noopener NoFollow").when(n == 2, "noopener")).alias("nofollow"))


KINDS = [("text/html; charset=utf-8", "html"), ("application/xhtml+xml", "html"), ("image/png", "reject"), ("application/pdf", "reject"), ("application/octet-stream", "reject"), ("font/woff2", "reject"), ("text/plain", "warn"), ("", "warn"), ("VIDEO/mp4", "reject"), ("application/json", "warn")]
_KIND_SQL, _ = d.cases("content_type, verdict", KINDS)


@register("f10_content_type", f"SELECT content_type, verdict FROM {_KIND_SQL}")
def content_type(spark, sf_dir):
    return _frame(spark, "content_type string", [(k,) for k, _ in KINDS]).select("content_type", errors.content_verdict(F.col("content_type")).alias("verdict"))


_A = "((l_orderkey * 7919 + l_linenumber * 104729) % 256)"
_B = "((l_orderkey * 31 + l_linenumber) % 256)"


@register("f11_blocked_addresses", f"""
WITH a AS (SELECT DISTINCT {_A} AS a, {_B} AS b FROM lineitem)
SELECT a::VARCHAR || '.' || b::VARCHAR || '.0.1' AS address, a = 127 OR a = 10 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR a BETWEEN 224 AND 239 OR (a = 100 AND b BETWEEN 64 AND 127) AS blocked FROM a""")
def blocked_addresses(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.expr(_A).alias("a"), F.expr(_B).alias("b")).distinct()
    address = F.concat(F.col("a").cast("string"), F.lit("."), F.col("b").cast("string"), F.lit(".0.1"))
    return a.select(address.alias("address"), addresses.blocked_v4(address).alias("blocked"))


@register("f12_image_domains", f"SELECT page_id, {d.s_host('url')} NOT LIKE 'blog.%' AND ({d.s_host('url')} LIKE '%.example.com' OR {d.s_host('url')} LIKE '%.example.org') AS allowed FROM pages WHERE {d.s_host('url')} LIKE '%.%.%'")
def image_domains(spark, sf_dir):
    h = urls.hostname(U())
    wild = F.concat(F.lit("*."), F.regexp_replace(h, "^blog\\.", ""))
    denied = F.when(h.startswith("blog."), urls.domain_matches(h, wild)).otherwise(False)
    rows = d.pages(spark, sf_dir).filter(h.rlike(r"\..*\."))
    return rows.select("page_id", (~denied & urls.domain_allowed(h, ["*.example.com", "*.example.org"], [])).alias("allowed"))


S_TAGS = "tags AS (SELECT page_id, url, CASE page_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'data:image/png;base64,x' WHEN 2 THEN 'ftp://h/x.png' WHEN 3 THEN 'https://deny.example/x.png' ELSE url || '.png' END AS src FROM pages)"
_S_STATUS = "CASE WHEN src = '' THEN 'skipped-empty-src' WHEN src LIKE 'data:%' THEN 'skipped-data-uri' WHEN src LIKE 'ftp:%' THEN 'skipped-scheme' WHEN src LIKE 'https://deny.%' THEN 'skipped-domain' WHEN page_id % 8 = 4 THEN 'skipped-robots' WHEN page_id % 8 = 5 THEN 'success' ELSE 'pending-download' END"


def _tags(spark, sf_dir):
    n = F.col("page_id") % 8
    src = F.when(n == 0, "").when(n == 1, "data:image/png;base64,x").when(n == 2, "ftp://h/x.png").when(n == 3, "https://deny.example/x.png").otherwise(F.concat(U(), F.lit(".png")))
    rows = d.pages(spark, sf_dir).select("page_id", src.alias("src"))
    status = pictures.tag_status(F.col("src"), F.col("src"), n != 4, F.when(n == 5, "success"), F.when(n == 5, "images/x.png"), False, [], ["*.deny.example"])
    return rows.withColumn("status", status)


@register("f13_tag_status", f"WITH {S_TAGS} SELECT page_id, {_S_STATUS} AS status FROM tags")
def tag_status(spark, sf_dir):
    return _tags(spark, sf_dir).select("page_id", "status")


@register("f14_a06_disposition", f"WITH {S_TAGS}, s AS (SELECT page_id, {_S_STATUS} AS status FROM tags) SELECT CASE WHEN status = 'success' OR (status = 'pending-download' AND page_id % 8 = 6) THEN 'rewrite' WHEN status = 'pending-download' THEN 'remove' ELSE 'leave' END AS disposition, count(*) AS n FROM s GROUP BY ALL")
def disposition(spark, sf_dir):
    path = F.when((F.col("page_id") % 8).isin(5, 6), "images/x.png")
    return _tags(spark, sf_dir).groupBy(pictures.disposition(F.col("status"), path).alias("disposition")).agg(F.count("*").alias("n"))


@register("f15_noise_anchors", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN FALSE ELSE TRUE END AS removed FROM pages")
def noise_anchors(spark, sf_dir):
    from lathe.operators import dom, pagetree

    @F.pandas_udf("boolean")
    def removed(html):
        def one(t):
            tree = dom.parse(t)
            pagetree.clean(tree)
            return not any(n.tag == "a" for n in tree.walk())

        return html.map(one)

    n = F.col("page_id") % 4
    html = F.when(n == 0, '<p><a href="#x">text</a></p>').when(n == 1, '<h1>t<a class="headerlink x" href="#x">¶</a></h1>').when(n == 2, '<a href="#t"> </a>').otherwise("<a title='Link to this heading'>q</a>")
    return d.pages(spark, sf_dir).select("page_id", removed(html).alias("removed"))


@register("f16_known_sites", "SELECT 'nation' || c_nationkey::VARCHAR AS site_key, count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) GROUP BY 1")
def known_sites(spark, sf_dir):
    """Requested keys without a configuration."""
    known = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, sf_dir, "customer").join(known, "c_nationkey", "left_anti").groupBy(F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("site_key")).agg(F.count("*").alias("n"))


@register("f17_f18_due", f"WITH {d.S_JOBS} SELECT id, status IN ('completed', 'failed', 'cancelled') AS terminal, status = 'running' OR 900000000 - completed_at >= 86400 AS due FROM jobs")
def due(spark, sf_dir):
    last = F.when(F.col("status") != "running", F.col("completed_at"))
    return d.jobs(spark, sf_dir).select("id", F.col("status").isin("completed", "failed", "cancelled").alias("terminal"), (last.isNull() | (F.lit(900_000_000) - last >= 86_400)).alias("due"))


SELECTORS = [("auto", True), ("AUTO", True), ("Auto", True), ("aUTO", False), ("body", False), ("", False)]
_SELECTOR_SQL, _ = d.cases("selector, auto", SELECTORS)


@register("f19_auto_selector", f"SELECT selector, auto FROM {_SELECTOR_SQL}")
def auto_selector(spark, sf_dir):
    return _frame(spark, "selector string", [(s,) for s, _ in SELECTORS]).select("selector", F.col("selector").isin("auto", "AUTO", "Auto").alias("auto"))


@register("f22_crawl_mode", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'incremental' WHEN o_orderkey % 3 = 0 THEN 'resume' ELSE 'full' END AS mode FROM orders")
def crawl_mode(spark, sf_dir):
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(n % 2 == 0, "incremental").when(n % 3 == 0, "resume").otherwise("full").alias("mode"))


@register("f23_a09_config_checks", "SELECT key, valid FROM (VALUES ('a', TRUE), ('b', FALSE), ('c', FALSE), ('d', FALSE), ('e', TRUE)) t(key, valid)")
def config_checks(spark, sf_dir):
    good = {"start_urls": ["http://h/"], "allowed_domain": "h", "content_selector": "body"}
    sites = {"a": good, "b": good | {"start_urls": []}, "c": good | {"allowed_domain": ""}, "d": good | {"content_selector": ""}, "e": good | {"max_depth": -1}}
    rows = []
    for key, values in sites.items():
        try:
            config.validate_site(config.Site(**values))
            rows.append((key, True))
        except config.ConfigError:
            rows.append((key, False))
    return _frame(spark, "key string, valid boolean", rows)
