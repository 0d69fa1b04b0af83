import json

import pytest

from lathe.operators import history, records, trees
from lathe.sources import config, jsonl, keyed, robots, sitemaps, web

YAML = """
default_user_agent: bot
num_workers: 0
initial_retry_delay: 2m
max_retry_delay: 30s
skip_images: false
unknown_key: 1
sites:
  a:
    start_urls: ["https://h/docs/"]
    allowed_domain: h
    allowed_path_prefix: docs
    content_selector: auto
    delay_per_host: 500ms
    max_depth: -2
    skip_images: true
  b: {start_urls: [], allowed_domain: h, content_selector: body}
"""


def test_config():
    app = config.parse(YAML)
    notes = config.validate_app(app)
    assert app.num_workers == 4 and app.initial_retry_delay == 30 and app.max_retries == 0 and len(notes) >= 4
    site = app.sites["a"]
    assert len(config.validate_site(site)) == 1 and site.allowed_path_prefix == "/docs" and site.max_depth == 0
    found = config.resolve(site, app)
    assert found["user_agent"] == "bot" and found["skip_images"] is True and found["delay_per_host"] == 0.5 and found["jsonl_output_filename"] == "pages.jsonl" and found["max_page_size_bytes"] == 50 << 20
    assert config.resolve(app.sites["b"], app)["skip_images"] is False and config.resolve(config.Site(), config.App())["skip_images"] is True
    with pytest.raises(config.ConfigError):
        config.validate_site(app.sites["b"])
    with pytest.raises(config.ConfigError):
        config.require_sites(app, ["a", "zz"])
    assert config.mode(True, True) == "incremental" and config.mode(True, False) == "resume" and config.mode(False, False) == "full"
    assert config.output_dir("out/", "a/b") == "out/a_b" and config.state_path("s", "a") == "s/a_visited_db"


def test_sites_frame(spark):
    assert [r["site_key"] for r in config.sites_frame(spark, config.parse(YAML)).collect()] == ["a", "b"]


def test_json_lines(spark, tmp_path):
    page = lambda url, title, **k: json.dumps({"record_type": "page", "url": url, "title": title, **k})
    lines = [page("u2", "old", content="x" * 100), "", "not json", page("u1", "one", depth=3, headings=None), '{"record_type":"crawl_meta","site_key":"s","crawl_ended_at":"1"}', page("u2", "new", content_hash="h"), page("u3", "cut")[:-5], '{"record_type":"crawl_meta","site_key":"s","crawl_ended_at":"2"}', '{"title":"page"}']
    file = tmp_path / "p.jsonl"
    file.write_text("\n".join(lines))
    rows = jsonl.read_pages(spark, str(file))
    assert sorted((r["url"], r["title"]) for r in rows.collect()) == [("u1", "one"), ("u2", "new"), ("u2", "old")]
    kept = records.last_wins(jsonl.sequenced(rows).coalesce(1), "url", "seq")
    assert {r["url"]: r["title"] for r in kept.collect()} == {"u1": "one", "u2": "new"}
    assert {r["url"]: r["title"] for r in jsonl.last_per_url(jsonl.sequenced(rows)).collect()} == {"u1": "one", "u2": "new"}
    assert jsonl.last_meta(spark, str(file)).first()["crawl_ended_at"] == "2"
    assert jsonl.read_page_keys(spark, str(file)).columns == ["url", "title", "content_hash", "depth"]
    final = records.finalized(kept, records.meta(kept, "s", "d", "a", "b"))
    out = tmp_path / "final.jsonl"
    assert jsonl.export_file(records.json_lines(final), str(out)) == 3
    back = [json.loads(x) for x in out.read_text().splitlines()]
    assert [r.get("url") for r in back] == ["u1", "u2", None] and back[-1]["total_pages"] == 2 and back[0]["headings"] is None
    # finalizing twice changes nothing
    again = jsonl.sequenced(jsonl.read_pages(spark, str(out)))
    twice = records.finalized(records.last_wins(again), records.meta(again, "s", "d", "a", "b"))
    jsonl.export_file(records.json_lines(twice), str(tmp_path / "twice.jsonl"))
    assert (tmp_path / "twice.jsonl").read_text() == out.read_text()
    assert jsonl.count_pages(spark, str(out)) == 2
    jsonl.append(kept.drop("seq"), str(tmp_path / "more"))
    assert jsonl.read_pages(spark, str(tmp_path / "more")).count() == 2


def test_manifests(spark, tmp_path):
    rows = spark.createDataFrame([("u2", "B]", "text"), ("u1", " ", None)], "url string, title string, content string")
    text = lambda df, c: [r[c] for r in df.collect()]
    assert text(records.manifest(rows, "s", "d"), "line") == ["# s", "", "> Crawled documentation from d. 2 pages.", "", "## Pages", "- [u1](u1)", "- [B\\]](u2)"]
    assert text(records.manifest(rows.limit(0), "s", "d"), "line")[-1] == "_No pages were successfully crawled._"
    assert "".join(text(records.full_manifest(rows, "s", "d"), "section")) == "# s\n\n> Full crawled content from d.\n\n---\n\n# u1\n\nURL: u1\n\n\n\n---\n\n# B]\n\nURL: u2\n\ntext\n\n"


def test_robots(spark):
    rules = robots.parse("User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf$\n\nUser-agent: Bot\nUser-agent: other # two\nDisallow:\nDisallow: /x\nSitemap: http://h/s.xml\n")
    check = lambda agent, p: rules.allows(agent, p)
    assert [check("z", p) for p in ("/", "/a", "/a/b/c", "/q.pdf", "/q.pdf?x", "/x")] == [True, False, True, False, True, True]
    assert not check("My-Bot/1.0", "/x") and check("bot", "/a") and rules.sitemaps == ["http://h/s.xml"] and robots.parse(None).allows("b", "/x")
    pages = spark.createDataFrame([("http://h/a",), ("http://h:80/a",), ("http://none/a",)], "url string")
    body = spark.createDataFrame([("h", "User-agent: *\nDisallow: /a\nSITEMAP: http://h/s.xml")], "host string, body string")
    assert {r["url"]: r["robots_ok"] for r in robots.check(pages, body, "b").collect()} == {"http://h/a": False, "http://h:80/a": True, "http://none/a": True}
    assert [r["url"] for r in robots.sitemaps(body).collect()] == ["http://h/s.xml"]


def test_sitemaps(spark):
    index = lambda *u: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in u) + "</sitemapindex>"
    urlset = lambda *u: '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://x/">' + "".join(f"<url><loc> {x} </loc><lastmod>1</lastmod></url>" for x in u) + "</urlset>"
    bodies = spark.createDataFrame([("i", index("s1", "s2", "i")), ("s1", urlset("http://h/a?q", "http://h/b.pdf", "http://o/x")), ("s2", index("s3")), ("s3", urlset("http://h/no/c", "http://h/a/")), ("bad", "<x"), ("s4", urlset("http://h/unreached"))], "url string, body string")
    locs = sitemaps.expand(spark.createDataFrame([("i",), ("bad",)], "url string"), bodies)
    assert sorted(r["loc"] for r in locs.collect()) == ["http://h/a/", "http://h/a?q", "http://h/b.pdf", "http://h/no/c", "http://o/x"]
    got = sitemaps.pages(locs, "h", "/", ["^/no"]).collect()
    assert sorted((r["url"], r["depth"]) for r in got) == [("http://h/a", 1), ("http://h/b.pdf", 1)]
    assert sitemaps.parse_text("x" * 10_000_001) == ("error", [])


def test_history(spark, tmp_path):
    store = keyed.History(spark, str(tmp_path / "h"), keep=2)
    page = lambda rows: spark.createDataFrame(rows, "url string, title string, content_hash string, depth long")
    assert store.crawls().count() == 0 and store.pages().count() == 0
    store.record("s", "t0", "2024-01-01T00:00:00.5Z", "full", page([("a", "A", "1", 0), ("b", "B", "1", 1), ("c", "C", "1", 1)]))
    store.record("o", "t0", "2024-01-01T00:00:00Z", "full", page([("a", "A", "9", 0)]))
    store.record("s", "t1", "2024-01-02T00:00:00Z", "incremental", page([("a", "A2", "1", 0), ("b", "B", "2", 1), ("d", "D", "1", 2)]))
    found = history.crawl_difference(store.crawls(), store.pages(), "s", "2024-01-01T00:00:00Z")
    assert [(r["kind"], r["url"], r["prior_hash"]) for r in history.entries(found).collect()] == [("added", "d", ""), ("changed", "b", "1"), ("removed", "c", "")]
    assert tuple(history.tally(found).first()) == (1, 3)
    for since in ("2023-01-01T00:00:00Z", "2025-01-01T00:00:00Z"):
        assert history.crawl_difference(store.crawls(), store.pages(), "s", since).count() == 0
    store.record("s", "t2", "2024-01-03T00:00:00Z", "full", page([("z", "Z", "1", 0)]))
    assert sorted(r["id"] for r in store.crawls().collect()) == [2, 3, 4] and store.pages().filter("crawl_id = 1").count() == 0
    assert history.freshness(store.crawls(), "2024-01-03T00:01:00.9Z").filter("site_key = 's'").first()["age_seconds"] == 60
    with pytest.raises(ValueError):
        store.record("", "a", "b", "full", page([]))


def test_keyed_table(spark, tmp_path):
    t = keyed.KeyedTable(spark, str(tmp_path / "t"))
    rows = lambda *r: spark.createDataFrame([(u, s, None, None, None, 0, None) for u, s in r], t.schema)
    t.write(rows(("a", "pending"), ("b", "success")))
    t.upsert(rows(("a", "failure"), ("c", "pending")))
    assert {r["url"]: r["status"] for r in t.read().collect()} == {"a": "failure", "b": "success", "c": "pending"}
    assert t.compact() == 1 and t.versions() == [2]
    t.wipe()
    assert t.read().count() == 0


def test_clean_below(tmp_path):
    (tmp_path / "base/in").mkdir(parents=True)
    for bad in ("base", "base/..", "base/../x"):
        with pytest.raises(ValueError):
            keyed.clean_below(str(tmp_path / "base"), str(tmp_path / bad))
    keyed.clean_below(str(tmp_path / "base"), str(tmp_path / "base/in"))
    assert not (tmp_path / "base/in").exists()


def test_trees(spark, tmp_path):
    for side, files in (("l", {"a.md": "1\n2\n", "d/b.md": "same", "only": "x", "bin": "aa"}), ("r", {"a.md": "1\n3\n", "d/b.md": "same", "new": "y", "bin": "bbb"})):
        for name, body in files.items():
            (tmp_path / side / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / side / name).write_text(body)
    left, right = (trees.scan_tree(spark, str(tmp_path / s)) for s in "lr")
    assert {r["path"]: r["verdict"] for r in trees.compare(left, right).collect()} == {"a.md": "content", "d/b.md": "same", "only": "only_left", "new": "only_right", "bin": "size"}
    lines = {r["path"]: r["lines"] for r in trees.line_differences(left, right).collect()}
    assert lines["a.md"][-2:] == ["-2", "+3"] and set(lines) == {"a.md", "bin"}


def test_fetch_decisions(monkeypatch):
    calls = []

    def answer(script):
        def get(url, agent, timeout, cap, private=False):
            calls.append(url)
            step = script[min(len(calls) - 1, len(script) - 1)]
            if isinstance(step, Exception):
                raise step
            return step

        calls.clear()
        monkeypatch.setattr(web, "get", get)
        return web.fetch("http://h/a", retries=2, first=0.001, most=0.001, sleep=lambda s: None)

    assert answer([(200, "text/html", b"ok")])[2:5] == (200, "text/html", "ok")
    assert answer([(503, "", b""), (200, "text/html", b"ok")])[4] == "ok" and len(calls) == 2
    assert "retries exhausted" in answer([(503, "", b"")])[5] and len(calls) == 3
    assert answer([(404, "", b"")])[5] == "status 404 " and len(calls) == 1
    assert answer([(429, "", b""), OSError("reset"), (200, "t", b"x")])[4] == "x" and len(calls) == 3
    assert "blocked" in answer([web.Blocked("blocked address")])[5] and len(calls) == 1
    assert answer([(302, "http://h/b", b""), (200, "t", b"x")])[1] == "http://h/b"
    assert web.delays(4, 1, 5) == [1, 2, 4, 5]
    with pytest.raises(web.Blocked):
        web.safe_address("127.0.0.1", 80)


def test_page_source(spark):
    """The network reader against a server of our own."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            moved, missing = self.path == "/moved", self.path == "/none"
            self.send_response(302 if moved else 404 if missing else 200)
            self.send_header("Location", "/there") if moved else self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write(self.path.encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    web.register(spark)
    read = lambda private: spark.read.format("web_pages").option("urls", f"{base}/a\n{base}/moved\n{base}/none").option("delay", "0").option("private", private).option("retries", "0").load().collect()
    got = {r["url"][len(base) :]: r for r in read("true")}
    server.shutdown()
    assert got["/a"]["html"] == "/a" and got["/moved"]["html"] == "/there" and got["/moved"]["final_url"].endswith("/there") and got["/none"]["status"] == 404
    assert all("blocked" in r["error"] for r in read("false"))


