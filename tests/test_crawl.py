import json

import pytest

from lathe import crawl
from lathe.operators import frontier, history
from lathe.sources import config, keyed


def page(title, body, *links, shell=""):
    nav = "".join(f'<a href="{x}">l</a>' for x in links)
    return f"<html><head><title>{title}</title></head><body><nav>{shell}{nav}</nav><div id='c'>{body}</div></body></html>"


SITE = {
    "http://h/docs/": page("Root", "<h1>Root</h1><p>see <a href='a#x'>A</a></p>", "/docs/a", "b", "http://other/x", "/out/z", "/docs/img.png", "/docs/skip/1"),
    "http://h/docs/a": page("A", "<h2>A</h2><table><tr><th>k</th></tr><tr><td>v</td></tr></table>", "/docs/c?q=1", "/docs/"),
    "http://h/docs/b": page("", "text b", "/docs/missing"),
    "http://h/docs/c": page("C", "text c", "/docs/d"),
    "http://h/docs/d": page("D", "text d"),
    "http://h/docs/skip/1": page("S", "skip"),
}


def fetcher(spark, pages, hits):
    frame = spark.createDataFrame(list(pages.items()), "url string, html string")
    serve = crawl.offline_fetch(frame)

    def fetch(level):
        hits.extend(r["url"] for r in level.select("url").collect())
        return serve(level)

    return fetch


def site(**extra):
    return config.Site(**({"start_urls": ["http://h/docs/"], "allowed_domain": "h", "allowed_path_prefix": "/docs", "content_selector": "#c", "disallowed_path_patterns": ["/skip/"]} | extra))


def test_full_crawl(spark, tmp_path):
    app = config.App(output_base_dir=str(tmp_path / "out"))
    table, store, hits = keyed.KeyedTable(spark, str(tmp_path / "state")), keyed.History(spark, str(tmp_path / "h")), []
    done = crawl.crawl(spark, "s", site(), app, fetcher(spark, SITE, hits), table, store)
    assert sorted(hits) == ["http://h/docs", "http://h/docs/a", "http://h/docs/b", "http://h/docs/c", "http://h/docs/d", "http://h/docs/missing"] or sorted(hits)[0].startswith("http://h/docs")
    rows = {r["url"]: r for r in done.records.collect()}
    depths = {u.removeprefix("http://h/docs").strip("/"): r["depth"] for u, r in rows.items()}
    assert depths == {"": 0, "a": 1, "b": 1, "c": 2, "d": 3}
    assert "| k |" in rows["http://h/docs/a"]["content"] and rows["http://h/docs/b"]["title"] == "Untitled Page"
    assert rows["http://h/docs/"]["headings"] == ["Root"] and "[A](a/index.md#x)" in rows["http://h/docs/"]["content"]
    states = {r["url"]: (r["status"], r["error_type"]) for r in table.read().collect()}
    assert states["http://h/docs/missing"] == ("failure", "HTTP_404") and len(states) == 6 and len(hits) == len(set(hits)) == 6
    lines = [json.loads(x) for x in (tmp_path / "out/s/pages.jsonl").read_text().splitlines()]
    assert [x["record_type"] for x in lines] == ["page"] * 5 + ["crawl_meta"] and lines[-1]["total_pages"] == 5 and [x["url"] for x in lines[:-1]] == sorted(rows)
    assert (tmp_path / "out/s/llms.txt").read_text().count("\n- [") == 5 and "URL: http://h/docs/d" in (tmp_path / "out/s/llms-full.txt").read_text()
    assert store.crawls().first()["total_pages"] == 5 and store.pages().count() == 5

    # nothing due on a plain resume but the failure; everything on an incremental run, of which changed pages count
    hits.clear()
    crawl.crawl(spark, "s", site(), app, fetcher(spark, SITE, hits), table, store, resume=True)
    assert hits == ["http://h/docs/missing"]
    hits.clear()
    changed = SITE | {"http://h/docs/a": page("A", "<h2>new</h2>", "/docs/e"), "http://h/docs/b": page("", "text b", shell="other shell"), "http://h/docs/e": page("E", "text e")}
    changed.pop("http://h/docs/d")
    done = crawl.crawl(spark, "s", site(), app, fetcher(spark, changed, hits), table, store, incremental=True)
    assert {r["url"] for r in done.pages.collect()} == {"http://h/docs/a", "http://h/docs/e"}
    states = {r["url"].removeprefix("http://h/docs").strip("/"): (r["status"], r["content_hash"] is not None) for r in table.read().collect()}
    assert states["d"] == ("failure", False) and states["e"] == ("success", True) and states["b"] == ("success", True)
    lines = [json.loads(x) for x in (tmp_path / "out/s/pages.jsonl").read_text().splitlines()]
    assert sorted(x["url"].removeprefix("http://h/docs").strip("/") for x in lines[:-1]) == ["", "a", "b", "c", "d", "e"]
    first = store.crawls().orderBy("id").first()["crawl_ended_at"]
    diff = history.crawl_difference(store.crawls(), store.pages(), "s", first)
    assert [(r["kind"], r["url"][-1]) for r in history.entries(diff).collect()] == [("added", "e"), ("changed", "a")]


def test_depth_and_robots(spark, tmp_path):
    hits = []
    rules = spark.createDataFrame([("h", "User-agent: *\nDisallow: /docs/b")], "host string, body string")
    done = crawl.crawl(spark, "s", site(max_depth=2), config.App(), fetcher(spark, SITE, hits), rules=rules)
    states = {r["url"].removeprefix("http://h/docs").strip("/"): r["error_type"] for r in done.state.collect()}
    assert states == {"": None, "a": None, "b": "Policy_Robots", "c": "Policy_MaxDepth"} and len(hits) == 2


def test_auto_selector_and_errors(spark):
    done = crawl.crawl(spark, "s", site(content_selector=".none"), config.App(), fetcher(spark, SITE, []))
    assert {r["error_type"] for r in done.state.collect()} == {"Content_SelectorNotFound"} and done.records.count() == 0
    pages = {"http://h/docs/": "<div class='rst-content'>body text <a href='/docs/x'>x</a></div>", "http://h/docs/x": "<p>a page without a region, long enough to be read as content</p>"}
    done = crawl.crawl(spark, "s", site(content_selector="auto"), config.App(), fetcher(spark, pages, []))
    assert {r["content"].split()[0] for r in done.records.collect()} == {"body", "a"}
    with pytest.raises(frontier.NoSeeds):
        crawl.crawl(spark, "s", site(start_urls=["http://x/docs/"]), config.App(), fetcher(spark, SITE, []))


def test_expansion_equals_brute_force(spark):
    import random

    rng = random.Random(2)
    edges = [(str(rng.randint(0, 30)), str(rng.randint(0, 30))) for _ in range(45)]
    depth, level = {"0": 0}, ["0"]
    while level:
        level = sorted({b for a, b in edges if a in level} - set(depth))
        depth |= dict.fromkeys(level, max(depth.values()) + 1)
    frame = spark.createDataFrame(edges, "src string, dst string")
    start = spark.createDataFrame([("0", 0)], "url string, depth long")
    assert {r["url"]: r["depth"] for r in frontier.expand_edges(start, frame).collect()} == depth
    assert {r["url"]: r["depth"] for r in frontier.expand_edges(start, frame, 2).collect()} == {u: d for u, d in depth.items() if d <= 2}
