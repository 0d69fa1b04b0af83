import json

import pytest

from lathe import control
from lathe.sources import config, keyed


def test_jobs(tmp_path):
    file = str(tmp_path / "jobs.json")
    jobs = control.Jobs(file, keep=3)
    a, new = jobs.create("s")
    assert new and jobs.create("s") == (a, False)
    jobs.update(a.id, "running", processed=3)
    assert jobs.cancel(a.id) and not jobs.cancel(a.id) and jobs.create("s")[1]
    with pytest.raises(KeyError):
        jobs.cancel("none")
    for i in range(6):
        j, _ = jobs.create(f"x{i}")
        jobs.update(j.id, "completed")
    assert sum(j.status in control.TERMINAL for j in jobs.jobs.values()) == 3
    again = control.Jobs(file)
    assert all(j.status in control.TERMINAL for j in again.jobs.values()) and any("restart" in j.error_message for j in again.jobs.values())
    assert len(jobs.recent(2)) == 2


def test_schedule(tmp_path):
    s = control.Schedule(str(tmp_path / "w.json"))
    seen, now = [], [1000.0]

    def run(keys):
        seen.append(keys)
        return {k: (k != "b", 5, "" if k != "b" else "down") for k in keys}

    control.watch(["b", "a"], 3600, run, s, rounds=3, clock=lambda: now[0], sleep=lambda t: now.__setitem__(0, now[0] + t * 6))
    assert seen == [["a", "b"], ["a", "b"]] or seen == [["a", "b"]]
    assert not s.sites["b"]["last_run_success"] and control.Schedule(str(tmp_path / "w.json")).sites == s.sites
    assert s.due(["a", "c"], 10_000, now[0]) == ["c"] and s.next_run(["a"], 100, 0)[0] == "a" and s.next_run([], 1, 0) is None
    assert [control.tick(x) for x in (60, 3600, 1e6)] == [60, 360, 600]


@pytest.mark.parametrize("spec", [{}, {"command": "x", "site": "a"}, {"command": "crawl"}, {"command": "crawl", "site": "a", "all_sites": True}, {"command": "crawl", "site": "a", "zz": 1}, {"command": "crawl", "sites": ["a", " "]}, {"command": "crawl", "site": "a", "incremental": True, "full": True}, {"command": "watch", "site": "a", "interval": "x"}, {"command": "watch", "site": "a", "resume": True}, {"command": "crawl", "site": 3}])
def test_bad_tasks(spec):
    with pytest.raises(ValueError):
        control.parse_task(json.dumps(spec))


def test_tasks():
    t = control.parse_task('{"command": "watch", "all_sites": true}')
    assert t["interval"] == "24h" and t["config"] == "config.yaml" and control.task_sites(t) is None
    assert control.task_sites(control.parse_task('{"command": "crawl", "sites": [" a ", "b"]}')) == ["a", "b"]
    with pytest.raises(ValueError):
        control.parse_task('{"command": "crawl", "site": "a"} tail')
    assert control.pick_sites("a", "b, c", False) == (["b", "c"], False, ["site"]) and control.pick_sites("a", "b", True) == ([], True, ["sites", "site"])
    results = control.run_sites(["a", "b"], lambda k: 3 if k == "a" else 1 / 0)
    assert control.summary(results) == {"success": 1, "failed": 1, "pages": 3}


def test_validation():
    app = config.App(sites={"a": config.Site(start_urls=["u"], allowed_domain="h", content_selector="body"), "b": config.Site()})
    out = control.validate(app)
    assert not out["valid"] and [s["valid"] for s in out["sites"]] == [True, False] and control.validate(app, "a")["valid"] and not control.validate(app, "zz")["valid"]


def test_tools(spark, tmp_path):
    app = config.App(output_base_dir=str(tmp_path), sites={k: config.Site(start_urls=["http://h/"], allowed_domain="h", content_selector="body") for k in "ab"})
    store = keyed.History(spark, str(tmp_path / "h"))
    pages = lambda *rows: spark.createDataFrame(list(rows), "url string, title string, content_hash string, depth long")
    store.record("a", "t", "2024-01-01T00:00:00.25Z", "full", pages(("u", "U", "1", 0)))
    store.record("a", "t", "2024-01-02T00:00:00Z", "full", pages(("u", "U", "2", 0), ("v", "V", "1", 1)))
    (tmp_path / "a").mkdir()
    (tmp_path / "a/pages.jsonl").write_text("\n".join(json.dumps({"record_type": "page", "url": f"u{i}", "title": "t", "content": "é"}) for i in range(3)))
    tools = control.Tools(spark, app, store, crawl=lambda job: 7, fetch=lambda url: "<title>T</title><p>one<p id=x>two")
    call = tools.registry()
    assert len(call) == 9
    assert [(s["site_key"], s["last_crawled"] is not None) for s in call["list_sites"]()] == [("a", True), ("b", False)]
    listed = call["list_pages"]("a", 2, 1)
    assert listed["total"] == 3 and [p["url"] for p in listed["pages"]] == ["u1", "u2"] and listed["pages"][0]["content_length"] == 2
    assert call["get_page"]("http://h/", "#x")["content"] == "two" and call["get_page"]("http://h/")["title"] == "T"
    fresh = call["get_freshness"]("a", "2024-01-03T00:00:00Z")
    assert fresh["age_seconds"] == 86_400 and fresh["last_crawled"] == "2024-01-02T00:00:00Z" and fresh["age"] == "1d" and not call["get_freshness"]("b")["ever_crawled"]
    # the printed, whole-second end of the first crawl finds that crawl again
    diff = call["diff_crawl"]("a", "2024-01-01T00:00:00Z")
    assert (diff["total"], len(diff["added"]), len(diff["changed"]), diff["unchanged"]) == (2, 1, 1, 0)
    job = call["crawl_site"]("a")["job_id"]
    for _ in range(100):
        if tools.jobs.jobs[job].status in control.TERMINAL:
            break
        import time

        time.sleep(0.05)
    status = call["get_job_status"](job)
    assert status["status"] == "completed" and status["pages_processed"] == 7 and status["duration_seconds"] >= 0
    assert call["cancel_crawl"](job) == {"job_id": job, "cancelled": False} and call["describe_server"]()["jobs"][0]["id"] == job
    with pytest.raises(config.ConfigError):
        call["list_pages"]("zz")
