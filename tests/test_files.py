import io
import json

import pytest

from lathe import __main__ as cli
from lathe.sources import files, web


def test_write_tree(spark, tmp_path):
    rows = spark.createDataFrame([("a/index.md", "één"), ("b.md", "x" * 10)], "path string, text string")
    assert sorted(tuple(r) for r in files.write_tree(rows, tmp_path.as_uri()).collect()) == [("a/index.md", 5), ("b.md", 10)]
    assert (tmp_path / "a/index.md").read_text() == "één" and not list(tmp_path.rglob("*.tmp"))
    with pytest.raises(Exception, match="leaves the output folder"):
        files.write_tree(spark.createDataFrame([("../x", "y")], "path string, text string"), tmp_path.as_uri()).collect()


def test_pictures(spark, tmp_path):
    answers = {"http://h/a.png": (200, "image/png", b"12345", 5), "http://h/edge.gif": (200, "image/gif", b"1" * 8, None), "http://h/fits.gif": (200, "image/gif", b"1" * 8, 8), "http://h/none": (200, "", b"1", None), "http://h/gone.png": (404, "", b"", None), "http://h/big.png": (200, "image/png", b"1", 99)}

    def get(url):
        if url not in answers:
            raise OSError("reset")
        return answers[url]

    tasks = spark.createDataFrame([(u,) for u in [*answers, "http://h/a.png", "http://x/down.png"]], "url string")
    got = {r["url"]: r for r in files.fetch_pictures(tasks, tmp_path.as_uri(), 8, get).collect()}
    assert {u.rsplit("/", 1)[1]: (r["status"], r["error_type"]) for u, r in got.items()} == {
        "a.png": ("success", None), "edge.gif": ("failure", "Filesystem_Other"), "fits.gif": ("success", None), "none": ("failure", "Content_ParsingOther"), "gone.png": ("failure", "HTTP_404"), "big.png": ("failure", "Filesystem_Other"), "down.png": ("failure", "RetryFailed_NetworkOther"),
    }
    assert (tmp_path / got["http://h/a.png"]["local_path"]).read_bytes() == b"12345" and len(list((tmp_path / "images").iterdir())) == 2


def test_categories():
    c = web.category
    assert [c(200, None, "text/html"), c(200, None, "image/png"), c(404, "status 404 ", ""), c(410, "x", ""), c(304, "x", ""), c(None, "blocked", ""), c(None, "retries exhausted: x", ""), c(200, "body exceeds the limit", "")] == [None, "Content_NonHTML", "HTTP_404", "HTTP_4xx", "HTTP_OtherStatus", "Unknown", "RetryFailed_Unknown", "Network_BodyRead"]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    pages = spark.createDataFrame([("http://h/", "<title>R</title><p>root <a href='/a'>a</a>"), ("http://h/a", "<p>a")], "url string, html string")
    pages.write.parquet(str(tmp_path / "pages"))
    site = {"start_urls": ["http://h/"], "allowed_domain": "h", "content_selector": "body"}
    conf = tmp_path / "c.json"
    conf.write_text(json.dumps({"output_base_dir": str(tmp_path / "out"), "state_dir": str(tmp_path / "state"), "enable_jsonl_output": True, "sites": {"s": site, "bad": {}}}))
    common = ["--config", str(conf), "--pages", str(tmp_path / "pages")]
    assert cli.main(["crawl", "--site", "s", *common]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"success": 1, "failed": 0, "pages": 2}
    assert (tmp_path / "out/s/pages.jsonl").exists() and cli.main(["crawl", *common]) == 2
    monkeypatch.setattr("sys.stdin", io.StringIO(json.dumps({"command": "crawl", "config": str(conf), "site": "s", "incremental": True})))
    assert cli.main(["run", "--pages", str(tmp_path / "pages")]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["pages"] == 0
    assert cli.main(["watch", "--site", "s", "--rounds", "1", *common]) == 0 and (tmp_path / "state/watch_state.json").exists()
    assert cli.main(["config", "validate", "--config", str(conf), "--json"]) == 1 and cli.main(["config", "validate", "--config", str(conf), "--site", "s"]) == 0 and cli.main(["config", "list", "--config", str(conf)]) == 0
