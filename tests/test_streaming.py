import json

import pytest

from lathe.sources.keyed import KeyedTable
from lathe.streaming import flows


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, flows.ROCKS)
    yield spark
    spark.conf.set(key, old)


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def finish(df, spark, name, mode="append", checkpoint=None):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_upsert_stream(spark, tmp_path):
    put(tmp_path / "in", "1.json", [{"url": "a", "status": "pending", "seq": 1}, {"url": "a", "status": "success", "seq": 2}, {"url": "b", "status": "pending", "seq": 3}])
    table = KeyedTable(spark, str(tmp_path / "t"))
    stream = source(spark, tmp_path / "in", table.schema + ", seq long")
    query = flows.upsert_stream(stream, table, str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert flows.progress(query)["rows"] >= 3
    put(tmp_path / "in", "2.json", [{"url": "b", "status": "failure", "seq": 4}, {"url": "c", "status": "pending", "seq": 5}])
    flows.upsert_stream(stream, table, str(tmp_path / "ck")).awaitTermination(120)
    assert {r["url"]: r["status"] for r in table.read().collect()} == {"a": "success", "b": "failure", "c": "pending"}


def test_first_seen(spark, tmp_path):
    put(tmp_path / "in", "1.json", [{"url": "a"}, {"url": "a"}, {"url": "b"}])
    put(tmp_path / "in", "2.json", [{"url": "b"}, {"url": "c"}])
    rows = finish(flows.first_seen(source(spark, tmp_path / "in", "url string")), spark, "first_seen", checkpoint=tmp_path / "ck")
    assert sorted(r["url"] for r in rows) == ["a", "b", "c"]


def test_steps():
    assert flows.step(None, "", "seen", "", False) == ("pending", "", "fetch")
    assert flows.step("success", "h", "seen", "", False)[2] == "skip" and flows.step("success", "h", "seen", "", True) == ("success", "h", "fetch")
    assert flows.step("success", "h", "success", "h", True)[2] == "unchanged" and flows.step("success", "h", "success", "i", True) == ("success", "i", "changed")
    assert flows.step("success", "h", "failure", "", True) == ("failure", "", "retry") and flows.step("failure", "", "seen", "", False)[2] == "fetch"


def test_page_states(rocks, tmp_path):
    put(tmp_path / "in", "1.json", [{"url": "a", "event": "seen", "content_hash": ""}, {"url": "b", "event": "failure", "content_hash": ""}])
    rows = finish(flows.page_states(source(rocks, tmp_path / "in", "url string, event string, content_hash string")), rocks, "page_states", "update", tmp_path / "ck")
    assert sorted((r["url"], r["status"], r["action"]) for r in rows) == [("a", "pending", "fetch"), ("b", "failure", "retry")]


def test_expiring_cache(rocks, tmp_path):
    put(tmp_path / "in", "1.json", [{"host": "a", "event": "ok", "value": "rules"}, {"host": "a", "event": "lookup", "value": None}])
    put(tmp_path / "in", "2.json", [{"host": "b", "event": "failed", "value": ""}, {"host": "b", "event": "lookup", "value": None}, {"host": "c", "event": "lookup", "value": None}])
    rows = finish(flows.cached(source(rocks, tmp_path / "in", "host string, event string, value string")), rocks, "cached", "update", tmp_path / "ck")
    got = {r["host"]: r["answer"] for r in rows}
    assert got["c"] == "miss" and got["a"] == "hit" and got["b"] == "failed"
