"""Structured Streaming flows of the crawl engine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from lathe.operators import records
from lathe.sources.keyed import KeyedTable

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def upsert_stream(stream: DataFrame, target: KeyedTable, checkpoint: str, sequence: str = "seq", trigger: dict | None = None) -> StreamingQuery:
    """Keep ``target`` at the last row per URL of an unbounded stream of state rows.

    Within a micro-batch the row of greatest sequence wins; a later batch replaces an earlier one.
    """

    def apply(batch: DataFrame, _: int) -> None:
        target.upsert(records.last_wins(batch, "url", sequence))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def append_stream(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append records as JSON lines while they arrive; ``records.finalized`` compacts them afterwards."""
    return records.json_lines(stream).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def first_seen(stream: DataFrame, key: str = "url") -> DataFrame:
    """Insert-if-absent on a stream: the first row of every key.  The visited set is kept for good, as a crawl needs it."""
    return stream.dropDuplicates([key])


class PageMachine(StatefulProcessor):
    """absent -> pending -> success or failure; failures are tried again, successes only looked at again when incremental.

    Input rows have url, event (seen, success, failure) and content_hash; the
    output says what to do: fetch, skip, changed, unchanged, retry.
    """

    def __init__(self, incremental: bool = False):
        self.incremental = incremental

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.page = handle.getValueState("page", "status string, content_hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        status, known = self.page.get() if self.page.exists() else (None, "")
        for batch in rows:
            for event, content in zip(batch["event"], batch["content_hash"]):
                status, known, action = step(status, known, event, content or "", self.incremental)
                out.append((key[0], status, action))
        self.page.update((status, known))
        yield pd.DataFrame(out, columns=["url", "status", "action"])

    def close(self) -> None:
        pass


def step(status: str | None, known: str, event: str, content: str, incremental: bool) -> tuple[str, str, str]:
    """(status, stored hash, action) after an event."""
    if event == "seen":
        if status == "success" and not incremental:
            return status, known, "skip"
        return ("pending" if status is None else status), known, "fetch"
    if event == "success":
        if status == "success" and incremental and known and known == content:
            return status, known, "unchanged"
        return "success", content, "changed"
    return "failure", "", "retry"


def page_states(stream: DataFrame, incremental: bool = False) -> DataFrame:
    """The page state machine on a stream (needs the RocksDB state store)."""
    return stream.groupBy("url").transformWithStateInPandas(PageMachine(incremental), outputStructType="url string, status string, action string", outputMode="Update", timeMode="None")


class ExpiringCache(StatefulProcessor):
    """Answers look-ups (host, event 'lookup') from fetched results (event 'ok' or 'failed'); failures are forgotten after a while."""

    def __init__(self, seconds: int = 600):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.good = handle.getValueState("good", "value string")
        self.failed = handle.getValueState("failed", "value string", ttlDurationMs=self.seconds * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for batch in rows:
            for event, value in zip(batch["event"], batch["value"]):
                if event == "ok":
                    self.good.update((value,))
                elif event == "failed":
                    self.failed.update((value or "",))
                else:
                    hit = "hit" if self.good.exists() else "failed" if self.failed.exists() else "miss"
                    out.append((key[0], hit, self.good.get()[0] if hit == "hit" else None))
        yield pd.DataFrame(out, columns=["host", "answer", "value"])

    def close(self) -> None:
        pass


def cached(stream: DataFrame, seconds: int = 600) -> DataFrame:
    return stream.groupBy("host").transformWithStateInPandas(ExpiringCache(seconds), outputStructType="host string, answer string, value string", outputMode="Update", timeMode="ProcessingTime")


def progress(query: StreamingQuery) -> dict:
    """Rows read and batches done so far."""
    recent = query.recentProgress
    return {"batches": len(recent), "rows": sum(p["numInputRows"] for p in recent)}


def arrivals(stream: DataFrame) -> DataFrame:
    """Counts per host and minute of an event stream, late rows up to ten minutes admitted."""
    return stream.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 minute"), "host").agg(F.count("*").alias("n"))
