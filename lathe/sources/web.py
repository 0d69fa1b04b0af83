"""Fetched pages: an offline table, or an optional network reader as a Python data source.

The reader opens one partition per host, keeps the delay of that host, tries
again on network failures, 5xx and 429, and refuses addresses that are not
public.  Nothing here runs unless a caller asks for it.
"""

from __future__ import annotations

import http.client
import random
import socket
import ssl
import time
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lathe.functions.addresses import is_blocked
from lathe.functions.urls import authority, normalize

REDIRECTS = 10
FETCHED = "url string, final_url string, status int, content_type string, html string, error string"


def offline(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html) of a stored corpus, with the normalized URL."""
    return spark.read.parquet(path).withColumn("norm_url", normalize(F.col("url")))


class Blocked(OSError):
    """The host has an address that is not public."""


def safe_address(host: str, port: int) -> list[tuple]:
    """Resolved addresses, all of them public; resolved once so that no second answer is used."""
    found = socket.getaddrinfo(host, port, type=socket.SOCK_STREAM)
    if any(is_blocked(a[4][0]) for a in found):
        raise Blocked(f"blocked address for {host}")
    return found


def get(url: str, agent: str, timeout: float, cap: int, private: bool = False) -> tuple[int, str, bytes]:
    """(status, content type, body) of one request without redirects."""
    u = urlsplit(url)
    port = u.port or (443 if u.scheme == "https" else 80)
    addresses = [(None, None, None, None, (u.hostname, port))] if private else safe_address(u.hostname or "", port)
    last: Exception = OSError("no address")
    for *_, where in addresses:
        try:
            sock = socket.create_connection(where[:2], timeout=timeout)
            if u.scheme == "https":
                sock = ssl.create_default_context().wrap_socket(sock, server_hostname=u.hostname)
            link = http.client.HTTPConnection(u.hostname or "", port, timeout=timeout)
            link.sock = sock
            link.request("GET", (u.path or "/") + (f"?{u.query}" if u.query else ""), headers={"User-Agent": agent, "Accept": "text/html"})
            answer = link.getresponse()
            body = answer.read(cap + 1)
            link.close()
            if 300 <= answer.status < 400 and answer.getheader("Location"):
                return answer.status, urljoin(url, answer.getheader("Location") or ""), b""
            return answer.status, answer.getheader("Content-Type") or "", body
        except OSError as problem:
            last = problem
    raise last


def delays(retries: int, first: float, most: float) -> list[float]:
    """Pauses before the retries, without jitter."""
    return [min(first * 2**k, most) if first > 0 else most for k in range(retries)]


def fetch(url: str, agent: str = "lathe", retries: int = 3, first: float = 1.0, most: float = 30.0, timeout: float = 45.0, cap: int = 50 << 20, private: bool = False, sleep=time.sleep) -> tuple:
    """One row of FETCHED."""
    at, error = url, ""
    for pause in [0.0, *delays(retries, first, most)]:
        if pause:
            sleep(pause * random.uniform(0.9, 1.1))
        try:
            for _ in range(REDIRECTS + 1):
                status, kind, body = get(at, agent, timeout, cap, private)
                if not 300 <= status < 400 or not kind.startswith("http"):
                    break
                at = kind
            if status >= 500 or status == 429:
                error = f"status {status} "
                continue
            if not 200 <= status < 300:
                return url, at, status, kind, None, f"status {status} "
            if len(body) > cap:
                return url, at, status, kind, None, "body exceeds the limit"
            return url, at, status, kind, body.decode("utf-8", "replace"), None
        except Blocked as problem:
            return url, at, None, None, None, str(problem)
        except (OSError, http.client.HTTPException) as problem:
            error = str(problem)
    return url, at, None, None, None, f"retries exhausted: {error}"


class HostPartition(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        hosts: dict[str, list[str]] = {}
        for url in self.options.get("urls", "").split("\n"):
            if url:
                hosts.setdefault(urlsplit(url).netloc.lower(), []).append(url)
        return [HostPartition(u) for _, u in sorted(hosts.items())]

    def read(self, partition: InputPartition):
        o = self.options
        delay = float(o.get("delay", "0.5"))
        for k, url in enumerate(partition.urls):  # type: ignore[attr-defined]
            if k and delay > 0:
                time.sleep(delay * random.uniform(0.9, 1.1))
            yield fetch(url, o.get("agent", "lathe"), int(o.get("retries", "3")), float(o.get("first", "1")), float(o.get("most", "30")), float(o.get("timeout", "45")), int(o.get("cap", str(50 << 20))), o.get("private", "false") == "true")


class PageSource(DataSource):
    """``spark.read.format("web_pages").option("urls", ...)``: one partition per host."""

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> DataSourceReader:
        return PageReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)


def category(status: int | None, error: str | None, content_type: str) -> str | None:
    """Category of a fetch's outcome for a page, by the rules of ``functions.errors``."""
    if error is None:
        kind = content_type.lower()
        refused = kind.startswith(("image/", "audio/", "video/", "font/", "application/zip", "application/gzip", "application/pdf", "application/octet-stream"))
        return "Content_NonHTML" if refused else None
    if error.startswith("retries exhausted"):
        return "RetryFailed_Unknown"
    if "exceeds" in error:
        return "Network_BodyRead"
    if status is not None and 400 <= status < 500:
        return f"HTTP_{status}" if status in (401, 403, 404, 429) else "HTTP_4xx"
    return "HTTP_OtherStatus" if status is not None else "Unknown"


def fetcher(agent: str = "lathe", delay: float = 0.5, cap: int = 50 << 20, private: bool = False, **policy):
    """A ``crawl.Fetch`` over the network: a host's pages stay in one partition, so its delay holds without a lock.

    The crawl writes each level once before it uses it, so no page is fetched twice.
    """

    def run(frames):
        ready: dict[str, float] = {}
        for frame in frames:
            rows = []
            for url in frame["url"]:
                host = urlsplit(url).netloc.lower()
                pause = ready.get(host, 0.0) - time.monotonic()
                if pause > 0:
                    time.sleep(pause)
                ready[host] = time.monotonic() + delay * random.uniform(0.9, 1.1)
                _, final, status, kind, html, error = fetch(url, agent, cap=cap, private=private, **policy)
                what = category(status, error, kind or "")
                rows.append((url, final, html if what is None else None, what))
            yield pd.DataFrame(rows, columns=["url", "final_url", "html", "error_type"])

    def level(frontier: DataFrame) -> DataFrame:
        return frontier.select("url").repartition(F.lower(authority(F.col("url")))).mapInPandas(run, "url string, final_url string, html string, error_type string")

    return level
