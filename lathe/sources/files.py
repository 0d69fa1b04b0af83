"""File sinks: the Markdown tree and fetched pictures, written by the executors."""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Callable
from urllib.parse import urlsplit

import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.functions.pictures import MIME_EXTENSIONS, STRONG
from lathe.functions.text import sanitize_text
from lathe.functions.urls import hostname
from lathe.sources import web

PICTURE_STATE = "url string, status string, local_path string, error_type string, size long"


def put(fs: pyarrow.fs.FileSystem, path: str, data: bytes) -> None:
    """A file that appears complete or not at all, however often its task runs."""
    fs.create_dir(posixpath.dirname(path))
    context = TaskContext.get()
    part = f"{path}.{context.taskAttemptId() if context else 0}.tmp"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def write_tree(rows: DataFrame, uri: str) -> DataFrame:
    """Write (path, text) rows below ``uri``; gives (path, bytes).  Paths that would leave it raise an error."""

    def run(frames):
        fs, root = pyarrow.fs.FileSystem.from_uri(uri)
        for frame in frames:
            sizes = []
            for path, text in zip(frame["path"], frame["text"]):
                full = posixpath.normpath(posixpath.join(root, path))
                if not full.startswith(root.rstrip("/") + "/"):
                    raise ValueError(f"{path!r} leaves the output folder")
                data = text.encode("utf-8", "surrogatepass")
                put(fs, full, data)
                sizes.append(len(data))
            yield pd.DataFrame({"path": frame["path"], "bytes": sizes})

    return rows.select("path", "text").mapInPandas(run, "path string, bytes long")


def picture_name(url: str, content_type: str) -> str | None:
    """``functions.pictures.local_name`` of one URL."""
    last = urlsplit(url).path.rstrip("/").rpartition("/")[2]
    stem, dot, own = last.rpartition(".")
    own = dot + own if dot else ""
    mime = content_type.split(";")[0].strip().lower()
    ext = MIME_EXTENSIONS.get(mime) if mime in STRONG or not own else own
    return f"{sanitize_text(stem if dot else last)}_{hashlib.sha256(url.encode()).hexdigest()[:8]}{ext}" if ext else None


def verdict(declared: int | None, received: int, most: int) -> bool:
    """Whether a picture fits its limit (0: none); a body that just fills it needs a declared length that fits."""
    if most <= 0:
        return True
    if declared is not None and declared > most:
        return False
    return received < most or (received == most and declared is not None and 0 <= declared <= most)


def fetch_pictures(tasks: DataFrame, uri: str, most: int = 0, get: Callable[[str], tuple[int, str, bytes, int | None]] | None = None) -> DataFrame:
    """Fetch pictures (url) into ``uri``/images; gives the rows of their state.

    ``get`` gives (status, content type, body, declared length); the default
    goes to the network.  Tasks of one host share a partition.
    """

    def default(url: str) -> tuple[int, str, bytes, int | None]:
        status, kind, body = web.get(url, "lathe", 45.0, most or (1 << 30))
        return status, kind, body, len(body)

    fetch = get or default

    def one(fs, root: str, url: str) -> tuple:
        try:
            status, kind, body, declared = fetch(url)
        except OSError:
            return url, "failure", None, "RetryFailed_NetworkOther", None
        if not 200 <= status < 300:
            return url, "failure", None, web.category(status, f"status {status} ", kind), None
        name = picture_name(url, kind or "")
        if name is None:
            return url, "failure", None, "Content_ParsingOther", None
        if not verdict(declared, len(body), most):
            return url, "failure", None, "Filesystem_Other", None
        put(fs, f"{root}/images/{name}", body)
        return url, "success", f"images/{name}", None, len(body)

    def run(frames):
        fs, root = pyarrow.fs.FileSystem.from_uri(uri)
        for frame in frames:
            yield pd.DataFrame([one(fs, root, u) for u in frame["url"]], columns=["url", "status", "local_path", "error_type", "size"])

    return tasks.select("url").distinct().repartition(F.lower(hostname(F.col("url")))).mapInPandas(run, PICTURE_STATE)
