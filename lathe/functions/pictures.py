"""Rules for pictures on pages: tag status, what becomes of a tag, local file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lathe.functions import urls
from lathe.functions.text import sanitize

MIME_EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "image/svg+xml": ".svg", "image/bmp": ".bmp", "image/tiff": ".tiff", "image/avif": ".avif", "image/x-icon": ".ico", "image/vnd.microsoft.icon": ".ico"}
#: Types whose extension wins over the one in the URL.
STRONG = ("image/jpeg", "image/png", "image/gif", "image/webp", "image/svg+xml")


def tag_status(src: Column, absolute: Column, robots_ok: Column, known: Column, known_path: Column, skip: bool, allowed: list[str], denied: list[str]) -> Column:
    """Status of a picture tag; ``known`` and ``known_path`` come from the picture state."""
    if skip:
        return F.lit("skipped-config")
    return (
        F.when(F.coalesce(src, F.lit("")) == "", "skipped-empty-src")
        .when(src.startswith("data:"), "skipped-data-uri")
        .when(absolute.isNull(), "error-parse")
        .when(~urls.scheme(absolute).isin("http", "https"), "skipped-scheme")
        .when(~urls.domain_allowed(urls.hostname(absolute), allowed, denied), "skipped-domain")
        .when(~robots_ok, "skipped-robots")
        .when(urls.normalize(absolute).isNull(), "error-normalize")
        .when((known == "success") & (F.coalesce(known_path, F.lit("")) != ""), "success")
        .otherwise("pending-download")
    )


def disposition(status: Column, local_path: Column) -> Column:
    """rewrite, remove or leave."""
    fetched = status.isin("success", "pending-download")
    return F.when(fetched & (F.coalesce(local_path, F.lit("")) != ""), "rewrite").when(fetched | status.isin("error-parse", "error-normalize", "error-db", "error-filesystem"), "remove").otherwise("leave")


def local_name(absolute: Column, content_type: Column) -> Column:
    """Stem of the URL, eight digits of its hash, and an extension; null if there is no way to tell the extension."""
    last = F.regexp_extract(urls.path(absolute), r"([^/]*)/*$", 1)
    own = F.regexp_extract(last, r"(\.[^.]*)$", 1)
    stem = sanitize(F.regexp_replace(last, r"\.[^.]*$", ""))
    mime = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    table = F.create_map(*[F.lit(x) for pair in MIME_EXTENSIONS.items() for x in pair])
    by_type = table[mime]
    ext = F.when(mime.isin(*STRONG), by_type).when(own != "", own).otherwise(by_type)
    return F.when(ext.isNotNull(), F.concat(stem, F.lit("_"), F.substring(F.sha2(absolute, 256), 1, 8), ext))


def caption(figcaption: Column, alt: Column) -> Column:
    first = F.trim(F.coalesce(figcaption, F.lit("")))
    return F.when(first != "", first).otherwise(F.trim(F.coalesce(alt, F.lit(""))))
