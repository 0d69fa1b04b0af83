"""Text expressions: file names, hashes, Markdown structure, titles."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LONGEST_NAME = 100
BAD_CHARACTERS = r'[<>:"/\\|?*\x00-\x1F]'
#: Markdown link and picture targets; a link has a character before it that is no exclamation mark.
LINK = r"(?:^|[^!])\[([^\]]*)\]\(([^)]+)\)"
PICTURE = r"!\[([^\]]*)\]\(([^)]+)\)"
HEADING = r"(?md)^(#{1,6})\s+(.+)$"


def sanitize_text(name: str) -> str:
    """A safe file name of at most 100 bytes."""
    clean = re.sub("_+", "_", re.sub(BAD_CHARACTERS, "_", name)).strip("_ ")
    raw = clean.encode()
    if len(raw) > LONGEST_NAME:
        clean = raw[:LONGEST_NAME].decode(errors="ignore").strip("_ ")
    return clean if clean.strip(".") else "untitled"


def sanitize(name: Column) -> Column:
    """Native ``sanitize_text``.  The cut is at 100 bytes of UTF-8; half a character at the cut is dropped."""
    clean = F.regexp_replace(F.regexp_replace(name, BAD_CHARACTERS, "_"), "_+", "_")
    clean = F.regexp_replace(clean, "^[_ ]+|[_ ]+$", "")
    clean = F.when(F.octet_length(clean) > LONGEST_NAME, F.regexp_replace(_cut(clean), "^[_ ]+|[_ ]+$", "")).otherwise(clean)
    return F.when(F.regexp_replace(clean, r"^\.+", "") == "", "untitled").otherwise(clean)


def _cut(text: Column) -> Column:
    """The longest prefix of at most 100 bytes: characters are counted by their UTF-8 widths."""
    characters = F.split(F.substring(text, 1, LONGEST_NAME), "")
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("full"))

    def step(acc: Column, c: Column) -> Column:
        full = acc["full"] | (F.octet_length(acc["s"]) + F.octet_length(c) > LONGEST_NAME)
        return F.struct(F.when(full, acc["s"]).otherwise(F.concat(acc["s"], c)).alias("s"), full.alias("full"))

    return F.aggregate(characters, start, step)["s"]


def trimmed(text: Column) -> Column:
    """Without ASCII white space at either end."""
    return F.regexp_replace(text, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def content_hash(markdown: Column) -> Column:
    """Hash of a page's Markdown; '' for an empty body."""
    return F.when(F.coalesce(markdown, F.lit("")) == "", "").otherwise(F.sha2(markdown, 256))


def _found(markdown: Column, pattern: str) -> Column:
    items = F.filter(F.transform(F.regexp_extract_all(markdown, F.lit(pattern), F.lit(2)), trimmed), lambda x: x != "")
    return F.when(F.size(items) > 0, items)


def headings(markdown: Column) -> Column:
    """ATX headings in order; null if there are none."""
    return _found(markdown, HEADING)


def links(markdown: Column) -> Column:
    return _found(markdown, LINK)


def pictures(markdown: Column) -> Column:
    return _found(markdown, PICTURE)


def simple_title(html: Column) -> Column:
    """Native title of a page whose <title> holds plain text."""
    t = trimmed(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(t == "", "Untitled Page").otherwise(t)


def title_or_url(title: Column, url: Column) -> Column:
    t = trimmed(F.coalesce(title, F.lit("")))
    return F.when(t == "", url).otherwise(t)


def escape_link_text(text: Column) -> Column:
    """Backslashes and brackets escaped, line ends as spaces."""
    for old, new in (("\\", "\\\\"), ("[", "\\["), ("]", "\\]"), ("\n", " ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape_heading(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def log_level(name: Column) -> Column:
    """debug, info, warn or error; info for what is unknown."""
    level = F.lower(trimmed(name))
    return F.when(level == "warning", "warn").when(level.isin("debug", "info", "warn", "error"), level).otherwise("info")


def status_label(status: Column) -> Column:
    return F.when(F.coalesce(status, F.lit("")) == "", "unset").otherwise(status)


@F.pandas_udf(StringType())
def yaml_scalar(text: pd.Series) -> pd.Series:
    """A string as a YAML scalar, quoted only where it must be."""
    return pd.Series([None if t is None else yaml_text(t) for t in text], dtype=object)


_PLAIN = re.compile(r"^[A-Za-z0-9_./][^\x00-\x1f\x7f]*$")
_UNPRINTED = re.compile("[\x00-\x1f\x7f\x85\u2028\u2029\ufeff]")
_SPECIAL = re.compile(r"^(null|true|false|yes|no|on|off|y|n|~|[-+.]?[0-9][0-9a-fA-F_.,xXoO:+-]*|\.inf|\.nan)$", re.I)


def yaml_text(text: str) -> str:
    if _PLAIN.match(text) and not _SPECIAL.match(text) and ": " not in text and " #" not in text and text[-1] not in ": ":
        return text
    if _UNPRINTED.search(text):
        named = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r"}
        return '"' + "".join(named.get(c) or (f"\\u{ord(c):04x}" if _UNPRINTED.match(c) else c) for c in text) + '"'
    return "'" + text.replace("'", "''") + "'"
