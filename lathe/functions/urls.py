"""URL expressions.  All are native columns except reference resolution and output paths with dot segments."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence
from urllib.parse import quote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lathe.functions.text import sanitize, sanitize_text

RESOURCE_EXTENSIONS = tuple(
    "." + e
    for e in (
        "svg png jpg jpeg gif webp ico bmp tiff avif "  # pictures
        "woff woff2 ttf eot otf "  # fonts
        "css js mjs "  # code
        "pdf zip tar gz tgz "  # archives
        "mp4 mp3 wav ogg webm"  # media
    ).split()
)


def _part(url: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(url, pattern, group)


def scheme(url: Column) -> Column:
    """Scheme in lower case, '' if there is none."""
    return F.lower(_part(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):"))


def authority(url: Column) -> Column:
    """Host and port as written, without user information."""
    return _part(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)")


def hostname(url: Column) -> Column:
    """Host as written, without the port."""
    return F.regexp_replace(authority(url), r":[0-9]*$", "")


def path(url: Column) -> Column:
    return _part(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)")


def fragment(url: Column) -> Column:
    return _part(url, r"#(.*)$")


def normalize(url: Column) -> Column:
    """Identity of a page: scheme and host in lower case, no default port, query or fragment, one trailing slash less.

    Null for what has no scheme or no host.
    """
    s, a = scheme(url), F.lower(authority(url))
    default = F.when(s == "http", ":80").when(s == "https", ":443").otherwise(":none")
    host = F.when(a.endswith(default), F.regexp_replace(a, r":(80|443)$", "")).otherwise(a)
    p = path(url)
    p = F.when(p == "", "/").when((F.length(p) > 1) & p.endswith("/"), F.regexp_replace(p, "/$", "")).otherwise(p)
    return F.when((s != "") & (a != ""), F.concat(s, F.lit("://"), host, p))


def in_scope(url: Column, domain: Column | str, prefix: str = "/", disallowed: Sequence[str] = ()) -> Column:
    """http(s), on the domain (case matters), below the path prefix, and no disallowed pattern found in the path."""
    p = path(url)
    shown = F.when(p == "", "/").otherwise(p)
    domain = F.lit(domain) if isinstance(domain, str) else domain
    found = scheme(url).isin("http", "https") & (hostname(url) == domain) & shown.startswith(prefix)
    for pattern in disallowed:
        if pattern:
            found = found & ~p.rlike(pattern)
    return found


def extension(url_path: Column) -> Column:
    """From the last dot of the last segment on, in lower case; '' without a dot."""
    return F.lower(_part(url_path, r"(\.[^./]*)$"))


def is_resource(url: Column) -> Column:
    return extension(path(url)).isin(*RESOURCE_EXTENSIONS)


def is_nofollow(rel: Column) -> Column:
    return F.coalesce(F.contains(F.lower(rel), F.lit("nofollow")), F.lit(False))


def domain_matches(host: Column, pattern: Column) -> Column:
    """Equality without case; ``*.x`` stands for x and all below it."""
    h, p = F.lower(host), F.lower(pattern)
    rest = F.substring(p, 2, 100_000)
    return F.when(p.startswith("*."), h.endswith(rest) | ((F.length(rest) > 1) & (h == F.substring(rest, 2, 100_000)))).otherwise(h == p)


def domain_allowed(host: Column, allowed: Sequence[str], denied: Sequence[str]) -> Column:
    """Denied patterns first; an empty list of allowed ones allows all."""
    hit = lambda patterns: F.exists(F.array(*map(F.lit, patterns)), lambda p: domain_matches(host, p)) if patterns else F.lit(False)
    return ~hit(denied) & (hit(allowed) if allowed else F.lit(True))


def rewrite_eligible(href: Column) -> Column:
    """Whether a link may be turned into a relative path: not empty, local to the page, host-relative or of another scheme."""
    colon, slash = F.instr(href, ":"), F.instr(href, "/")
    other = (colon > 0) & ((slash == 0) | (colon < slash))
    return F.coalesce((href != "") & ~href.startswith("#") & ~href.startswith("//") & ~other, F.lit(False))


def resolve_text(base: str, href: str) -> str | None:
    """Absolute URL of ``href`` on the page ``base``, other characters percent-encoded; null if it cannot be parsed."""
    try:
        joined = urljoin(base, href.strip())
        urlsplit(joined)
    except ValueError:
        return None
    return quote(joined, safe="%/:?#[]@!$&'()*+,;=~-._")


@F.pandas_udf(StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or h is None else resolve_text(b, h) for b, h in zip(base, href)], dtype=object)


def resolve_rooted(base: Column, href: Column) -> Column:
    """Native form of ``resolve`` for hrefs that begin with a single slash and have no dot segments."""
    safe = r"[A-Za-z0-9%/:?#\[\]@!$&'()*+,;=~._-]"
    coded = F.array_join(F.transform(F.split(href, ""), lambda c: F.when(c.rlike(safe), c).otherwise(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")))), "")
    return F.concat(scheme(base), F.lit("://"), authority(base), F.when(href.rlike(f"^{safe}*$"), href).otherwise(coded))


def output_path(url: Column, domain: str, prefix: str, root: str) -> Column:
    """Markdown file below ``root`` for a page; null out of scope.

    Native: segments are sanitized, which leaves no dot segments, so the result
    cannot leave ``root``.
    """
    p = path(url)
    shown = F.when(p == "", "/").otherwise(p)
    bare = F.regexp_replace(shown, "/$", "")
    bare = F.when(bare == "", "/").otherwise(bare)
    rest = F.when(bare.startswith(prefix), F.substring(bare, len(prefix) + 1, 100_000)).otherwise(bare)
    rest = F.regexp_replace(rest, "^/", "")
    parts = F.filter(F.split(rest, "/"), lambda x: x != "")
    last = F.element_at(parts, -1)
    suffix = F.regexp_extract(last, r"(\.[^.]*)$", 1)
    file_like = F.length(suffix) > 1
    stem = F.regexp_replace(last, r"\.[^.]*$", "")
    clean = lambda xs: F.transform(xs, sanitize)
    named = F.concat(clean(F.slice(parts, F.lit(1), F.size(parts) - 1)), F.array(F.concat(sanitize(stem), F.lit(".md"))))
    indexed = F.concat(clean(parts), F.array(F.lit("index.md")))
    inner = F.when(F.size(parts) == 0, F.array(F.lit("index.md"))).when(file_like, named).otherwise(indexed)
    return F.when(in_scope(url, domain, prefix), F.concat(F.lit(root.rstrip("/") + "/"), F.array_join(inner, "/")))


def output_path_text(url: str, domain: str, prefix: str, root: str) -> str | None:
    """``output_path`` of one URL, for use inside page UDFs."""
    try:
        u = urlsplit(url)
        host = u.netloc.rpartition("@")[2].partition(":")[0]
    except ValueError:
        return None
    shown = u.path or "/"
    if u.scheme not in ("http", "https") or host != domain or not shown.startswith(prefix):
        return None
    bare = shown.removesuffix("/") or "/"
    parts = [x for x in bare.removeprefix(prefix).removeprefix("/").split("/") if x]
    out = ["index.md"]
    if parts:
        stem, dot, ext = parts[-1].rpartition(".")
        out = [*map(sanitize_text, parts[:-1]), sanitize_text(stem) + ".md"] if dot and ext else [*map(sanitize_text, parts), "index.md"]
    return posixpath.join(root.rstrip("/"), *out)


def relative_path(source_file: str, target_file: str, mark: str = "") -> str:
    """Path from one output file to another, with the fragment put back."""
    return posixpath.relpath(target_file, posixpath.dirname(source_file) or ".") + (f"#{mark}" if mark else "")
