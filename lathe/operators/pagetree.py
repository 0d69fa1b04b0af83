"""What is read off a page's tree: content region, title, anchors, pictures, framework, Markdown.

Each page is parsed once, inside one Arrow-fed function that returns a struct.
What comes in is read row by row from Arrow's memory and what goes out leaves in
pieces, so a worker holds a piece of results besides its input, whatever the
number of rows in a batch.  The rules themselves are plain functions over the tree.
"""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lathe.functions import urls
from lathe.operators import dom, markdown
from lathe.operators.dom import Node

#: (framework, attributes, classes (* at the end: prefix), script parts, page parts, content selector); the first hit wins.
FRAMEWORKS = [
    ("docusaurus", ["data-docusaurus", "data-docusaurus-root-container"], ["docusaurus-wrapper", "theme-doc-markdown"], [], ["__docusaurus", "docusaurus.io"], "article[class*='theme-doc'], .theme-doc-markdown, article.markdown, main article"),
    ("mkdocs", ["data-md-component", "data-md-color-scheme"], ["md-content", "md-main"], [], ["mkdocs", "material for mkdocs"], "article.md-content__inner, .md-content article, .md-content"),
    ("readthedocs", [], ["rst-content", "wy-nav-content"], ["readthedocs", "rtd"], ["readthedocs.org", "readthedocs.io", "sphinx-rtd-theme"], ".rst-content, div[role='main'], .document"),
    ("sphinx", [], ["sphinxsidebar", "sphinx-tabs"], ["searchindex.js", "_static/sphinx"], ["created using sphinx", "sphinx-doc.org", "_static/alabaster", "_static/pygments"], "div.body, article.bd-article, main.bd-main, div.document"),
    ("gitbook", [], ["gitbook*", "markdown-section"], [], ["gitbook", "gb-page"], "section.normal.markdown-section, .page-inner section, main[class*='gitbook']"),
]
#: Characters of pages, and rows, after which a piece of results leaves the worker.
PIECE, PIECE_ROWS = 1 << 20, 512
AUTO = ("auto", "AUTO", "Auto")
FALLBACK = "readability"


def framework_of(tree: Node) -> str | None:
    """First framework whose marks the page bears."""
    page = tree.outer().lower()
    nodes = list(tree.walk())
    attributes = {a for n in nodes for a in n.attrs}
    classes = {c for n in nodes for c in n.classes}
    sources = [n.attrs["src"] for n in nodes if n.tag == "script" and "src" in n.attrs]
    for name, marks, wanted, scripts, parts, _ in FRAMEWORKS:
        by_class = any(any(c.startswith(w[:-1]) for c in classes) if w.endswith("*") else w in classes for w in wanted)
        if not attributes.isdisjoint(marks) or by_class or any(s in src for s in scripts for src in sources) or any(p in page for p in parts):
            return name
    return None


def selector_of(framework: str | None) -> str | None:
    return next((s for name, *_, s in FRAMEWORKS if name == framework), None)


def title_of(tree: Node, otherwise: str = "Untitled Page") -> str:
    node = next((n for n in tree.walk() if n.tag == "title"), None)
    return (node.text().strip() if node is not None else "") or otherwise


def readable(tree: Node) -> Node | None:
    """The element that holds most of the running text: paragraphs vote for their parents, links count against them."""
    scores: dict[int, tuple[float, Node]] = {}
    for n in tree.walk():
        if n.tag not in ("p", "pre", "td", "blockquote", "li") or any(a.tag in ("nav", "footer", "aside", "header") for a in _above(n)):
            continue
        text = n.text().strip()
        if len(text) < 25:
            continue
        linked = sum(len(a.text()) for a in n.walk() if a.tag == "a")
        value = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - min(1.0, linked / len(text)))
        for depth, holder in enumerate(list(_above(n))[:2]):
            if holder.tag in ("#document", "html"):
                break
            bonus = 5.0 if id(holder) not in scores and holder.tag in ("article", "main", "div", "section") else 0.0
            old = scores.get(id(holder), (0.0, holder))[0]
            scores[id(holder)] = (old + bonus + value / (depth + 1), holder)
    if scores:
        return max(scores.values(), key=lambda x: x[0])[1]
    body = next((n for n in tree.walk() if n.tag == "body"), None)
    return body if body is not None and body.text().strip() else None


def _above(node: Node) -> Iterator[Node]:
    at = node.parent
    while at is not None:
        yield at
        at = at.parent


def content_of(tree: Node, selector: str, framework: str | None) -> tuple[Node | None, str | None]:
    """(content region, failure).  ``auto`` uses the site's framework and falls back to the readable part."""
    if selector in AUTO:
        known = selector_of(framework)
        found = dom.find_by_priority(tree, known) if known else None
        found = found or readable(tree)
    else:
        found = dom.find_by_priority(tree, selector)
    return (found, None) if found is not None else (None, "Content_SelectorNotFound")


def anchors_of(tree: Node, selectors: list[str]) -> list[tuple[str, str]]:
    """(href, rel) of the anchors below any of the selectors."""
    seen: set[int] = set()
    out = []
    for selector in selectors or ["body"]:
        for region in dom.find(tree, selector):
            for a in region.walk():
                if a.tag == "a" and a.attrs.get("href") and id(a) not in seen:
                    seen.add(id(a))
                    out.append((a.attrs["href"], a.attrs.get("rel", "")))
    return out


def pictures_of(region: Node) -> list[tuple[str | None, str]]:
    """(src, caption) of the pictures: the figure's caption, else the alternative text."""
    out = []
    for img in region.walk():
        if img.tag == "img":
            figure = img.closest("figure")
            note = next((n.text().strip() for n in figure.walk() if n.tag == "figcaption"), "") if figure is not None else ""
            out.append((img.attrs.get("src"), note or img.attrs.get("alt", "").strip()))
    return out


def clean(region: Node) -> None:
    """Take out what frameworks add to headings and pages."""
    gone = dom.find(region, "a.headerlink, a.edit-on-github, a.permalink, a[title='Permalink to this heading'], a[title='Link to this heading']")
    for a in region.walk():
        if a.tag == "a":
            text = a.text().strip()
            if text in ("¶", "#") or (not text and a.attrs.get("href", "").startswith("#")):
                gone.append(a)
    for a in gone:
        a.remove()


def rewrite_links(region: Node, url: str, domain: str, prefix: str, root: str) -> int:
    """Point links inside the site at the output files."""
    own = urls.output_path_text(url, domain, prefix, root)
    count = 0
    for a in region.walk() if own else ():
        href = a.attrs.get("href", "") if a.tag == "a" else ""
        if not href or href.startswith(("#", "//")) or ":" in href.split("/", 1)[0]:
            continue
        target = urls.resolve_text(url, href)
        file = urls.output_path_text(target, domain, prefix, root) if target else None
        if file:
            a.attrs["href"] = urls.relative_path(own, file, urlsplit(target).fragment)
            count += 1
    return count


def place_pictures(region: Node, url: str, found: dict[str, tuple[str, str]], own_file: str, root: str, statuses: dict[str, str]) -> dict[str, int]:
    """Rewrite, remove or leave picture tags; ``found`` maps absolute URLs to (local path, caption)."""
    tally = {"rewrite": 0, "remove": 0, "leave": 0}
    for img in [n for n in region.walk() if n.tag == "img"]:
        src = img.attrs.get("src", "")
        absolute = urls.resolve_text(url, src) if src else None
        status = statuses.get(src, "skipped-config")
        path, note = found.get(absolute or "", ("", ""))
        if status in ("success", "pending-download") and path:
            img.attrs["src"] = posixpath.relpath(posixpath.join(root, path), posixpath.dirname(own_file))
            img.attrs.pop("alt", None)
            if note:
                img.attrs["alt"] = note
            tally["rewrite"] += 1
        elif status in ("success", "pending-download", "error-parse", "error-normalize", "error-db", "error-filesystem"):
            img.remove()
            tally["remove"] += 1
        else:
            tally["leave"] += 1
    return tally


FACTS = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("content_html", T.StringType()),
        T.StructField("region_hash", T.StringType()),
        T.StructField("anchors", T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("rel", T.StringType())]))),
        T.StructField("pictures", T.ArrayType(T.StructType([T.StructField("src", T.StringType()), T.StructField("caption", T.StringType())]))),
        T.StructField("error_type", T.StringType()),
    ]
)


def in_pieces(batches: Iterator[tuple[pa.Array, ...]], kind: pa.DataType, of: Callable) -> Iterator[pa.Array]:
    """``of`` of every row of ``batches``, as arrays of at most ``PIECE_ROWS`` rows or some ``PIECE`` characters of the first column."""
    for columns in batches:
        rows, held = [], 0
        for scalars in zip(*columns):
            values = [x.as_py() for x in scalars]
            rows.append(of(*values))
            held += len(values[0] or "")
            if held >= PIECE or len(rows) >= PIECE_ROWS:
                yield pa.array(rows, kind)
                rows, held = [], 0
        if rows:
            yield pa.array(rows, kind)


def facts_of(text: str | None, name: str | None, selector: str, link_selectors: list[str]) -> dict:
    """FACTS of one page."""
    if text is None:
        return dict(zip(FACTS.names, (None, None, None, [], [], "Content_ParsingHTML")))
    tree = dom.parse(text)
    region, failure = content_of(tree, selector, name)
    outer = region.outer() if region is not None else None
    found = (
        title_of(tree), outer, hashlib.sha256(outer.encode("utf-8", "surrogatepass")).hexdigest() if outer is not None else None,
        [{"href": h, "rel": r} for h, r in anchors_of(tree, link_selectors)], [{"src": s, "caption": c} for s, c in pictures_of(region)] if region is not None else [], failure,
    )
    dom.release(tree)
    return dict(zip(FACTS.names, found))


def facts_udf(selector: str, link_selectors: list[str] | None = None):
    """Arrow-fed function (html, framework) -> FACTS; one parse per page."""

    @F.arrow_udf(FACTS)
    def facts(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return in_pieces(batches, to_arrow_type(FACTS), lambda text, name: facts_of(text, name, selector, link_selectors or []))

    return facts


def _framework_of_text(text: str | None) -> str | None:
    if text is None:
        return None
    tree = dom.parse(text)
    name = framework_of(tree)
    dom.release(tree)
    return name


@F.arrow_udf(T.StringType())
def framework(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return in_pieces(((page,) for page in pages), pa.string(), _framework_of_text)


def markdown_udf(domain: str, prefix: str, root: str):
    """Arrow-fed function (content_html, url) -> Markdown with local links and without framework noise."""

    def one(text: str | None, own: str) -> str | None:
        if text is None:
            return None
        tree = dom.parse_fragment(text)
        rewrite_links(tree, own, domain, prefix, root)
        clean(tree)
        content = markdown.convert(tree)
        dom.release(tree)
        return content

    @F.arrow_udf(T.StringType())
    def to_markdown(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return in_pieces(batches, pa.string(), one)

    return to_markdown


def detect(pages: DataFrame, *ties: str) -> DataFrame:
    """(host, framework, selector): decided by each host's first page in the order of (depth, url, ``ties``).

    ``ties`` are columns that order pages of equal URLs.  A page without HTML
    decides only where no other does.  The representative is chosen by an
    aggregation over these keys only; one page per host is parsed.
    """
    host = urls.hostname(F.col("url"))
    depth = F.col("depth") if "depth" in pages.columns else F.lit(0)
    keyed = pages.select(host.alias("host"), F.struct(F.col("html").isNull().alias("bare"), depth.alias("depth"), "url", *ties).alias("_place"), "html")
    first = keyed.groupBy("host").agg(F.min("_place").alias("_place"))
    chosen = keyed.join(first, ["host", "_place"]).groupBy("host").agg(F.max("html").alias("html"))
    named = F.create_map(*[F.lit(x) for name, *_, s in FRAMEWORKS for x in (name, s)])
    found = chosen.select("host", framework("html").alias("framework"))
    return found.select("host", "framework", F.coalesce(named[F.col("framework")], F.lit("")).alias("selector"), F.col("framework").isNull().alias("fallback"))


