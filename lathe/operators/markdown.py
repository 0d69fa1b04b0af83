"""HTML tree to Markdown with tables, task lists and strikethrough."""

from __future__ import annotations

import re

from lathe.operators.dom import Node

SKIPPED = frozenset("script style noscript template head iframe svg".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table ul #document".split())
_SPACE = re.compile(r"[ \t\n\r\f]+")
_ESCAPE = re.compile(r"([\\`*_\[\]])")


def inline(node: Node | str) -> str:
    if isinstance(node, str):
        return _ESCAPE.sub(r"\\\1", _SPACE.sub(" ", node))
    if node.tag in SKIPPED:
        return ""
    if node.tag == "br":
        return "  \n"
    if node.tag == "img":
        src = node.attrs.get("src", "").strip()
        return f"![{_SPACE.sub(' ', node.attrs.get('alt', '')).strip()}]({_target(src, node)})" if src else ""
    if node.tag in ("code", "kbd", "samp", "tt"):
        text = node.text()
        ticks = "`" * (max((len(m) for m in re.findall("`+", text)), default=0) + 1)
        pad = " " if text[:1] == "`" or text[-1:] == "`" else ""
        return f"{ticks}{pad}{_SPACE.sub(' ', text)}{pad}{ticks}" if text.strip() else ""
    if node.tag == "input" and node.attrs.get("type") == "checkbox":
        return "[x] " if "checked" in node.attrs else "[ ] "
    inner = "".join(map(inline, node.children))
    mark = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "strike": "~~"}.get(node.tag)
    if mark:
        return _wrap(inner, mark)
    if node.tag == "a" and "href" in node.attrs:
        label = _SPACE.sub(" ", inner).strip()
        return f"[{label}]({_target(node.attrs['href'].strip(), node)})" if label else ""
    return inner


def _target(url: str, node: Node) -> str:
    url = f"<{url}>" if re.search(r"[\s()]", url) else url
    title = node.attrs.get("title", "").replace('"', '\\"')
    return f'{url} "{title}"' if title else url


def _wrap(inner: str, mark: str) -> str:
    """Emphasis around the text, white space left outside."""
    core = inner.strip()
    if not core:
        return inner
    lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
    return f"{lead}{mark}{core}{mark}{tail}"


def blocks(node: Node) -> list[str]:
    """Markdown blocks of an element's content."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = "".join(run)
        run.clear()
        lines = [x.strip() for x in re.split(r"(?<=  )\n|\n", text)]
        text = "  \n".join(x for x in lines if x) if "  \n" in text else _SPACE.sub(" ", text).strip()
        if text.strip():
            out.append(re.sub(r"^(#{1,6}|[-+>]|\d+\.)(?= )", r"\\\1", text.strip()))

    for child in node.children:
        if isinstance(child, Node) and (child.tag in BLOCKS or _holds_block(child)):
            flush()
            out += block(child)
        else:
            run.append(inline(child))
    flush()
    return out


def _holds_block(node: Node) -> bool:
    return node.tag not in SKIPPED and any(n.tag in BLOCKS for n in node.walk())


def block(node: Node) -> list[str]:
    tag = node.tag
    if tag in SKIPPED:
        return []
    if re.fullmatch("h[1-6]", tag):
        text = _SPACE.sub(" ", "".join(map(inline, node.children))).strip()
        return [f"{'#' * int(tag[1])} {text}"] if text else []
    if tag == "hr":
        return ["---"]
    if tag == "pre":
        return [fenced(node)]
    if tag == "blockquote":
        inner = "\n\n".join(blocks(node))
        return ["\n".join(f"> {x}".rstrip() for x in inner.split("\n"))] if inner else []
    if tag in ("ul", "ol"):
        return [listing(node)] if any(isinstance(c, Node) and c.tag == "li" for c in node.children) else blocks(node)
    if tag == "table":
        return table(node)
    return blocks(node)


def fenced(node: Node) -> str:
    code = next((n for n in node.walk() if n.tag == "code"), node)
    named = next((c.split("-", 1)[1] for c in [*code.classes, *node.classes] if c.startswith(("language-", "lang-", "highlight-"))), "")
    text = node.text().strip("\n")
    fence = "`" * max(3, max((len(m) for m in re.findall("`+", text)), default=0) + 1)
    return f"{fence}{named}\n{text}\n{fence}"


def listing(node: Node) -> str:
    items = [c for c in node.children if isinstance(c, Node) and c.tag == "li"]
    first = node.attrs.get("start", "1")
    number = int(first) if re.fullmatch("[0-9]{1,9}", first) else 1
    out = []
    loose = any(isinstance(c, Node) and c.tag == "p" for i in items for c in i.children)
    for k, item in enumerate(items):
        mark = f"{number + k}. " if node.tag == "ol" else "- "
        parts = blocks(item) or [""]
        text = ("\n\n" if loose else "\n").join(parts)
        out.append(mark + text.replace("\n", "\n" + " " * len(mark)))
    return re.sub(r"(?m)^[ ]+$", "", ("\n\n" if loose else "\n").join(out))


def table(node: Node) -> list[str]:
    rows = [r for r in node.walk() if r.tag == "tr" and r.closest("table") is node]
    cells = [[c for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in rows]
    cells = [r for r in cells if r]
    if not cells:
        return blocks(node)
    text = lambda c: re.sub(r"(?<!\\)\|", r"\\|", _SPACE.sub(" ", "".join(map(inline, c.children))).strip())
    grid = [[text(c) for c in r] for r in cells]
    width = max(map(len, grid))
    grid = [r + [""] * (width - len(r)) for r in grid]
    aligned = {"left": ":--", "center": ":-:", "right": "--:"}
    marks = [aligned.get(c.attrs.get("align", "").lower(), "---") for c in cells[0]] + ["---"] * (width - len(cells[0]))
    line = lambda r: "| " + " | ".join(r) + " |"
    caption = next((n for n in node.walk() if n.tag == "caption"), None)
    head = [_SPACE.sub(" ", caption.text()).strip()] if caption is not None else []
    return [*[h for h in head if h], "\n".join([line(grid[0]), line(marks), *map(line, grid[1:])])]


def convert(node: Node) -> str:
    """Markdown of an element, '' if it holds no text."""
    return "\n\n".join(b for b in block(node) if b.strip()).strip()
