"""A small HTML tree on the standard library's tokenizer, with the selectors that page rules need."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of the keys closes an open element of the values, up to a scope border.
CLOSES = {
    **{t: ("p",) for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()},
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tbody": ("thead", "tbody", "tr", "td", "th"), "option": ("option",), "body": ("head",),
}
BORDER = frozenset("html body table td th ul ol dl div article section main nav blockquote figure".split())
FORMATTING = frozenset("a b big code em font i s small span strong u".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Node):
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def text(self) -> str:
        out: list[str] = []
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.children))
        return "".join(out)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def closest(self, tag: str) -> Node | None:
        at: Node | None = self
        while at is not None and at.tag != tag:
            at = at.parent
        return at

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def outer(self) -> str:
        out: list[str] = []
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                out.append(x[0])
            elif isinstance(x, str):
                out.append(html.escape(x, quote=False))
            else:
                out.append("<" + x.tag + "".join(f' {k}="{html.escape(v)}"' for k, v in x.attrs.items()) + ">")
                if x.tag not in VOID:
                    stack.append((f"</{x.tag}>",))
                    raw = x.tag in ("script", "style")
                    stack.extend((c,) if raw and isinstance(c, str) else c for c in reversed(x.children))
        return "".join(out)

    def copy(self) -> Node:
        return parse(self.outer()) if self.tag == "#document" else _first(parse_fragment(self.outer()), self.tag)


def _first(root: Node, tag: str) -> Node:
    return next((n for n in root.walk() if n.tag == tag), root)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body", "head"):
            seen = next((n for n in self.open if n.tag == tag), None)
            if seen is not None:
                for k, v in attrs:
                    seen.attrs.setdefault(k, v or "")
                return
        for _ in range(len(self.open)):
            hit = self._within(CLOSES.get(tag, ()))
            if not hit:
                break
            del self.open[hit:]
        node = Node(tag, {}, self.open[-1])
        for k, v in attrs:
            node.attrs.setdefault(k, v or "")
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def _within(self, tags: tuple[str, ...]) -> int:
        """Place of the innermost open element of ``tags`` that no border hides; 0 if there is none."""
        for i in range(len(self.open) - 1, 0, -1):
            t = self.open[i].tag
            if t in tags:
                return i
            if t in BORDER:
                return 0
        return 0

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if tag in FORMATTING and self.open[i].tag in BORDER:
                return

    def handle_data(self, data: str) -> None:
        kids = self.open[-1].children
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)


def parse_fragment(text: str) -> Node:
    builder = _Builder()
    builder.feed(text)
    builder.close()
    return builder.root


def parse(text: str) -> Node:
    """A document; a body is made up where the source has none, so that body selectors find what is there."""
    root = parse_fragment(text)
    if not any(n.tag == "body" for n in root.walk()):
        holder = next((n for n in root.children if isinstance(n, Node) and n.tag == "html"), root)
        body = Node("body", {}, holder)
        moved = [c for c in holder.children if not (isinstance(c, Node) and c.tag == "head")]
        holder.children = [c for c in holder.children if c not in moved]
        for c in moved:
            if isinstance(c, Node):
                c.parent = body
        body.children = moved
        holder.children.append(body)
    return root


def release(root: Node) -> None:
    """Take a tree apart that is done with: as parents and children name each other, its memory would wait for the collector."""
    stack = [root]
    while stack:
        node = stack.pop()
        stack.extend(c for c in node.children if isinstance(c, Node))
        node.children, node.parent = [], None


# --- selectors: type, .class, #id, [attr], [attr='v'], [attr*=], [attr^=], [attr$=], [attr~=], descendant, child, commas

_SIMPLE = re.compile(r"""([\w-]+|\*)|\.([\w-]+)|\#([\w-]+)|\[\s*([\w:-]+)\s*(?:([*^$~|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]""")


@lru_cache(maxsize=512)
def compiled(selector: str) -> tuple:
    """Alternatives, each a tuple of (combinator, simple tests) from left to right."""
    out = []
    for alternative in split_commas(selector):
        steps, combinator = [], " "
        for part in re.findall(r"""(?:\[[^\]]*\]|[^\s>\[])+|>""", alternative):
            if part == ">":
                combinator = ">"
                continue
            tests, at = [], 0
            while at < len(part):
                m = _SIMPLE.match(part, at)
                if not m:
                    raise ValueError(f"selector not supported: {alternative!r}")
                tag, cls, ident, attr, op, *values = m.groups()
                value = next((v for v in values if v is not None), "")
                tests.append(("tag", tag.lower(), "") if tag else ("class", cls, "") if cls else ("id", ident, "") if ident else ("attr" + (op or ""), attr.lower(), value))
                at = m.end()
            steps.append((combinator, tuple(tests)))
            combinator = " "
        if not steps:
            raise ValueError(f"empty selector in {selector!r}")
        out.append(tuple(steps))
    return tuple(out)


def split_commas(selector: str) -> list[str]:
    return [p.strip() for p in re.findall(r"(?:\[[^\]]*\]|[^,\[])+", selector) if p.strip()]


def _passes(node: Node, tests: tuple) -> bool:
    for kind, name, value in tests:
        if kind == "tag":
            if name != "*" and node.tag != name:
                return False
        elif kind == "class":
            if name not in node.classes:
                return False
        elif kind == "id":
            if node.attrs.get("id") != name:
                return False
        else:
            own, op = node.attrs.get(name), kind[4:]
            if own is None:
                return False
            good = {"": True, "=": own == value, "*=": bool(value) and value in own, "^=": bool(value) and own.startswith(value), "$=": bool(value) and own.endswith(value), "~=": value in own.split(), "|=": own == value or own.startswith(value + "-")}[op]
            if not good:
                return False
    return True


def _matches(node: Node, steps: tuple) -> bool:
    combinator, tests = steps[-1]
    if not _passes(node, tests):
        return False
    if len(steps) == 1:
        return True
    at = node.parent
    while at is not None and at.tag != "#document":
        if _matches(at, steps[:-1]):
            return True
        if combinator == ">":
            return False
        at = at.parent
    return False


def find(root: Node, selector: str) -> list[Node]:
    """Matching elements below ``root`` in document order."""
    alternatives = compiled(selector)
    return [n for n in root.walk() if any(_matches(n, steps) for steps in alternatives)]


def find_by_priority(root: Node, selector: str) -> Node | None:
    """First match of the first alternative that has one."""
    for part in split_commas(selector):
        found = find(root, part)
        if found:
            return found[0]
    return None
