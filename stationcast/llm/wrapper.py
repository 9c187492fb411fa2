"""Wrapper induction: DOM trees of a host's pages, aligned by simple tree matching, give its template.

A template is a tree of node kinds (tag and class names); equal neighbours are one repeated node. Each
node counts the distinct pages that have it (a page with n copies counts 1/n each time) and the pages of
the commonest texts that stand in it, by hash. A text on enough pages and on ``SHARE`` of the node's
pages is constant. Repeated neighbours, and nodes beyond ``MAX_DEPTH`` or ``MAX_CHILDREN``, have no slot of
their own; for them the pages of each path (kinds from the root on) and text are counted (``placed``).
"""

from __future__ import annotations

import hashlib
import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "xmp", "iframe"}
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr",
    "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul", "aside", "head",
}
CLOSES_P = BLOCKS - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
# an open tag that one of these ends: tag -> tags that it closes, up to a container
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass(slots=True)
class Node:
    tag: str
    marks: str = ""  # class, id and role
    children: list = field(default_factory=list)  # nodes and texts in order

    def nodes(self) -> list[Node]:
        return [c for c in self.children if c.__class__ is not str]

    @property
    def kind(self) -> str:
        return f"{self.tag}.{self.marks}" if self.marks else self.tag


@lru_cache(maxsize=4096)
def attributes(text: str) -> str:
    """Class, id and role, lower-cased, digits removed."""
    if "=" not in text:
        return ""
    found = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), a or b or c)
    marks = " ".join(found[n] for n in ("class", "id", "role", "aria-label", "itemprop") if found.get(n))
    hidden = "hidden" in found or "none" in re.sub(r"\s", "", found.get("style", "")).lower().partition("display:")[2][:4]
    return re.sub(r"\d+", "", marks).lower() + (" hidden" if hidden else "")


def parse(text: str) -> Node:
    """Tree of a page; unknown, unclosed and crossing tags are taken as browsers mostly do."""
    root = Node("#root")
    stack = [root]
    at = 0
    scan = TOKEN.search
    while True:
        m = scan(text, at)
        raw = text[at:m.start()] if m else text[at:]
        if raw:
            stack[-1].children.append(html.unescape(raw) if "&" in raw else raw)
        if not m:
            return root
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            _close(stack, tag)
            continue
        _imply(stack, tag)
        node = Node(tag, attributes(m["rest"]))
        stack[-1].children.append(node)
        if tag in VOID or m["rest"].endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*/?>", re.I).search(text, at)
            body = text[at:end.start()] if end else text[at:]
            node.children.append(html.unescape(body) if tag in ("title", "textarea") else body)
            at = end.end() if end else len(text)
            continue
        stack.append(node)


def _close(stack: list[Node], tag: str) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag == tag:
            del stack[depth:]
            return
        if stack[depth].tag in ("table", "article", "body") and tag not in BLOCKS:
            return


def _imply(stack: list[Node], tag: str) -> None:
    if tag in CLOSES_P:
        # a block ends an open paragraph, with the inline tags that were left open in it
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag == "p":
                del stack[depth:]
                break
            if stack[depth].tag in BLOCKS:
                break
    ends, limit = IMPLIED.get(tag, ((), ()))
    for depth in range(len(stack) - 1, 0, -1) if ends else ():
        if stack[depth].tag in limit:
            break
        if stack[depth].tag in ends:
            del stack[depth:]
            break


def inner_text(node: Node) -> str:
    out = []
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo.extend(reversed(x.children))
    return "".join(out)


def _digest(parts: list[str]) -> str:
    """Hash of what stands in a node, empty if there is no text."""
    found = [p for p in parts if p]
    if not found:
        return ""
    return hashlib.blake2b("\0".join(found).encode(errors="replace"), digest_size=8).hexdigest()


@dataclass(slots=True)
class Slot:
    """Template node: pages that have it, the text hash they share ("*" once they differ), pages by text."""

    kind: str
    pages: float
    text: str
    children: list[Slot] = field(default_factory=list)
    nodes: list[Node] = field(default_factory=list)  # of a single page only
    texts: dict[str, float] | None = None  # None: all pages have ``text``

    def dump(self) -> list:
        return [self.kind, self.pages, self.text, [c.dump() for c in self.children], self.texts]

    @classmethod
    def load(cls, data: list) -> Slot:
        return cls(data[0], data[1], data[2], [cls.load(c) for c in data[3]], texts=data[4])

    def counts(self) -> dict[str, float]:
        return {self.text: self.pages} if self.texts is None else self.texts

    def constant(self, text: str, least: int) -> bool:
        n = self.counts().get(text, 0)
        return text not in ("*", "") and n >= least - ROUNDING and n >= SHARE * self.pages - ROUNDING

    def prune(self, least: int) -> Slot:
        """Forgets the texts that are not constant."""
        self.texts = {t: n for t, n in self.counts().items() if self.constant(t, least)}
        for child in self.children:
            child.prune(least)
        return self


SHARE = 0.5  # of the distinct pages with a node, those that must have one text in it
TEXTS = 16  # texts counted per node; a count is short by at most 1/17 of the node's pages
ROUNDING = 1e-6  # of sums of 1/n


def _counted(a: dict[str, float], b: dict[str, float]) -> dict[str, float]:
    """Sums of the commonest texts (Misra-Gries)."""
    out = dict(a)
    for text, n in b.items():
        out[text] = out.get(text, 0) + n
    if len(out) > TEXTS:
        less = sorted(out.values(), reverse=True)[TEXTS]
        out = {t: n - less for t, n in out.items() if n > less}
    return out


MAX_DEPTH = 24  # deeper nodes belong to the node at this depth


def slots(node: Node, depth: int = 0, keep: bool = False) -> Slot:
    """Template of one page: neighbours of one kind are merged to a repeated node."""
    out = Slot(node.kind, 1, "", nodes=[node] if keep else [])
    if depth >= MAX_DEPTH:
        out.text = _digest([" ".join(inner_text(node).split())])
        return out
    parts = []
    for child in node.children:
        if isinstance(child, str):
            parts.append(" ".join(child.split()))
            continue
        slot = slots(child, depth + 1, keep)
        parts.append(slot.text)
        if out.children and out.children[-1].kind == slot.kind:
            out.children[-1] = _repeated(out.children[-1], slot)
        else:
            out.children.append(slot)
    out.text = _digest(parts)
    return out


def _repeated(a: Slot, b: Slot) -> Slot:
    """Neighbours of one page as one node, whose text varies from place to place."""
    return _set_pages(merge(a, b), 1)


def _set_pages(slot: Slot, n: float) -> Slot:
    slot.pages, slot.texts = n, None
    for child in slot.children:
        _set_pages(child, n)
    return slot


def weighted(slot: Slot, pages: float) -> Slot:
    """Template of one page that counts as a part of a page."""
    return slot if pages == 1 else _set_pages(slot, pages)


def matching(a: list[Slot], b: list[Slot]) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: size of the largest order-keeping match of two forests, and its top pairs."""
    if not a or not b:
        return 0, []
    if [x.kind for x in a] == [x.kind for x in b] and len({x.kind for x in a}) == len(a):
        return sum(1 + matching(x.children, y.children)[0] for x, y in zip(a, b)), [(i, i) for i in range(len(a))]
    score = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best = max(score[i + 1][j], score[i][j + 1])
            if a[i].kind == b[j].kind:
                best = max(best, score[i + 1][j + 1] + 1 + matching(a[i].children, b[j].children)[0])
            score[i][j] = best
    pairs, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if score[i][j] == score[i + 1][j]:
            i += 1
        elif score[i][j] == score[i][j + 1]:
            j += 1
        else:
            pairs.append((i, j))
            i, j = i + 1, j + 1
    return score[0][0], pairs


def merge(a: Slot, b: Slot) -> Slot:
    """Union of two templates of one kind, aligned by tree matching."""
    out = Slot(a.kind, a.pages + b.pages, a.text if a.text == b.text else "*", nodes=a.nodes + b.nodes)
    if out.text == "*":
        out.texts = _counted(a.counts(), b.counts())
    _, pairs = matching(a.children, b.children)
    i = j = 0
    for x, y in [*pairs, (len(a.children), len(b.children))]:
        out.children += a.children[i:x] + b.children[j:y]
        if x < len(a.children) and y < len(b.children):
            out.children.append(merge(a.children[x], b.children[y]))
        i, j = x + 1, y + 1
    return _bounded(out)


MAX_CHILDREN = 64


def _bounded(slot: Slot) -> Slot:
    """A template node of many different children keeps the kinds apart but not their order."""
    if len(slot.children) > MAX_CHILDREN:
        kinds: dict[str, Slot] = {}
        for child in slot.children:
            if child.kind in kinds:
                pages = kinds[child.kind].pages + child.pages
                kinds[child.kind] = merge(kinds[child.kind], child)
                kinds[child.kind].pages = pages
            else:
                kinds[child.kind] = child
        slot.children = list(kinds.values())
    return slot


def constant_nodes(page: Slot, template: Slot, least: int) -> set[int]:
    """ids of the page's nodes whose text is constant in their place, on at least ``least`` pages."""
    out: set[int] = set()
    todo = [(page, template)]
    while todo:
        own, slot = todo.pop()
        if slot.constant(own.text, least):
            out.update(map(id, own.nodes))
            continue
        todo += [(own.children[i], slot.children[j]) for i, j in matching(own.children, slot.children)[1]]
    return out


@lru_cache(maxsize=65536)
def _path(above: bytes, kind: str) -> bytes:
    return hashlib.blake2b(above + b"\0" + kind.encode(errors="replace"), digest_size=8).digest()


def placed(root: Node, host: str | None) -> list[tuple[int, int, Node]]:
    """Path (kinds from the root on, hashed with the host) and text hash of all nodes with text, at any depth and place."""
    order: list[tuple[Node, bytes]] = []
    todo = [(root, repr(host).encode(errors="replace"))]
    while todo:
        node, above = todo.pop()
        path = _path(above, node.kind)
        order.append((node, path))
        todo.extend((c, path) for c in node.children if not isinstance(c, str))
    text: dict[int, bytes] = {}
    out = []
    for node, path in reversed(order):
        parts = [" ".join(c.split()).encode(errors="replace") if isinstance(c, str) else text[id(c)] for c in node.children]
        parts = [p for p in parts if p]
        own = text[id(node)] = hashlib.blake2b(b"\0".join(parts), digest_size=8).digest() if parts else b""
        if own:
            out.append((int.from_bytes(path, "little", signed=True), int.from_bytes(own, "little", signed=True), node))
    return out
