"""Main text of web pages by wrapper induction.

The DOM trees of a host's pages are aligned by simple tree matching into one template (``wrapper``):
every task folds its pages into a small template per host, and these are folded per host. A page is
then aligned with its host's template. A text that stands in one place on ``LEAST`` distinct pages or
more, and on ``SHARE`` of those that have the place, is template; copies of a page count as one page;
of the varying slots those go that by tag or class name are menus, page headers, footers, sidebars,
notices, adverts, forms, scripts, styles or reader comments, or that consist of links. The text of the
article is what is left of the largest ``article`` or ``main``, or of the densest part of the body.
Class names and the like are evidence only: what holds most of the page's varying text, or a landmark
outside of others, stays whatever its name, and names are not used if they would leave nothing.

Blocks are cut at block-level tags. Character references are decoded, white space inside a block
becomes one space, blocks are trimmed and joined by two ``\\n``. If constancy would leave nothing (a host
with copies of one page), it is not used. Null and empty pages have empty text; a page without host is
aligned with the others without host. Repeated pages give equal results; extra columns pass through.
"""

from __future__ import annotations

import json
import re
from collections.abc import Collection, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .registry import query
from .store import stored
from .url_filter import url_parts
from .wrapper import BLOCKS, ROUNDING, SHARE, Node, Slot, constant_nodes, merge, parse, placed, slots, weighted

LEAST = 4
HOSTS = 500  # templates that a task holds before it passes them on

DROPPED_TAGS = {
    "head", "script", "style", "noscript", "template", "iframe", "object", "embed", "svg", "canvas", "nav", "footer", "aside",
    "form", "button", "select", "input", "textarea", "label", "dialog", "menu", "title", "link", "meta", "audio", "video",
}
DROPPED_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adslot", "adsense", "sponsor", "sponsored", "promo",
    "promotion", "banner", "menu", "nav", "navbar", "navigation", "topnav", "subnav", "breadcrumb", "breadcrumbs", "sidebar",
    "side", "rail", "aside", "footer", "foot", "masthead", "topbar", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "search",
    "share", "sharing", "social", "related", "recommended", "recommendations", "trending", "comment", "comments", "commentlist",
    "respond", "reply", "replies", "disqus", "discussion", "widget", "widgets", "pagination", "pager", "toolbar", "skip", "hidden",
    "copyright", "legal", "disclaimer", "contentinfo", "complementary", "form", "tags", "byline",
}
# names that a layout may bear for one of its parts, as in "with-sidebar"
LAYOUT_NAMES = {"sidebar", "side", "rail", "aside", "menu", "nav", "navbar", "footer", "foot", "widget", "widgets", "banner", "search"}
HEADER_NAMES = {"header", "head", "banner"}
NAME = re.compile(r"[a-z]+")
LINKS, LINK_SHARE = 3, 0.6


def _names(node: Node) -> set[str]:
    return set(NAME.findall(node.marks)) if node.marks else set()


def _landmark(node: Node, large: set[int]) -> bool:
    return node.tag in ("article", "main") and (id(node) in large or not _names(node) & DROPPED_NAMES)


def _hidden(node: Node) -> bool:
    return node.marks.endswith(" hidden")


class Measures:
    """Links of every node (if a page has ``LINKS`` at all), characters in links and of the trimmed text when asked for.

    All are found from the leaves up, in one pass over the page.
    """

    def __init__(self, root: Node):
        self.order = [root]  # parents first
        self.parent: dict[int, Node] = {}
        self.links: dict[int, int] = {}
        found = []
        for x in self.order:
            if x.tag == "a":
                found.append(x)
            for c in x.children:
                if c.__class__ is Node:
                    self.parent[id(c)] = x
                    self.order.append(c)
        if len(found) >= LINKS:
            self.links = {id(x): 1 for x in found}
            for x in reversed(self.order):
                n = self.links.get(id(x))
                if n and x is not root:
                    above = id(self.parent[id(x)])
                    self.links[above] = self.links.get(above, 0) + n
        self._sizes: dict[int, tuple[int, int]] | None = None

    def sizes(self, node: Node) -> tuple[int, int]:
        if self._sizes is None:
            self._sizes = {}
            spaces: dict[int, tuple[int, int, int]] = {}  # characters, white space before and behind
            for x in reversed(self.order):
                linked = size = lead = trail = 0
                for child in x.children:
                    if isinstance(child, str):
                        n, before, behind = len(child), len(child) - len(child.lstrip()), len(child) - len(child.rstrip())
                    else:
                        n, before, behind = spaces[id(child)]
                        linked += self._sizes[id(child)][0]
                    lead = size + before if lead == size else lead
                    trail = trail + n if behind == n else behind
                    size += n
                spaces[id(x)] = size, lead, trail
                self._sizes[id(x)] = linked + size * (x.tag == "a"), 0 if lead == size else size - lead - trail
        return self._sizes[id(node)]

    def holders(self, large: set[int]) -> set[int]:
        """ids of the nodes that are or hold a landmark."""
        out: set[int] = set()
        for x in self.order:
            if x.tag in ("article", "main") and _landmark(x, large):
                while x is not None and id(x) not in out:
                    out.add(id(x))
                    x = self.parent.get(id(x))
        return out


def _large(order: list[Node], constant: set[int]) -> set[int]:
    """ids of the nodes that hold most of the text that neither constancy nor tags exclude."""
    kept, todo = [], [order[0]]
    while todo:
        x = todo.pop()
        kept.append(x)
        todo.extend(c for c in x.nodes() if id(c) not in constant and c.tag not in DROPPED_TAGS and not _hidden(c))
    size = _kept_sizes(kept, ())
    return {i for i, n in size.items() if 2 * n > size[id(order[0])]}


def named(node: Node, in_article: bool) -> bool:
    """Whether names show that the node is no main text."""
    if node.tag in ("html", "body", "#root"):
        return False
    names = _names(node)
    if names & HEADER_NAMES:
        return not in_article  # the header of an article holds its title
    return bool(names & DROPPED_NAMES)


def boilerplate(node: Node, in_article: bool, holders: set[int], measures: Measures) -> bool:
    """Whether tag or links show that the node is no main text."""
    if node.tag in DROPPED_TAGS or _hidden(node):
        return True
    if node.tag in ("html", "body", "#root"):
        return False
    if node.tag == "header":
        return not in_article and id(node) not in holders
    if node.tag in ("ul", "ol", "dl", "div", "section", "table", "p", "span") and id(node) not in holders:
        if measures.links.get(id(node), 0) >= LINKS:
            linked, size = measures.sizes(node)
            return linked > LINK_SHARE * size
    return False


def _kept_sizes(order: list[Node], dropped: Collection[int]) -> dict[int, int]:
    """Characters in every node outside of dropped ones; nodes that are not in ``order`` count nothing."""
    size: dict[int, int] = {}
    for x in reversed(order):
        if id(x) not in dropped:
            size[id(x)] = sum([len(c.strip()) if c.__class__ is str else size.get(id(c), 0) for c in x.children])
    return size


def _find_dropped(measures: Measures, constant: set[int], names: bool, large: set[int]) -> tuple[set[int], set[int]]:
    """ids of the dropped nodes, and of landmarks that stand in a part with a suspicious name."""
    dropped, suspect = set(constant), set()
    holders = measures.holders(large)
    todo = [(measures.order[0], False, False)]
    while todo:
        node, inside, doubt = todo.pop()
        if id(node) in dropped:
            continue
        if boilerplate(node, inside, holders, measures):
            dropped.add(id(node))
            continue
        if names and id(node) not in large and named(node, inside):
            only_layout = not _names(node) & DROPPED_NAMES - LAYOUT_NAMES
            if inside and not only_layout or not any(id(c) in holders for c in node.nodes()):
                dropped.add(id(node))
                continue
            doubt = doubt or not only_layout
        landmark = _landmark(node, large)
        if landmark and doubt and id(node) not in large:
            suspect.add(id(node))
        inside = inside or landmark
        todo.extend((c, inside, doubt) for c in node.nodes())
    return dropped, suspect


def content_root(order: list[Node], dropped: set[int], suspect: set[int], large: set[int]) -> Node:
    """The largest article, else the largest main part, else the densest part of the page."""
    root, kept = order[0], _kept_sizes(order, dropped)
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [root]
    while todo:
        node = todo.pop()
        if id(node) in dropped:
            continue
        if _landmark(node, large):
            found[node.tag].append(node)
        todo.extend(reversed(node.nodes()))
    for doubt in (False, True):
        for tag in ("article", "main"):
            given = [n for n in found[tag] if (id(n) in suspect) == doubt]
            best = max(given, key=lambda n: kept.get(id(n), 0), default=None)
            if best and kept.get(id(best), 0):
                return best
    node = root
    while True:
        inner = [c for c in node.nodes() if id(c) not in dropped and c.tag in BLOCKS and c.tag not in ("p", "li", "td", "pre")]
        best = max(inner, key=lambda n: kept.get(id(n), 0), default=None)
        if best is None or kept.get(id(best), 0) < 0.8 * kept.get(id(node), 0) or best.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            return node
        node = best


def blocks_of(node: Node, dropped: set[int]) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        elif id(x) not in dropped:
            if x.tag == "br":
                line.append(" ")
            elif x.tag in BLOCKS:
                end()
                todo.append(None)
            todo.extend(reversed(x.children))
    end()
    return out


@lru_cache(maxsize=256)
def _template(text: str) -> Slot:
    return Slot.load(json.loads(text))


def main_text(page: str | None, template: str | None, host: str | None = None, repeated: frozenset[tuple[int, int]] = frozenset()) -> str:
    """Text of a page, given its host's template and its constant (path, text hash) pairs."""
    if not page:
        return ""
    root = parse(page)
    constant = constant_nodes(slots(root, keep=True), _template(template), LEAST) if template else set()
    if repeated:
        constant |= {id(node) for path, text, node in placed(root, host) if (path, text) in repeated}
    measures = Measures(root)
    order = measures.order
    for names in (True, False):
        for drop in (constant, set()) if constant else (set(),):
            large = _large(order, drop)
            dropped, suspect = _find_dropped(measures, drop, names, large)
            found = blocks_of(content_root(order, dropped, suspect, large), dropped)
            if found:
                return "\n\n".join(found)
    return ""


PARTS = "host string, template string, host_key bigint, path bigint, text bigint, n double"


def _part_rows(**columns: list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    types = {"host": pa.string(), "template": pa.string(), "host_key": pa.int64(), "path": pa.int64(), "text": pa.int64(), "n": pa.float64()}
    return pa.record_batch({c: pa.array(columns.get(c, [None] * n), t) for c, t in types.items()})


def page_parts(pages: DataFrame) -> DataFrame:
    """Templates of parts of a host's pages, and the pages of each path and text, from (host, host_key, html, n_copies).

    A page is parsed once for both. Equal rows are combined before the shuffle: ``n`` counts equal
    templates, or sums the shares of the pages with (path, text); a null text stands for all of the path's
    pages. Pairs on fewer than ``LEAST`` pages prove nothing and are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Slot] = {}
        for batch in batches:
            keys, paths, texts, parts = [], [], [], []
            for key, host, page, n in zip(*(batch.column(c).to_pylist() for c in ("host_key", "host", "html", "n_copies"))):
                if not page:
                    continue
                root = parse(page)
                slot = weighted(slots(root), 1 / n)
                held[host] = merge(held[host], slot) if host in held else slot
                found = {(path, text) for path, text, _ in placed(root, host)}
                found |= {(path, None) for path, _ in found}  # the pages of the path
                for path, text in found:
                    keys.append(key)
                    paths.append(path)
                    texts.append(text)
                    parts.append(1 / n)
                if len(held) >= HOSTS:
                    yield _template_rows(held)
                    held = {}
            yield _part_rows(host_key=keys, path=paths, text=texts, n=parts)
        if held:
            yield _template_rows(held)

    given = pages.select("host_key", "host", "html", "n_copies").mapInArrow(run, PARTS)
    whole = given.groupBy("host", "template", "host_key", "path", "text").agg(F.sum("n").alias("n"))
    return whole.where(F.col("template").isNotNull() | (F.col("n") >= LEAST - ROUNDING))


def unite_templates(parts: DataFrame) -> DataFrame:
    """(host, template) of the whole hosts."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, whole = None, None
        for batch in batches:
            for own, text, n in zip(*(batch.column(c).to_pylist() for c in ("host", "template", "n"))):
                for _ in range(round(n)):
                    slot = Slot.load(json.loads(text))
                    if whole and own == host:
                        whole = merge(whole, slot)
                        continue
                    if whole:
                        yield _rows({host: whole.prune(LEAST)})
                    host, whole = own, slot
        if whole:
            yield _rows({host: whole.prune(LEAST)})

    given = parts.where("template is not null").select("host", "template", "n")
    return given.repartition("host").sortWithinPartitions("host", "template").mapInArrow(unite, "host string, template string")


def constant_paths(parts: DataFrame) -> DataFrame:
    """(host_key, paths, texts): what stands on ``LEAST`` pages and ``SHARE`` of a path's pages."""
    counts = parts.where("template is null")
    whole = counts.where("text is null").select("host_key", "path", F.col("n").alias("whole"))
    often = counts.where("text is not null").join(whole, ["host_key", "path"]).where(F.col("n") >= SHARE * F.col("whole") - ROUNDING)
    return often.groupBy("host_key").agg(F.collect_list("path").alias("paths"), F.collect_list("text").alias("texts"))


def _rows(held: dict[str, Slot]) -> pa.RecordBatch:
    return pa.record_batch({"host": pa.array(held, pa.string()), "template": pa.array([json.dumps(s.dump()) for s in held.values()], pa.string())})


def _template_rows(held: dict[str, Slot]) -> pa.RecordBatch:
    return _part_rows(host=list(held), template=[json.dumps(s.dump()) for s in held.values()], n=[1.0] * len(held))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """The rows with ``text`` and ``n_chars`` in place of ``html`` (needs url and html); columns of any other name pass."""
    host = url_parts(F.col("url"))[0]
    keyed = pages.select(host.alias("host"), "html").withColumns(
        {"h": F.xxhash64("host", "html"), "g": F.xxhash64(F.lit("second"), F.col("host"), F.col("html"))})
    copies = stored(keyed.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1"), "copies")
    distinct = keyed.join(copies, ["h", "g"], "left").select(
        "host", F.xxhash64("host").alias("host_key"), "html", F.coalesce("n", F.lit(1)).alias("n_copies"))
    parts = stored(page_parts(distinct), "parts")
    templates = stored(unite_templates(parts), "templates")
    constants = stored(constant_paths(parts), "constants")
    rest = [F.col(f"`{c}`") for c in pages.columns if c not in ("html", "text", "n_chars")]
    given = pages.select(F.struct(*rest).alias("row"), "html", host.alias("host"), F.xxhash64(host).alias("host_key"))
    given = given.join(templates, "host", "left").join(constants, "host_key", "left").drop("host_key")
    out = StructType([given.schema["row"], StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, last, repeated = [], None, frozenset()
            hosts, pages_, given_ = (batch.column(c).to_pylist() for c in ("host", "html", "template"))
            for i, (own, page, template) in enumerate(zip(hosts, pages_, given_)):
                if not i or own != last:
                    paths, values = batch.column("paths")[i].as_py(), batch.column("texts")[i].as_py()
                    last, repeated = own, frozenset(zip(paths or (), values or ()))
                texts.append(main_text(page, template, own, repeated))
            yield pa.record_batch({"row": batch.column("row"), "text": pa.array(texts, pa.string()),
                                   "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return given.mapInArrow(run, out).select("row.*", "text", "n_chars")


@query("op2_html_main_text")
def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
