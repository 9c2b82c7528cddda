"""Main text of web pages by tree scoring.

A tolerant parser builds the element tree; menus, forms, notices, adverts, comments and the like go by tag, role
and class. Each paragraph then passes points, one and more for commas and length, to its parent in full and to
further ancestors in falling shares. Containers are ranked by their points times one minus their link density; the
best one, widened to the article that holds it, is kept together with siblings that score well beside it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas video audio head title textarea select".split())
#: Of these, what is not read as raw text: the content is markup, and elements may be left open.
MARKUP = frozenset("noscript template svg math canvas video audio".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav header footer aside form button dialog menu input select textarea label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner comment comments commentlist disqus reply replies respond sidebar aside nav navbar navigation menu submenu "
    "breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended pagination pager toolbar widget hidden".split()
)
PARAGRAPH = frozenset("p pre td blockquote li dd".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the key ends an open element of these, up to the nearest of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|)|[\"'])*+)(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?(?=[\s/>]|$)""", re.I)
WORD = re.compile(r"[a-z]+")
#: Names that say what an element has or lacks, not what it is.
ABOUT = re.compile(r"(?:has|have|no|not|non|with|without)[-_]")
#: Readers' words: an element so named goes however much of the page it holds.
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Wrappers: unwanted elements that stay if most of the page's paragraphs lie in them. At most so many for a page; further ones go.
MOST_WRAPPERS = 16
PARAGRAPH_START = re.compile(r"<p(?=[\s>])", re.I)
#: A solidus at the end of a tag that is part of an unquoted value.
IN_VALUE = re.compile(r"=\s*[^\s\"']*/\Z")
NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Node:
    __slots__ = ("children", "depth", "length", "links", "n_links", "parent", "points", "tag")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children, self.points = tag, parent, [], 0.0
        self.length = self.links = self.n_links = 0
        self.depth = parent.depth + 1 if parent is not None else 0


GOES, MAY_WRAP = 1, 2


def _unwanted(tag: str, attrs: str) -> int:
    """GOES; MAY_WRAP, if only a name says so or it is a form, which may be wrapped round a page's text; else 0."""
    if tag in DROPPED and tag not in ("form", "fieldset"):
        return GOES
    out = MAY_WRAP if tag in DROPPED else 0
    if not attrs or tag in ("html", "body", "main"):
        return out
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and NO_DISPLAY.search(value)) or (name == "role" and value in ROLES):
            return GOES
        if name in ("class", "id"):
            said = {w for token in value.split() if not ABOUT.match(token) for w in WORD.findall(token)}
            if not READERS.isdisjoint(said):
                return GOES
            if not NAMES.isdisjoint(said):
                out = MAY_WRAP
    return out


def _closes(tag: str, attrs: str) -> bool:
    """Whether a start tag is its own end; only svg and math can be."""
    return tag in ("svg", "math") and attrs.endswith("/") and not IN_VALUE.search(attrs)


def _markup_ends(page: str, pos: int) -> dict[int, int]:
    """Where elements of MARKUP that start at pos or later end, by their start; those without an end tag are left out."""
    open_: dict[str, list[int]] = {tag: [] for tag in MARKUP}
    out: dict[int, int] = {}
    unclosed: set[str] = set()  # an end tag that was not found once is not there later
    while m := TOKEN.search(page, pos):
        pos = m.end()
        tag = (m["tag"] or m["end"] or "").lower()
        if tag in MARKUP:
            if m["end"]:
                if open_[tag]:
                    out[open_[tag].pop()] = pos
            elif not _closes(tag, m["attrs"] or ""):
                open_[tag].append(m.start())
        elif m["tag"] and tag in RAW - {"head", "object", "select"} and tag not in unclosed:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, pos)
            if close:
                pos = close.end()
            else:
                unclosed.add(tag)
    return out


class Tree:
    """A tree being built: where the next node goes, and the open elements of each tag, so that an end tag costs no search."""

    def __init__(self):
        self.root = self.at = Node("html", None)
        self.open: dict[str, list[Node]] = {}

    def add(self, child: str | Node) -> None:
        self.at.children.append(child)

    def enter(self, tag: str) -> None:
        self.at = Node(tag, self.at)
        self.at.parent.children.append(self.at)
        self.open.setdefault(tag, []).append(self.at)

    def _nearest(self, tags: set[str]) -> Node | None:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), key=lambda n: n.depth, default=None)

    def leave(self, tags: set[str], bounds: set[str]) -> None:
        """Close the nearest open element of tags and all within it, if no bound is nearer."""
        node, bound = self._nearest(tags), self._nearest(bounds)
        if node is None or (bound is not None and bound.depth > node.depth):
            return
        while self.at.depth >= node.depth:
            self.open[self.at.tag].pop()
            self.at = self.at.parent


def parse(page: str) -> Node:
    """The tree of what may be main text; unwanted elements leave no node."""
    tree = Tree()
    skipping: list[str] = []  # open elements within an unwanted one, itself first
    wrapper: tuple[int, str] | None = None  # where to go on, and its tag, if the unwanted element proves to hold most of the page
    wrappers = 0
    paragraphs: list[int] | None = None
    ends: dict[int, int] | None = None
    unclosed: set[str] = set()  # an end tag that was not found once is not there later
    pos, end = 0, len(page)

    def holds_most(first: int, last: int) -> bool:
        nonlocal paragraphs
        if paragraphs is None:
            paragraphs = [m.start() for m in PARAGRAPH_START.finditer(page)]
        return 2 * (bisect_left(paragraphs, last) - bisect_left(paragraphs, first)) > len(paragraphs)

    def skipped(upto: int) -> int:
        """End the unwanted element; go back into it if it is a wrapper, else on from upto."""
        nonlocal wrapper, wrappers
        skipping.clear()
        held, wrapper = wrapper, None
        if held is None or not holds_most(held[0], upto):
            return upto
        wrappers += 1
        tree.at.children.pop()  # the mark that it left
        tree.enter(held[1])
        return held[0]

    while pos < end or skipping:
        m = TOKEN.search(page, pos)
        stop = m.start() if m else end
        if stop > pos and not skipping:
            tree.add(page[pos:stop])
        if not m:
            pos = end
            if not skipping or (pos := skipped(end)) == end:
                break
            continue
        pos = m.end()
        if m["cdata"] is not None:
            if not skipping:
                tree.add(html.escape(m["cdata"]))
        elif m["tag"]:
            tag, attrs = m["tag"].lower(), m["attrs"] or ""
            if tag in VOID:
                if not skipping:
                    tree.add(" " if tag == "br" else Node(tag, tree.at))
                continue
            if tag in MARKUP:
                if not _closes(tag, attrs):
                    if ends is None:
                        ends = _markup_ends(page, m.start())
                    pos = ends.get(m.start(), pos)
                if pos > m.end() and not skipping:
                    tree.add(Node("wbr", tree.at))
                continue
            if tag in RAW:
                close = None if tag in unclosed else re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, pos)
                if close is None:
                    unclosed.add(tag)
                pos = close.end() if close else (pos if tag in ("head", "object", "select") else end)
                if close and not skipping:
                    tree.add(Node("wbr", tree.at))
                continue
            if skipping:
                if tag == skipping[0] or tag in ("article", "main"):
                    skipping.append(tag)
                continue
            if tag in BLOCK and tag not in ("html", "body"):
                tree.leave({"p"}, {"article", "section", "div", "td", "th", "li", "blockquote", "body"})
            if tag in ENDS:
                tree.leave(*ENDS[tag])
            goes = _unwanted(tag, attrs)
            if goes:
                tree.add(Node("hr", tree.at))
                if not attrs.rstrip().endswith("/"):
                    skipping.append(tag)
                    wrapper = (pos, tag) if goes == MAY_WRAP and wrappers < MOST_WRAPPERS else None
                continue
            if tag not in ("html", "body"):
                tree.enter(tag)
        elif m["end"]:
            tag = m["end"].lower()
            if skipping:
                if tag == skipping[-1]:
                    skipping.pop()
                    if not skipping:
                        pos = skipped(pos)
                elif tag in skipping[:1] and len(skipping) > 1:  # closes over articles that were left open
                    while skipping and skipping.pop() != tag:
                        pass
                    if not skipping:
                        pos = skipped(pos)
                elif tag in ("body", "html", "article", "main"):  # the unwanted element was never closed
                    before = pos
                    pos = skipped(pos)
                    if pos == before:
                        tree.leave({tag}, set())
                continue
            tree.leave({tag}, {"td", "th", "table"} if tag not in BLOCK else set())
    return tree.root


def _walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """Elements in page order, each when it opens (True) and closes (False), without recursion."""
    stack: list[tuple[Node, bool]] = [(root, True)]
    while stack:
        node, opens = stack.pop()
        yield node, opens
        if opens:
            stack.append((node, False))
            stack.extend((c, True) for c in reversed(node.children) if type(c) is Node)


def _measure(root: Node) -> list[Node]:
    """Set lengths, link lengths and points; returns all elements in page order."""
    order = []
    for node, opens in _walk(root):
        if opens:
            order.append(node)
            continue
        own = sum(len(c.strip()) for c in node.children if type(c) is str)
        node.length += own
        if node.tag == "a":
            node.links, node.n_links = node.length, 1
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.links += node.links
            node.parent.n_links += node.n_links
        if node.length >= 25 and (node.tag in PARAGRAPH or (node.tag in ("div", "section", "article", "main") and own >= 25)):
            text = " ".join(c for c in node.children if type(c) is str)
            points = (1 + text.count(",") + min(node.length // 100, 3)) * (1 - node.links / node.length)
            x, share = (node.parent if node.tag in PARAGRAPH else node), 1.0
            for depth in range(1, 5):
                if x is None:
                    break
                x.points += points * share
                x, share = x.parent, 1 / (2 * depth)
    return order


def _density(node: Node) -> float:
    return node.links / node.length if node.length else 0.0


def _menu(node: Node) -> bool:
    return node.tag in ("ul", "ol", "div", "table", "p", "section") and node.n_links >= 3 and _density(node) > 0.8


def _blocks(nodes: list[Node]) -> Iterator[str]:
    """Texts of blocks in page order, character references decoded and white space as one blank."""
    held: list[str] = []
    for top in nodes:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if type(x) is str:
                held.append(x)
                continue
            if x is None or x.tag in BLOCK:
                yield "".join(held)
                held = []
            if x is None or _menu(x):
                continue
            if x.tag in BLOCK:
                stack.append(None)
            stack.extend(reversed(x.children))
        yield "".join(held)
        held = []


def main_text(page: str | None) -> str:
    """The page's main text, blocks joined by a line feed; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    order = _measure(root)
    articles = [n for n in order if n.tag in ("article", "main") and n.length]
    best = max(order, key=lambda n: n.points * (1 - _density(n)))
    if best.points <= 0:
        best = max(articles, key=lambda n: n.length, default=root)
    top, x = best, best
    while x is not None:
        if x.tag in ("article", "main"):
            top = x
            if x.tag == "article":
                break
        x = x.parent
    least = max(3.0, 0.2 * best.points * (1 - _density(best)))
    kept: list[Node] = []
    if top.parent is None:
        kept = [top]
    else:
        siblings = [c for c in top.parent.children if type(c) is Node]
        at = siblings.index(top)
        for i, s in enumerate(siblings):
            good = s.points * (1 - _density(s)) >= least
            prose = s.tag in PARAGRAPH and s.length >= 25 and _density(s) < 0.25
            title = s.tag in ("h1", "h2") and i < at
            if i == at or good or (top.tag != "article" and prose) or title:
                kept.append(s)
    text = (" ".join(html.unescape(b).split()) for b in _blocks(kept))
    return "\n".join(b for b in text if b)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages(page_id, url, html, ...): page_id, url, text, n_chars.

    A null or empty html, or a page without main text, gives an empty text and 0; ids and URLs stay as they are, null or
    not; repeated rows each get their row; extra columns are ignored; no rows give no rows. Nothing is cut from long pages.
    What follows an svg, math, video, audio, canvas, template or noscript that is never closed counts as text of the page.
    A form, or an element that only its name marks as unwanted, stays if most of the page's paragraphs lie in it.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
