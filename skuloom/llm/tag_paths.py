"""Main text of web pages by tag-path ratios.

The text of a page hangs on root-to-leaf paths of block elements. Text length and punctuation are summed per path, the
ratios are smoothed over neighbouring nodes in page order and fused along the paths into their containers. Paths of links below a
threshold are left out, and containers of them; all other blocks are kept. If a page has article or main elements, the text is
that inside all of them, and only the threshold on paths counts; several with a small part of the weight are cards, which go.

Elements that by their nature hold no article (scripts, menus, footers) are never read. Words in classes and ids, roles and forms only make an element
doubtful: it is left out where the rest of the page carries weight without it, and kept where nearly all of the page's weight lies in it.

Defined cases: null and empty pages, and pages without any text, give an empty text; broken markup is read as browsers read it
as far as block elements go; repeated pages give the same text; all columns of the pages stay.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML and of common usage.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = set(
    "script style noscript template head title nav footer aside form button select option textarea iframe svg canvas object "
    "dialog menu audio video map".split()
)
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
HINTS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside footer cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login "
    "share sharing social comment comments respond replies disqus related recommended pagination pager toolbar search widget".split()
)
PAGE_HINTS = set("header masthead topbar".split())
CONTAINERS = {"article", "main"}
#: Elements that end an open element of the second kind when they begin inside it.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "blockquote"}
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")

#: A path or container below this fraction of the mean ratio whose text is all links is a menu.
MENU_RATIO, MENU_NODES = 0.1, 3
SMOOTHING = [math.exp(-d * d / 2) for d in range(3)]


Path = tuple[tuple[str, int], ...]


#: Share of the page's weight that must lie outside of doubtful elements for them to be left out.
CERTAIN, LEFT_OUT = 0.05, -1
#: Share of the weight below which several article elements are cards beside the article.
CARDS = 0.2
UNFINISHED = re.compile("<[a-zA-Z/!?]")


class Node:
    """A block of text: its path (of steps, each with a number if it is a container element, else 0), text, characters in links and
    the numbers of the doubtful elements around it."""

    __slots__ = ("path", "text", "linked", "doubts")

    def __init__(self, path: Path, text: str, linked: int, doubts: tuple[int, ...]) -> None:
        self.path, self.text, self.linked, self.doubts = path, text, linked, doubts


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, tuple[str, int], int]] = []  # tag, path step, LEFT_OUT or the number of a doubtful element or 0
        self.nodes: list[Node] = []
        self.parts: list[str] = []
        self.links = self.linked = self.containers = self.doubtful = self.out = 0

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.nodes.append(Node(tuple(step for _, step, _ in self.open), text, self.linked, tuple(d for _, _, d in self.open if d > 0)))
            self.parts, self.linked = [], 0

    def _pop(self, i: int) -> None:
        self._flush()
        self.out -= sum(d == LEFT_OUT for _, _, d in self.open[i:])
        del self.open[i:]

    def _push(self, tag: str, step: tuple[str, int], doubt: int) -> None:
        self.open.append((tag, step, doubt))
        self.out += doubt == LEFT_OUT

    def _close_inside(self, kinds: set[str]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in kinds:
                return self._pop(i)
            if self.open[i][0] in SCOPES:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in INLINE and not any(k in ("class", "id", "role", "hidden", "style") for k, _ in attrs):
            self.links += tag == "a"
            return
        given = {k: v or "" for k, v in attrs}
        words = re.split(r"[^a-z0-9]+", f"{given.get('class', '')} {given.get('id', '')}".lower())
        inside = any(t in CONTAINERS for t, _, _ in self.open)
        root = tag in ("html", "body")
        out = not root and (
            (tag in NEVER and tag != "form")
            or (tag == "header" and not inside)
            or "hidden" in given
            or given.get("aria-hidden", "").lower() == "true"
            or "display:none" in given.get("style", "").replace(" ", "").lower()
        )
        doubtful = not root and (
            tag == "form"
            or given.get("role", "").lower() in ROLES
            or not HINTS.isdisjoint(words)
            or (not inside and tag not in CONTAINERS and not PAGE_HINTS.isdisjoint(words))
        )
        if tag in INLINE:
            self.links += tag == "a"
            if out or doubtful:  # left out without ending the block around it
                self._push(tag, (tag, 0), LEFT_OUT)
            return
        if tag in VOID:
            self._flush()
            return
        if tag in ENDS:
            self._close_inside(ENDS[tag])
        else:
            self._close_inside({"p"})
        self._flush()
        step = f"{tag}.{given['class']}" if given.get("class") else tag
        if tag in CONTAINERS:
            self.containers += 1
        self.doubtful += doubtful
        self._push(tag, (step, self.containers if tag in CONTAINERS else 0), LEFT_OUT if out else self.doubtful if doubtful else 0)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash has no meaning in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE:
            self.links = max(0, self.links - (tag == "a"))
            if self.open and self.open[-1][0] == tag:
                self.out -= self.open.pop()[2] == LEFT_OUT
            return
        if tag == "br":
            self.parts.append(" ")
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._pop(i)
                return
        self._flush()

    def handle_data(self, data: str) -> None:
        if self.out:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())


def nodes_of(html: str) -> list[Node]:
    reader = _Reader()
    reader.feed(html)
    if UNFINISHED.match(reader.rawdata):  # a tag that the page cuts off is no text
        reader.rawdata = ""
    reader.close()
    reader._flush()
    return reader.nodes


def _ratios(nodes: list[Node]) -> dict[Path, float]:
    """Characters per node times punctuation per node, for each path."""
    chars, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in nodes:
        chars[n.path] += len(n.text)
        marks[n.path] += len(PUNCTUATION.findall(n.text))
        count[n.path] += 1
    return {p: chars[p] / count[p] * (1 + marks[p] / count[p]) for p in count}


def _smoothed(values: list[float]) -> list[float]:
    out = []
    for i in range(len(values)):
        near = [(SMOOTHING[abs(d)], values[i + d]) for d in range(-2, 3) if 0 <= i + d < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def _menus(nodes: list[Node], weight: list[float], total: int, places: Callable[[Path], list[Path]]) -> set[Path]:
    """The places of nodes, each with the fused weight of its nodes, that are all links and below the threshold."""
    fused, linked, chars, count = defaultdict(float), defaultdict(int), defaultdict(int), defaultdict(int)
    for n, w in zip(nodes, weight, strict=True):
        for p in places(n.path):
            fused[p] += w
            linked[p] += n.linked
            chars[p] += len(n.text)
            count[p] += 1
    mean = sum(weight) / total
    return {p for p in count if count[p] >= MENU_NODES and linked[p] >= 0.9 * chars[p] and fused[p] < MENU_RATIO * mean * chars[p]}


def _certain(nodes: list[Node]) -> set[int]:
    """Identities of the nodes outside of doubtful elements; an element that has nearly all of the weight is none, and those within it are looked at in turn."""
    ratio = _ratios(nodes)
    weight = {id(n): ratio[n.path] * len(n.text) for n in nodes}
    kept: list[Node] = []
    depth = 0
    while nodes:
        clean = [n for n in nodes if len(n.doubts) <= depth]
        kept += clean
        inside: dict[int, float] = defaultdict(float)
        for n in nodes:
            if len(n.doubts) > depth:
                inside[n.doubts[depth]] += weight[id(n)]
        if not inside or sum(weight[id(n)] for n in clean) >= CERTAIN * (sum(inside.values()) + sum(weight[id(n)] for n in clean)):
            break
        heaviest = max(inside, key=lambda d: inside[d])
        nodes = [n for n in nodes if len(n.doubts) > depth and n.doubts[depth] == heaviest]
        depth += 1
    return set(map(id, kept))


def content_nodes(nodes: list[Node]) -> list[Node]:
    """The nodes of the article, in page order."""
    certain = _certain(nodes)
    nodes = [n for n in nodes if id(n) in certain]
    if not nodes:
        return []
    ratio = _ratios(nodes)
    weight = [v * len(n.text) for v, n in zip(_smoothed([ratio[n.path] for n in nodes]), nodes, strict=True)]
    # Article and main elements that are not inside another take the place of the page, but for several cards with little of its weight.
    inside = [any(number for _, number in n.path) for n in nodes]
    if any(inside):
        several = len({next(k for _, k in n.path if k) for n, own in zip(nodes, inside, strict=True) if own}) > 1
        cards = several and sum(w for w, own in zip(weight, inside, strict=True) if own) < CARDS * sum(weight)
        nodes, weight = ([x for x, own in zip(of, inside, strict=True) if own != cards] for of in (nodes, weight))
        inside = [not cards] * len(nodes)
    total = sum(len(n.text) for n in nodes)
    paths = _menus(nodes, [ratio[n.path] * len(n.text) for n in nodes], total, lambda path: [path])
    # Outside of such elements a menu may be a container of several paths.
    within = set() if any(inside) else _menus(nodes, weight, total, lambda path: [path[:k] for k in range(1, len(path))])
    return [n for n in nodes if n.path not in paths and not any(n.path[:k] in within for k in range(1, len(n.path)))]


def main_text(html: str | None) -> str:
    return "\n\n".join(n.text for n in content_nodes(nodes_of(html or "")))


def extract(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """Pages with the main text as column ``name`` (empty if there is none)."""

    @F.arrow_udf("string")
    def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([main_text(t.as_py()) for t in texts], pa.string())

    return pages.withColumn(name, extracted(F.col(html)))
