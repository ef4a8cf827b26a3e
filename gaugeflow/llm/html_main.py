"""Main text of HTML pages by minimum-cut labelling.

A page's visible text is cut into blocks. The graph of a page holds its blocks and the elements above them. A linear classifier over a block's
text (words, closing punctuation, link share) gives the capacity of the block's edge to source or sink; the names of an element and of its
class, id and role give that of the element, once for each block below it up to the next named element. Smoothness edges tie blocks that follow each
other, each block to its element and each element to its parent: firmly inside a named element, for each block below, weakly outside, and
hardly at all across the border of a named element. The maximum flow (Dinic's blocking flows) saturates a minimum cut; blocks still reachable from the source
are content. So a well written comment goes with its comments, a short line stays with its paragraphs, and a list of links leaves its article.

Cases: null and empty pages, and pages without content blocks, give an empty text. Unclosed tags, stray ends and truncated
pages are read as far as they go; a tag that never ends drops what follows it; elements nested deeper than DEPTH hang on the one at DEPTH. White space inside a
block becomes one space; blocks join by one \\n. Other columns are ignored, but for those named in keep.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .common import map_batches

#: Elements without text of their own page.
_SILENT = frozenset("script style noscript template iframe object svg math canvas audio video head title textarea select button".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: A start tag on the left ends open elements on the right, up to the nearest of the scope.
_ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}} | {
    t: {"p"} for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split()}
_CELLS = frozenset(("td", "th", "table", "caption"))
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

#: Log-odds of content that an element's name adds for each block in it.
_TAGS = {"nav": -3.0, "menu": -3.0, "footer": -3.0, "aside": -3.0, "form": -3.0, "dialog": -3.0, "header": -2.5, "fieldset": -3.0, "article": 1.5, "main": 1.0}
_OWN = {"p": 0.4, "h1": 0.4, "h2": 0.3, "h3": 0.2, "blockquote": 0.3, "pre": 0.3, "td": -0.1, "li": -0.2}
#: Words of class, id and role.
_WORDS = {
    -3.0: "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus dialog discussion footer gdpr login menu modal nav navbar navigation navigational newsletter notice notices overlay pagination popup promo promoted promotion register related reply replies reader respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets alert complementary contentinfo".split(),
    -2.5: "header masthead meta byline crumbs tools links recommended recommendations trending popular more legal copyright disclaimer".split(),
    1.0: "article content entry post story main body text articlebody".split(),
}
_WORD_ODDS = {w: v for v, words in _WORDS.items() for w in words}
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""[>"']""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none""", re.I)

_NEXT = 0.3
#: Edges upwards, for each block below: inside a named element, outside, and to the page's body; then a named element's own edge to its parent.
_FIRM, _LOOSE, _BODY, _BORDER = 2.5, 0.5, 0.1, 0.05
_PAGE = frozenset(("", "html", "body"))
DEPTH = 512


class _Node:
    __slots__ = ("below", "depth", "name", "named", "odds", "parent", "within")

    def __init__(self, name: str, parent: _Node | None, odds: float = 0.0):
        self.name, self.parent, self.odds, self.named = name, parent, odds, odds != 0
        self.depth = parent.depth + 1 if parent else 0
        self.within = self if self.named or parent is None else parent.within  # the nearest named element
        self.below = 0


class Block:
    __slots__ = ("linked", "node", "text")

    def __init__(self, text: str, node: _Node, linked: int):
        self.text, self.node, self.linked = text, node, linked


def _odds(name: str, attributes: str, parent: _Node) -> float:
    """Log-odds that an element's own names add; the strongest word counts."""
    own = _TAGS.get(name, 0.0)
    if name == "header" and parent.within.odds > 0:
        own = 0.0  # an article's own heading
    if attributes and name not in ("html", "body"):
        words = [p.lower() for m in _NAMES.finditer(attributes) for p in _PART.findall(m[1] or m[2] or m[3] or "")]
        found = [_WORD_ODDS[w] for w in words if w in _WORD_ODDS]
        if found:
            own = min(own, *found) if min(found) < 0 else max(own, *found) if own >= 0 else own
        if _HIDDEN.search(attributes):
            own = -3.0
    return own


def _tags(page: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name with a slash for end tags, attributes) of each tag, comment (no name) and declaration, in one pass."""
    at, size, open_quotes = 0, len(page), {'"', "'"}
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            at = page.find("-->", start + 4) + 3
            at = at if at > 2 else size
            yield start, at, "", ""
        elif page[start + 1 : start + 2] in ("!", "?"):
            at = page.find(">", start) + 1 or size
            yield start, at, "", ""
        elif m := _NAME.match(page, start + 1):
            end = m.end()
            while stop := _STOP.search(page, end):
                end, mark = stop.end(), stop[0]
                if mark == ">":
                    break
                if mark in open_quotes and page[max(start, end - 8) : end - 1].rstrip().endswith("="):
                    close = page.find(mark, end)
                    if close < 0:  # none further on either: an unclosed quote is an ordinary character
                        open_quotes.discard(mark)
                    else:
                        end = close + 1
            else:
                end = size + 1  # a tag that never ends
            yield start, min(end, size), m[0].lower(), page[m.end() : end - 1]
            at = min(end, size)
        else:
            at = start + 1


def blocks(page: str | None) -> list[Block]:
    """The page's blocks of visible text in order."""
    page = page or ""
    root = _Node("", None)
    stack, out, opened = [root], [], Counter()
    parts: list[str] = []
    linked = depth = at = skip = 0
    low, absent = "", set()

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, stack[-1], min(linked, len(text))))
        parts, linked = [], 0

    def read(end: int):
        nonlocal linked
        if end > at:
            parts.append(page[at:end])
            if depth:
                linked += end - at

    for start, end, name, attributes in _tags(page):
        if start < skip:
            continue
        read(start)
        at = end
        if not name:
            continue
        ends = name[0] == "/"
        name = name.lstrip("/")
        if not ends and name in _SILENT and not attributes.endswith("/"):
            low = low or (page.lower() if page.isascii() else re.sub("[A-Z]", lambda c: c[0].lower(), page))
            close = -1 if name in absent else low.find(f"</{name}", at)
            if close < 0:
                absent.add(name)
                at = len(page) if name in ("script", "style", "title", "textarea") else at
            else:
                at = page.find(">", close) + 1 or len(page)
            skip = at
            parts.append(" ")
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            depth = 0 if ends else 1
        elif name in _INLINE or name in _VOID:
            continue
        elif ends:
            if opened[name]:
                flush()
                depth = 0
                while True:
                    gone = stack.pop().name
                    opened[gone] -= 1
                    if gone == name:
                        break
        else:
            flush()
            depth = 0
            if (closes := _ENDS.get(name)) and any(opened[x] for x in closes):
                stop = _SCOPE.get(name, _CELLS)
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in stop:
                        break
                    if stack[k].name in closes:
                        for gone in stack[k:]:
                            opened[gone.name] -= 1
                        del stack[k:]
            if not attributes.endswith("/"):
                up = stack[-1] if stack[-1].depth < DEPTH else stack[-1].parent
                stack.append(_Node(name, up, _odds(name, attributes, up)))
                opened[name] += 1
    read(len(page))
    flush()
    return out


def content_odds(b: Block) -> float:
    """The classifier of a block's text: log-odds that it is content."""
    words = b.text.count(" ") + 1
    closed = b.text.rstrip("\"')]}\u00bb\u201d\u2019")[-1:] in (".", "!", "?", ":", ";", "\u2026", "\u3002", "\uff01", "\uff1f")
    return min(1.5, math.log1p(words) / 2.5) - 0.7 + 0.5 * closed + _OWN.get(b.node.name, 0.0) - 4.0 * b.linked / len(b.text)


def page_graph(found: list[Block]) -> tuple[list[float], dict[tuple[int, int], float]]:
    """Terminal capacities (to the source above 0, to the sink below) of the blocks and then of the elements above them, and the smoothness edges."""
    odds = [content_odds(b) for b in found]
    nodes: dict[int, int] = {}
    order: list[_Node] = []
    edges: dict[tuple[int, int], float] = {}
    for b in found:
        node: _Node | None = b.node
        while node is not None and id(node) not in nodes:
            nodes[id(node)] = len(found) + len(order)
            order.append(node)
            odds.append(0.0)
            node.below = 0
            node = node.parent
    for b in found:
        b.node.below += 1
        odds[nodes[id(b.node.within)]] += b.node.within.odds
    for node in sorted(order, key=lambda n: -n.depth):
        if up := node.parent:
            up.below += node.below
            if node.named:
                weight = _BORDER
            elif up.name in _PAGE:
                weight = _BODY
            else:
                weight = node.below * (_FIRM if node.within.named else _LOOSE)
            edges[nodes[id(node)], nodes[id(up)]] = weight
    for i, b in enumerate(found):
        edges[i, nodes[id(b.node)]] = _FIRM if b.node.within.named else _BODY if b.node.name in _PAGE else _LOOSE
        if i and found[i - 1].node.within is b.node.within:
            edges[i - 1, i] = _NEXT
    return odds, edges


def content_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Nodes on the source's side of a minimum cut, the one that holds fewest."""
    n = len(odds)
    spare = list(odds)  # above 0: capacity left from the source; below 0: to the sink
    to, room = [], []
    near: list[list[int]] = [[] for _ in range(n)]
    for (i, j), w in edges.items():
        near[i].append(len(to))
        near[j].append(len(to) + 1)
        to += (j, i)
        room += (w, w)
    eps = 1e-9
    while True:
        level = [-1] * n
        layer = [i for i in range(n) if spare[i] > eps]
        sources, deep, reached = layer, 0, False
        for i in layer:
            level[i] = 0
        while layer and not reached:
            deep, after = deep + 1, []
            for i in layer:
                for e in near[i]:
                    j = to[e]
                    if level[j] < 0 and room[e] > eps:
                        level[j] = deep
                        after.append(j)
                        reached = reached or spare[j] < -eps
            layer = after
        if not reached:
            return [x >= 0 for x in level]
        tried = [0] * n
        for s in sources:
            path: list[int] = []
            at = s
            while spare[s] > eps:
                if level[at] == deep and spare[at] < -eps:
                    push = min([spare[s], -spare[at], *(room[e] for e in path)])
                    spare[s] -= push
                    spare[at] += push
                    back = len(path)
                    for k, e in enumerate(path):
                        room[e] -= push
                        room[e ^ 1] += push
                        if room[e] <= eps and k < back:
                            back = k
                    if spare[at] < -eps and back == len(path):
                        continue  # the source is empty
                    del path[back:]
                    at = to[path[-1]] if path else s
                    continue
                while tried[at] < len(near[at]):
                    e = near[at][tried[at]]
                    j = to[e]
                    if room[e] > eps and level[j] == level[at] + 1 <= deep:
                        path.append(e)
                        at = j
                        break
                    tried[at] += 1
                else:
                    if not path:
                        break
                    path.pop()
                    at = to[path[-1]] if path else s
                    tried[at] += 1


def main_text(page: str | None) -> str:
    found = blocks(page)
    keep = content_cut(*page_graph(found))
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract_main(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(the columns of keep, text) for each page. A narrow map over whole pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(map(main_text, part.column(part.num_columns - 1).to_pylist()), pa.string())], names=[*keep, "text"])

    schema = StructType([df.schema[c] for c in keep]).add("text", StringType())
    return map_batches(df.select(*keep, F.col(html_col).cast("string").alias("_html")), run, schema)
