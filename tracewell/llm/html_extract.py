"""Main text of web pages by minimum-cut labelling.

A page's text is cut into blocks at block elements. A small classifier says what it costs to call a block content
and what to call it boilerplate; these costs are capacities from the source and to the sink. Neighbouring blocks are
joined by smoothness edges, the price of labelling them apart: the nearer they are in the DOM and the more their elements
are alike, the higher. The cheapest labelling of the page is a minimum cut, which a maximum flow finds. What an element's
name or class says weighs less than two like neighbours, so a line of links amid paragraphs stays with them, and a
sentence amid a menu goes with it.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewell.llm._common import slices

# Kinds of HTML elements.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = ("script", "style", "template", "textarea", "iframe", "svg", "title", "select", "option")
_BLOCK = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"html", "head", "body"}
_SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",)}
_OUTSIDE = frozenset("nav footer aside form dialog button menu label legend".split())
_INSIDE = frozenset(("article", "main"))
# Parts of class names, ids and roles that say what an element is for.
_BAD = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer topbar toolbar comment comments commentlist disqus respond reply replies discussion share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay pagination pager search complementary contentinfo dialog toc notice notices".split())
_HINTS = frozenset("alert widget copyright legal".split())
_HEADS = frozenset("header masthead".split())
_GOOD = frozenset("article articlebody content main maincontent post entry story body text prose".split())
_PROOF = frozenset("article articlebody content main maincontent".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?][^<>]*+>", re.S)
_ATTR = re.compile(r"(?:^|[\s\"'])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
#: What it costs more to call a block content that an element or class marks as something else, or that a class only hints at.
MARKED, HINTED = 4.0, 1.5
#: A marked element can only be the page's frame if it holds more than this part of its text; see marked().
FRAME = 0.5
#: Characters from which a block that is no paragraph counts as prose, if hardly any of them are links.
PROSE = 80
#: Smoothness of consecutive blocks: of one parent, tag and class; of one parent and tag; all others; and of one parent beyond a block between.
LIKE, KIN, NEXT, SKIP = 2.0, 1.0, 0.3, 0.4
#: Capacities are whole numbers of this part of a unit.
_GRAIN = 1000


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    look: str  # its element's class
    parent: int
    good: int
    mark: int  # the innermost element that marks it as no content, in Marks; -1: none
    proof: int | None  # the mark around the innermost element that says it holds the content; None: no such element
    links: int


@dataclass(slots=True)
class Marks:
    """Elements that mark what they hold as no content: the next one around each, and what it costs."""

    around: list[int]
    cost: list[float]


@dataclass(slots=True)
class _Open:
    name: str
    number: int
    look: str
    good: int
    mark: int
    proof: int | None
    inside: bool
    block: int  # where in the stack the innermost block element is


def _words_of(value: str) -> set[str]:
    return {w.lower() for w in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", value) if w}


def blocks_of(html: str) -> tuple[list[Block], Marks]:
    """The text blocks of a page in its order, each with what its elements say about it. Linear in the page's length."""
    out: list[Block] = []
    marks = Marks([], [])
    stack = [_Open("", 0, "", 0, -1, None, False, 0)]
    number, piece, links, at = 0, [], 0, 0
    open_: defaultdict[str, list[int]] = defaultdict(list)  # where in the stack elements of a name are

    def flush() -> None:
        nonlocal piece, links
        text = " ".join("".join(piece).split())
        if text:
            last = stack[-1]
            top = stack[last.block]
            out.append(Block(text, top.name, top.look, stack[max(0, last.block - 1)].number, last.good, last.mark, last.proof, min(links, len(text))))
        piece, links = [], 0

    def pop_to(k: int) -> None:
        if any(x.name in _BLOCK for x in stack[k:]):
            flush()
        for x in stack[k:]:
            open_[x.name].pop()
        del stack[k:]

    def shut(name: str, until: frozenset | tuple = ()) -> None:
        """Close the innermost element of that name, unless one of ``until`` is open within it."""
        if open_[name] and not any(open_[u] and open_[u][-1] > open_[name][-1] for u in until):
            pop_to(open_[name][-1])

    while True:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            piece.append(unescape(text) if "&" in text else text)
            if open_["a"]:
                links += len(text)
        if not m:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["close"]:
            if name == "p" and not open_["p"]:
                flush()
            shut(name, ("article", "main", "body") if name not in ("article", "main", "body", "html") else ())
            continue
        if name in _RAW and not m["attrs"].endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            piece.append(" ")
            continue
        if name in _VOID:
            flush() if name == "hr" else piece.append(" ") if name == "br" else None
            continue
        if name in _CLOSES_P:
            shut("p", ("table", "button"))
        if name in _SIBLINGS:
            for sibling in [x for x, y in _SIBLINGS.items() if y == _SIBLINGS[name]]:
                shut(sibling, _SIBLINGS[name])
        if name == "body":
            shut("head")
        if name in _BLOCK:
            flush()
        top = stack[-1]
        number += 1
        inside = top.inside or name in _INSIDE
        cost = MARKED if name in _OUTSIDE or name == "head" or (name == "header" and not top.inside) else 0.0
        good, look, proof, bad = max(top.good, 2 if name in _INSIDE else 0), "", name in _INSIDE, False
        if m["attrs"]:
            for k, v in _ATTR.findall(m["attrs"]):
                k, v = k.lower(), v.strip("\"'")
                if k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v)):
                    cost = MARKED
                elif k in ("class", "id", "role", "itemprop") and name not in ("html", "body"):
                    look = v if k == "class" else look
                    names = _words_of(v)
                    good = max(good, 1 if names & _GOOD else 0)
                    proof, bad = proof or bool(names & _PROOF), bad or bool(names & _BAD)
                    if name in _INSIDE or (name[0] == "h" and name[1:].isdigit()):
                        continue
                    if names & _BAD or (names & _HEADS and not inside):
                        cost = MARKED
                    elif names & _HINTS:
                        cost = max(cost, HINTED)
        mark = top.mark
        if cost:
            marks.around.append(top.mark)
            marks.cost.append(cost)
            mark = len(marks.cost) - 1
        open_[name].append(len(stack))
        stack.append(_Open(name, number, look, good, mark, top.mark if proof and not bad else top.proof, inside, len(stack) if name in _BLOCK else top.block))
    flush()
    return out, marks


def marked(blocks: list[Block], marks: Marks) -> list[float]:
    """What each block's marks cost: the highest, those of the page's frame left out.

    Some pages wrap all they have in an element whose class speaks of a sidebar or whose name is form. So a marked element
    that holds most of the text is the page's frame if nothing outside of it claims to be the content, and if
    something within claims it or there is no prose outside. A long sidebar or many comments beside an article are none.
    """
    n = len(marks.cost)
    held, proven = [0] * n, [False] * n
    claims, prose = set(), set()  # marks, or -1, of blocks that claim to be content, and of those that read like it
    for b in blocks:
        if b.mark >= 0:
            held[b.mark] += len(b.text)
        if b.proof is not None:
            if b.proof >= 0:
                proven[b.proof] = True
            claims.add(b.mark)
        if b.links * 3 < len(b.text) and (b.tag in ("p", "blockquote", "pre") or len(b.text) >= PROSE):
            prose.add(b.mark)
    for m in range(n - 1, -1, -1):  # what is around has a lesser number
        if marks.around[m] >= 0:
            held[marks.around[m]] += held[m]
            proven[marks.around[m]] |= proven[m]
    most, frames = FRAME * sum(len(b.text) for b in blocks), set()
    claimed, read = -1 in claims, -1 in prose
    for m in range(n):  # those that hold most of the text lie within each other
        if held[m] > most:
            if not claimed and (proven[m] or not read):
                frames.add(m)
            claimed, read = claimed or m in claims, read or m in prose
    cost = list(marks.cost)
    for m in range(n):
        cost[m] = max(0.0 if m in frames else cost[m], cost[marks.around[m]] if marks.around[m] >= 0 else 0.0)
    return [cost[b.mark] if b.mark >= 0 else 0.0 for b in blocks]


def costs(b: Block, mark: float, has_article: bool) -> tuple[float, float]:
    """What it costs to call a block boilerplate, and to call it content."""
    dense = b.links / len(b.text)
    good = 0 if mark >= MARKED else b.good
    boilerplate = 0.4 + min(2.0, math.log1p(len(b.text)) / 3) * (1 - dense) + (1.0 if b.tag in ("p", "blockquote", "pre") else 0.6 if b.tag[0:1] == "h" and b.tag[1:].isdigit() else 0.0) + (4.0 if good == 2 else 1.5 if good else 0.0)
    content = mark + 4.0 * max(0.0, dense - 0.3) + (3.5 if has_article and good < 2 else 0.8)
    return boilerplate, content


def minimum_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay on the source's side: ``source[i]`` is the price of leaving it, ``sink[i]`` that of staying.

    A node whose prices differ by more than its edges weigh keeps the cheaper side in every minimum cut; it is merged
    into that terminal, and the maximum flow runs over what is left. Equal cuts: the least source side.
    """
    n = len(source)
    weight = [0] * n
    for a, b, c in edges:
        weight[a] += c
        weight[b] += c
    fixed = [source[i] - sink[i] > weight[i] if abs(source[i] - sink[i]) > weight[i] else None for i in range(n)]
    if all(f is not None for f in fixed):
        return fixed
    source, sink = list(source), list(sink)
    s, t = n, n + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, there: int, back: int) -> None:
        graph[a].append([b, there, len(graph[b])])
        graph[b].append([a, back, len(graph[a]) - 1])

    for a, b, c in edges:
        for x, y in ((a, b), (b, a)):
            if fixed[x] is None and fixed[y] is not None:
                (source if fixed[y] else sink)[x] += c
        if fixed[a] is None and fixed[b] is None:
            link(a, b, c, c)
    for i in range(n):
        if fixed[i] is None:
            link(s, i, source[i], 0)
            link(i, t, sink[i], 0)
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            x = queue.popleft()
            for y, c, _ in graph[x]:
                if c and y not in level:
                    level[y] = level[x] + 1
                    queue.append(y)
        if t not in level:
            return [f if f is not None else i in level for i, f in enumerate(fixed)]
        tried = [0] * (n + 2)
        while True:
            path, x = [], s
            while x != t:
                while tried[x] < len(graph[x]):
                    y, c, _ = graph[x][tried[x]]
                    if c and level.get(y, -1) == level[x] + 1:
                        break
                    tried[x] += 1
                else:
                    if not path:
                        break
                    x = path.pop()
                    tried[x] += 1
                    continue
                path.append(x)
                x = graph[x][tried[x]][0]
            if x != t:
                break
            flow = min(graph[v][tried[v]][1] for v in path)
            for v in path:
                e = graph[v][tried[v]]
                e[1] -= flow
                graph[e[0]][e[2]][1] += flow


def main_blocks(html: str) -> list[str]:
    """The texts of a page's content blocks."""
    blocks, around = blocks_of(html)
    if not blocks:
        return []
    marks = marked(blocks, around)
    has_article = any(b.good == 2 and m < MARKED for b, m in zip(blocks, marks, strict=True))
    pairs = [costs(b, m, has_article) for b, m in zip(blocks, marks, strict=True)]
    near = lambda a, b: NEXT if a.parent != b.parent or a.tag != b.tag else LIKE if a.look == b.look else KIN
    edges = [(i, i + 1, round(_GRAIN * near(a, b))) for i, (a, b) in enumerate(zip(blocks, blocks[1:], strict=False))]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if b.parent in last and last[b.parent] < i - 1:
            edges.append((last[b.parent], i, round(_GRAIN * SKIP)))
        last[b.parent] = i
    side = minimum_cut([round(_GRAIN * x) for x, _ in pairs], [round(_GRAIN * y) for _, y in pairs], edges)
    return [b.text for b, keep in zip(blocks, side, strict=True) if keep]


def extract_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with ``out_col``: the main text of the whole html, its blocks joined by line feeds.

    White space within a block, and a <br>, is one space; character references are decoded. Null or empty html, and a page
    without content: "". A column named ``out_col`` is replaced; all others stay. Repeated rows are read each.
    """
    pages = pages.drop(out_col) if out_col != html_col else pages
    names, made = pages.columns, "__out"
    while made in names:
        made += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html_col):
                texts = pa.array(["\n".join(main_blocks(h or "")) for h in part.column(html_col).to_pylist()], type=pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*names, made])

    out = pages.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields), f"`{made}` string"]))
    return out.drop(html_col).withColumnRenamed(made, out_col) if out_col == html_col else out.withColumnRenamed(made, out_col)
