"""Main text of web pages: a classifier's costs are terminal capacities, neighbours in the text and in the tree are held
together by smoothness edges, and a minimum cut separates blocks of content from boilerplate.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterable
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from latticework.llm.common import map_batches

#: Elements that begin and end a block.
BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose text isn't shown, by their end tag or as a part of the tree.
RAW = frozenset("script style textarea title xmp noembed noframes".split())
UNSEEN = frozenset("template noscript iframe svg select object canvas audio video math".split())
#: Elements without content.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: What an open element of the first kind ends when it begins inside one of the others.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIMITS = frozenset("ul ol menu dl table tbody thead tfoot body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that group nothing: their blocks stand beside those of the elements next to them.
LEAVES = HEADINGS | frozenset("p li dt dd td th figcaption caption summary pre option label button".split())

#: Elements and words of class, id and role that the classifier takes as signs for or against content.
AGAINST_TAGS = frozenset("nav aside footer form menu dialog button fieldset label legend header".split())
AGAINST_WORDS = frozenset("ad ads adv advert adverts advertisement advertising alert banner bar bio breadcrumb breadcrumbs byline comment comments commentlist complementary consent contentinfo cookie cookies copyright cta dialog discussion disqus donate footer foot form gdpr header login masthead menu message meta modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup promo promoted recommended related replies reply respond search share sharing sidebar side signup skip social sponsor sponsored subscribe tags teaser toc toolbar top trending warning widget widgets".split())
FOR_TAGS = frozenset("article main".split())
FOR_WORDS = frozenset("article articlebody body content entry main post story text".split())

#: Log odds of content by feature, fitted by fit() on pages of layouts.page() with the seeds of FITTED_ON.
FITTED_ON = range(3000)
FEATURES = ("bias", "against", "against_more", "favoured", "outside_favoured", "link_share", "log_words", "ends_sentence", "no_sentence", "heading", "in_list", "rights")
WEIGHTS: tuple[float, ...] = (0.55, -10.5, -0.0, 3.48, -5.88, -6.63, 0.55, 1.34, -0.79, 0.45, 2.14, -5.51)
#: Smoothness, chosen by tune() on the same pages: of blocks that follow each other, by their distance in the tree, and of
#: the next blocks under one parent.
NEIGHBOURS, SIBLINGS = 12.0, 0.5

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_END = re.compile(r"[>\"']")
#: One attribute after the other, so that nothing inside a quoted value is taken for one.
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]*))?|["'/=]""")
WORD = re.compile(r"[a-z]+")
#: Words with which a name says what a page or text has or is, not what the element is.
DESCRIBES = frozenset("has no not with without is js type tag category format status theme template layout enable disable show hide".split())
#: Share of a page's plain text from which an element is too much of it to be what its name says: by a part of the name, by all of it.
MOST, NEARLY_ALL = 0.5, 0.9
SENTENCE_END = re.compile(r"[.!?…:;。！？][\"'”’»)]*$")
RIGHTS = re.compile(r"\W{0,3}(?:©|\(c\)|copyright\b)", re.I)
SENTENCE = re.compile(r"[.!?…。！？](?:\s|$)")


@dataclass(slots=True)
class Block:
    parent: int
    element: int
    against: int
    favour: int
    heading: bool
    in_list: bool
    distance: int  # from the block before, in steps of the tree
    parts: list = field(default_factory=list)
    linked: int = 0


@dataclass(slots=True)
class Open:
    number: int  # of the element, or for a leaf that of what it stands in
    tag: str
    element: int = -1
    unseen: bool = False
    in_list: bool = False


@dataclass(slots=True)
class Element:
    """What an element tells about the text in it: by itself (sure), or by a name that may be about something else (named; whole: all of a name)."""

    parent: int
    sure: bool = False
    named: bool = False
    whole: bool = False
    favour: bool = False
    size: int = 0  # of the text below that is no link
    against: int = 0  # with those around it
    favours: int = 0


def marks(tag: str, attributes: str, parent: int) -> Element:
    out = Element(parent, sure=tag in AGAINST_TAGS and tag != "form", named=tag == "form", favour=tag in FOR_TAGS)
    begins_for = begins_against = False
    for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            out.sure = True
        elif name in ("class", "id", "role", "itemprop") and tag not in ("body", "html"):
            for part in value.split():
                words = WORD.findall(part)
                if not words or words[0] in DESCRIBES:
                    continue
                begins_for |= words[0] in FOR_WORDS
                begins_against |= words[0] in AGAINST_WORDS
                if not AGAINST_WORDS.isdisjoint(words):
                    out.named = True
                    out.whole |= len(words) == 1
                elif not FOR_WORDS.isdisjoint(words):
                    out.favour = True
    if out.favour and tag in FOR_TAGS:
        out.named &= begins_against and not begins_for  # an article's names tell what it is about
    if out.named and not (tag in FOR_TAGS):
        out.favour = False
    return out


def weighed(elements: list[Element]) -> None:
    """Which names count, and against and favours with those of the elements around.

    A name doesn't count against an element that holds the page's main element (the innermost that holds half of the text of the largest
    favoured one), nor against one that holds most of the page's text while nothing favoured stands outside it.
    """
    for i in range(len(elements) - 1, 0, -1):
        elements[elements[i].parent].size += elements[i].size
    total = elements[0].size
    clean = [i for i, e in enumerate(elements) if e.favour and not e.named and not e.sure]
    largest = max((elements[i].size for i in clean), default=0)
    main = max((i for i in clean if 2 * elements[i].size >= largest), default=None)
    around = set()
    while main is not None and main >= 0:
        around.add(main)
        main = elements[main].parent
    inside: dict[int, int] = Counter()  # favoured text below each element
    for i in clean:
        up = i
        while up >= 0:
            inside[up] = max(inside[up], elements[i].size)
            up = elements[up].parent
    for i, e in enumerate(elements):
        above = elements[e.parent] if e.parent >= 0 else None
        if e.named and i:
            most = e.size > (NEARLY_ALL if e.whole else MOST) * total and (inside[i] == largest or not clean)
            if i in around or most:
                e.named = False
        e.against = (above.against if above else 0) + (e.sure or e.named)
        e.favours = (above.favours if above else 0) + e.favour


def tokens(html: str) -> Iterable[tuple[str, str, str]]:
    """Texts ("", text, ""), begin tags (name, "", attributes) and end tags ("/", name, ""), in one pass over the page.

    A quoted value may hold a tag's end; a page in which a quote or tag never closes is read on without regard to quotes. A
    comment, or a script and its like, that doesn't end goes to the end of the page; a < that begins nothing is text.
    """
    at, n = 0, len(html)
    last = {q: html.rfind(q) for q in "\"'>"}
    quotes = True
    while at < n:
        begin = html.find("<", at)
        while 0 <= begin < n - 1 and not (html[begin + 1].isascii() and html[begin + 1].isalpha() or html[begin + 1] in "/!?"):
            begin = html.find("<", begin + 1)
        if begin < 0 or begin == n - 1:
            yield "", html[at:], ""
            return
        if begin > at:
            yield "", html[at:begin], ""
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            at = n if end < 0 else end + 3
            continue
        if last[">"] < begin:  # nothing closes any more
            yield "", html[begin:], ""
            return
        if html[begin + 1] in "!?":
            at = html.find(">", begin) + 1
            continue
        closing = html[begin + 1] == "/"
        m = NAME.match(html, begin + 2 if closing else begin + 1)
        if not m:
            at = html.find(">", begin) + 1
            continue
        tag, end = m[0].lower(), -1
        if quotes:
            i = m.end()
            while True:
                found = TAG_END.search(html, i)
                if not found or found[0] != ">" and last[found[0]] <= found.start():
                    quotes = False  # from here on, so that no page is read again and again
                    break
                if found[0] == ">":
                    end = found.start()
                    break
                i = html.find(found[0], found.end()) + 1
        if end < 0:
            end = html.find(">", m.end())
        at = end + 1
        if closing:
            yield "/", tag, ""
            continue
        yield tag, "", html[m.end() : end]
        if tag in RAW:
            stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
            at = n if not stop else stop.start()


def blocks_of(html: str) -> list[Block]:
    """Runs of text that no block element interrupts, with what their elements tell."""
    out: list[Block] = []
    elements = [Element(-1)]
    stack = [Open(0, "", 0)]
    open_tags: Counter = Counter()
    number, links, block, low, depth = 0, 0, None, 0, 0

    def cut(i: int) -> None:
        nonlocal low
        for x in stack[i:]:
            open_tags[x.tag] -= 1
        del stack[i:]
        low = min(low, len(stack))

    for kind, name, attributes in tokens(html):
        if not kind:
            top = stack[-1]
            if top.unseen:
                continue
            if block is None:
                if not name.strip():
                    continue
                block = Block(top.number, top.element, 0, 0, top.tag in HEADINGS, top.in_list, depth + len(stack) - 2 * low)
                low = depth = len(stack)
                out.append(block)
            block.parts.append(unescape(name) if "&" in name else name)
            if links:
                block.linked += len(name)
            else:
                elements[top.element].size += len(name.strip())
            continue
        closing, tag = kind == "/", name or kind
        if tag == "a":
            links = 0 if closing else 1
        if tag in RAW or tag not in BLOCKS and tag not in UNSEEN:
            continue
        if tag in BLOCKS:
            block, links = None, 0
        if tag in VOID:
            continue
        if closing:
            if open_tags[tag] and (tag != "p" or stack[-1].tag == "p"):
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                cut(i)
            continue
        if stack[-1].tag == "p" and tag in BLOCKS:
            cut(len(stack) - 1)  # a paragraph ends where a block begins
        ended = ENDS.get(tag, ())
        if any(open_tags[t] for t in ended):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ended:
                    cut(i)
                    break
                if stack[i].tag in LIMITS:
                    break
        number += 1
        top = stack[-1]
        elements.append(marks(tag, attributes, top.element))
        stack.append(Open(top.number if tag in LEAVES else number, tag, len(elements) - 1, top.unseen or tag in UNSEEN, top.in_list or tag in ("li", "dt", "dd", "td", "th")))
        open_tags[tag] += 1
    weighed(elements)
    for b in out:
        b.against, b.favour = elements[b.element].against, elements[b.element].favours
    return out


def features(blocks: list[Block], texts: list[str]) -> np.ndarray:
    favoured = any(b.favour and not b.against for b in blocks)
    rows, n = [], len(blocks)
    for b, t in zip(blocks, texts):
        inside = bool(b.favour)
        # Names of one layout don't add up without end: the second counts for itself, more don't.
        rows.append((1.0, float(b.against > 0), float(b.against > 1), float(favoured and inside), float(favoured and not inside), min(1.0, b.linked / len(t)), math.log1p(t.count(" ") + 1), float(bool(SENTENCE_END.search(t[-8:]))), float(not SENTENCE.search(t)), float(b.heading), float(b.in_list), float(bool(RIGHTS.match(t)))))
    return np.array(rows).reshape(n, len(FEATURES))


def edges_of(blocks: list[Block], neighbours: float, siblings: float) -> dict[tuple[int, int], float]:
    """Edges hold blocks together that stand side by side in the text or in the tree, a tenth as strongly where names tell them apart."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}

    def alike(i: int, j: int) -> float:
        a, b = blocks[i], blocks[j]
        return 1.0 if (a.against > 0, a.favour > 0) == (b.against > 0, b.favour > 0) else 0.1

    for i, b in enumerate(blocks):
        if i and neighbours:
            edges[i - 1, i] = neighbours / (1 + b.distance) * alike(i - 1, i)
        j = last.get(b.parent)
        if j is not None and siblings:
            edges[j, i] = edges.get((j, i), 0.0) + siblings * alike(j, i)
        last[b.parent] = i
    return edges


def minimum_cut(terminal: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Sides of a minimum cut: True with the source. terminal: capacity from the source, or if negative to the sink."""
    n = len(terminal)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[j][i] = near[i].get(j, 0.0) + w
    side: list[bool | None] = [None] * n
    excess, open_ = list(terminal), [sum(x.values()) for x in near]
    queue = deque(range(n))
    while queue:  # a node whose terminal outweighs all its edges is on that side of every minimum cut
        i = queue.popleft()
        if side[i] is None and abs(excess[i]) > open_[i] + 1e-12:
            side[i] = excess[i] > 0
            for j, w in near[i].items():
                if side[j] is None:
                    excess[j] += w if side[i] else -w
                    open_[j] -= w
                    queue.append(j)
    rest = [i for i in range(n) if side[i] is None]
    residual = {i: {j: w for j, w in near[i].items() if side[j] is None} for i in rest}
    while True:  # maximum flow from nodes with excess to nodes with a deficit, all shortest paths of a round at once
        level = {i: 0 for i in rest if excess[i] > 1e-9}
        queue, wanted = deque(level), False
        while queue:
            i = queue.popleft()
            wanted |= excess[i] < -1e-9
            for j, w in residual[i].items():
                if w > 1e-9 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not wanted:
            for i in rest:
                side[i] = i in level
            return side
        ahead = {i: iter(list(residual[i])) for i in level}
        for source in [i for i, d in level.items() if not d]:
            path = [source]
            while path and excess[source] > 1e-9:
                i = path[-1]
                if excess[i] < -1e-9:
                    steps = list(zip(path, path[1:]))
                    push = min(excess[source], -excess[i], *(residual[a][b] for a, b in steps))
                    excess[source] -= push
                    excess[i] += push
                    for a, b in steps:
                        residual[a][b] -= push
                        residual[b][a] = residual[b].get(a, 0.0) + push
                    full = next((k for k, (a, b) in enumerate(steps) if residual[a][b] <= 1e-9), None)
                    if full is not None:
                        del path[full + 1 :]
                    continue
                for j in ahead[i]:
                    if residual[i][j] > 1e-9 and level.get(j) == level[i] + 1:
                        path.append(j)
                        break
                else:
                    level[i] = -1
                    path.pop()


def plain(blocks: list[Block]) -> tuple[list[Block], list[str]]:
    """The blocks that have text, and it, with single spaces."""
    texts = [" ".join("".join(b.parts).split()) for b in blocks]
    return [b for b, t in zip(blocks, texts) if t], [t for t in texts if t]


def content(blocks: list[Block], texts: list[str], weights=None, neighbours: float | None = None, siblings: float | None = None) -> list[bool]:
    odds = features(blocks, texts) @ np.array(WEIGHTS if weights is None else weights)
    return minimum_cut(odds.tolist(), edges_of(blocks, NEIGHBOURS if neighbours is None else neighbours, SIBLINGS if siblings is None else siblings))


def main_text(html: str | None, **options) -> str:
    """The content blocks of a page, white space made single, in page order, joined by spaces."""
    if not html:
        return ""
    blocks, texts = plain(blocks_of(html))
    return " ".join(t for t, keep in zip(texts, content(blocks, texts, **options)) if keep)


def labelled(html: str, main: list[str]) -> tuple[list[Block], list[str], np.ndarray]:
    """Blocks of a page of known main text, and which of them belong to it: the first match of each, in order."""
    blocks, texts = plain(blocks_of(html))
    label, at = np.zeros(len(texts), bool), 0
    for t in main:
        at = texts.index(t, at)
        label[at] = True
        at += 1
    return blocks, texts, label


def fit(pages: Iterable[tuple[str, list[str]]], decay: float = 1e-4, rounds: int = 60) -> np.ndarray:
    """Weights of the log odds by logistic regression (Newton's method), from pages and their main blocks."""
    found = [labelled(*p) for p in pages]
    x, y = np.vstack([features(b, t) for b, t, _ in found]), np.concatenate([k for _, _, k in found]).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) / len(y) + decay * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + decay * np.eye(len(w)), slope)
    return w


def tune(pages: Iterable[tuple[str, list[str]]], weights, grid=(0.5, 1.0, 2.0, 4.0, 8.0, 12.0, 16.0, 24.0)) -> tuple[float, float]:
    """The smoothness under which the cut mislabels the fewest blocks; of equal ones the least."""
    found = [labelled(*p) for p in pages]
    wrong = {(a, b): sum(int((np.array(content(x, t, weights, a, b)) != k).sum()) for x, t, k in found) for a in grid for b in grid}
    return min(wrong, key=lambda k: (wrong[k], k[0] + k[1]))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and main text of every row of `pages`; null or empty html gives an empty text.

    Null ids and urls are kept, repeated rows too, each judged on its own; an empty table gives an empty table. Pages of any
    length are read whole, in time that grows with their length; one without blocks has an empty text. A name in a class, id or role tells
    against the text in its element, but not where the element holds the page's main one or most of its text. Other
    columns are not carried, whatever their names.
    """

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(x) for x in b.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])

    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return map_batches(rows, run, "page_id long, url string, text string")
