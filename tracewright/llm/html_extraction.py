"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks. A log-linear classifier with stated priors per feature (length, share of links, kind of element, names and
elements around it, words of notices) gives each block the cost of being content and of being boilerplate, which are the
capacities of its edges from the source and to the sink. Neighbours in page order, children of one parent, and a block
and what leads into its parent are joined by smoothness edges, which weaken with the distance in the tree and where the border
of a named part of the page is crossed. The minimum cut, found by max-flow, is the labelling of least total cost. No element and no name
decides alone: a short line amid an article stays with it, and a notice goes, because of what they are next to.

Cases: a null or empty page, and one without text, gives the empty text; unclosed tags end with the page; a tag cut
off at the end of the page is markup; text keeps its order, and only white space is changed; repeated rows and null ids are
rows like others; an empty table gives no rows; an input column called like the output is replaced by it.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, others, pieces

# HTML elements by what they mean for text.
BLOCKS = frozenset("address article aside blockquote body br button canvas caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template".split())
CLOSES_P = BLOCKS - {"br", "button", "select", "option", "textarea", "title", "caption"}
# What elements around a block tell, as log-odds of content.
ELEMENTS = {"article": 3.0, "main": 3.0, "nav": -5.0, "footer": -5.0, "aside": -5.0, "menu": -5.0, "button": -5.0, "select": -5.0, "option": -5.0, "textarea": -5.0, "label": -4.0, "noscript": -5.0, "dialog": -4.0, "form": -3.5, "fieldset": -3.5, "header": -3.0, "head": -50.0}
# Parts of class names, ids and roles that name boilerplate and content, and parts that only describe a page.
BAD = frozenset("ad ads advert advertisement adverts adsense banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright dialog disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related recommended recommendations replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toc toolbar topbar alert widget widgets".split())
GOOD = frozenset("article articlebody body bodytext content entry main post story storybody text".split())
STATES = frozenset("closed disabled enabled has layout no off on open page single template with without wrap wrapper".split())
# Parts of names that say what shape a thing has, not what it is about.
SHAPES = frozenset("area bar block bottom box button buttons card column container global group inline inner item items left link links list mobile outer panel primary region right row secondary section site slot sticky sub super tab top unit widget widgets".split())
#: What names tell; the middle one is for names that boilerplate's parts share with others, such as search-and-rescue: long prose outweighs it.
NAMED_BAD, NAMED_MIXED, NAMED_GOOD = -5.0, -2.0, 2.0
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
NOTICE = re.compile(r"©|\(c\) \d|\bcopyright\b|all rights reserved|\bcookies?\b|privacy policy|enable javascript|subscribe|sign up|log ?in\b|advertisement", re.I)

_TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Priors of the classifier, as log-odds: a block without anything around it, each doubling of its words from 8 on, the least and the most of that,
# links only, a paragraph, a heading, the end of a sentence, a hidden block, a short notice and how many words make one.
BIAS, DOUBLING, SHORTEST, LONGEST, LINKS, PARAGRAPH, HEADING, SENTENCE, CONCEALED, NOTICES, NOTICE_WORDS = -0.2, 0.6, 0.0, 2.5, -4.0, 0.5, 0.4, 0.4, -8.0, -3.0, 25
#: Strength of smoothness for neighbours in page order, children of one parent, and a block and what leads into its parent; and the share that each crossed border leaves.
NEXT, SIBLING, LEAD, CROSSED = 1.6, 0.8, 0.5, 0.15
#: An element with this share of the page's text, or with a top heading or menu in it, is the page's frame, whose bad names tell nothing.
FRAME = 0.9


def named(names: list[str]) -> float:
    """What class names, ids and roles tell, as log-odds; a name counts once, by its parts."""
    out = 0.0
    for name in names:
        parts = {x.lower() for x in _PARTS.findall(name)}
        if parts & STATES:
            continue
        good = bool(parts & GOOD)
        bad = parts & BAD
        if bad and not (good and bad == {"header"}):
            out += NAMED_BAD if all(x in BAD or x in SHAPES or x in GOOD for x in parts) else NAMED_MIXED
        elif good and not bad:
            out += NAMED_GOOD
    return max(NAMED_BAD, min(NAMED_GOOD, out))


class Element:
    """An element of the page: its tag, parent, depth, what it tells by itself, and how much text it has."""

    __slots__ = ("tag", "up", "depth", "hint", "hidden", "frames", "size", "good", "bad", "concealed", "in_article")

    def __init__(self, tag: str, up: Element | None, attributes: str):
        self.tag, self.up, self.depth = tag, up, up.depth + 1 if up else 0
        self.hint, self.hidden, self.frames, self.size = ELEMENTS.get(tag, 0.0), False, tag in ("html", "body"), 0
        if attributes:
            self.hidden = bool(HIDDEN.search(attributes))
            if not self.frames:
                self.hint += named([n for m in _NAMES.findall(attributes) for n in m.strip("\"'").split()])
        if tag in ("h1", "nav", "main"):
            e = up
            while e and not e.frames:
                e.frames = not (tag == "h1" and e.tag == "header")  # a site's name at the top of its header tells nothing for the header
                e = e.up

    def settle(self, whole: int) -> None:
        """What it and all around it tell, once the parent has been settled; whole: the characters of the page's text."""
        up = self.up
        self.in_article = self.tag in ("article", "main") or bool(up and up.in_article)
        framing = (self.frames or self.size >= FRAME * whole) and self.tag != "head"
        told = 0.0 if self.hint < 0 and (framing or (self.tag == "header" and self.in_article and self.hint >= ELEMENTS["header"])) else self.hint
        self.good, self.bad, self.concealed = max(told, up.good if up else 0.0), min(told, up.bad if up else 0.0), int(self.hidden) + (up.concealed if up else 0)


class Block(NamedTuple):
    text: str
    at: Element
    links: float  # the share of its characters that are in links


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, each with the element that it stands in."""
    out: list[Block] = []
    elements = [at := Element("", None, "")]
    parts: list[str] = []
    linked, in_link, pos, end = 0, 0, 0, len(page)

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(raw)
            linked += len(raw) if in_link else 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(text, at, min(1.0, linked / len(raw))))
                at.size += len(text)
            parts.clear()
        linked = 0

    while pos < end:
        m = _TAG.search(page, pos)
        if not m:
            add(page[pos:])
            break
        add(page[pos : m.start()])
        pos = m.end()
        if m[2] is None:
            continue
        tag, closing, attributes = m[2].lower(), m[1] == "/", m[3]
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in RAW and not closing and not attributes.endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, pos)
            pos = stop.end() if stop else end
            continue
        if tag not in BLOCKS:
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            e = at
            while e.up and e.tag != tag:
                e = e.up
            if e.up:
                at = e.up
            continue
        if tag in CLOSES_P:
            e = at
            while e.up and e.tag == "p":
                e = e.up
            at = e
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and at.tag in (("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)):
            at = at.up or at
        at = Element(tag, at, attributes)
        elements.append(at)
    flush()
    for e in reversed(elements):
        if e.up:
            e.up.size += e.size
    for e in elements:
        e.settle(elements[0].size)
    return out


def evidence(block: Block) -> float:
    """Log-odds that a block is content."""
    words = block.text.count(" ") + 1
    x = BIAS + max(SHORTEST, min(LONGEST, DOUBLING * math.log2((words + 1) / 8))) + LINKS * block.links
    if block.at.tag == "p":
        x += PARAGRAPH
    elif len(block.at.tag) == 2 and block.at.tag[0] == "h":
        x += HEADING
    if block.text[-1] in ".!?…:\"”»":
        x += SENTENCE
    if words <= NOTICE_WORDS and NOTICE.search(block.text):
        x += NOTICES
    at = block.at
    return x + CONCEALED * at.concealed + (at.bad or at.good)


def closeness(a: Element, b: Element) -> float:
    """2 for one element, 1 for siblings, less the more steps are between them and the more borders of hinted elements are crossed."""
    steps, crossed = 0, 0
    while a is not b:
        if a.depth >= b.depth:
            crossed += a.hint != 0 or a.hidden
            a = a.up
        else:
            crossed += b.hint != 0 or b.hidden
            b = b.up
        steps += 1
    return 2 / max(1, steps) * CROSSED**crossed


def edges_between(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges (block, block, capacity) of a page."""
    edges = [(i, i + 1, NEXT * closeness(found[i].at, found[i + 1].at)) for i in range(len(found) - 1)]
    last: dict[int, int] = {}  # the last block directly under an element
    for i, block in enumerate(found):
        if up := block.at.up:
            for at, strength in ((last.get(id(up)), SIBLING), (last.get(id(up.up)) if up.up else None, LEAD)):
                if at is not None and at < i - 1:
                    edges.append((at, i, strength * closeness(found[at].at, block.at)))
            last[id(up)] = i
    return edges


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side, where node i is joined to it by log(1+e^odds) and to the sink by log(1+e^-odds).

    What goes straight from source to sink is taken off first: what is left is odds itself, as excess or as need.
    Then shortest augmenting paths by levels (Dinic).
    """
    left = list(odds)
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in odds]
    for a, b, w in edges:
        out[a].append(len(to))
        to.append(b)
        room.append(w)
        out[b].append(len(to))
        to.append(a)
        room.append(w)
    eps = 1e-9
    while True:
        level = [0 if x > eps else -1 for x in left]
        queue, found = [i for i, x in enumerate(left) if x > eps], False
        for i in queue:
            if found and level[i] >= found:
                break
            for k in out[i]:
                if level[to[k]] < 0 and room[k] > eps:
                    j = to[k]
                    level[j] = level[i] + 1
                    queue.append(j)
                    if left[j] < -eps:
                        found = found or level[j]
        if not found:
            return [lv >= 0 for lv in level]
        at = [0] * len(left)
        for s in [i for i, x in enumerate(left) if x > eps]:
            path: list[int] = []
            node = s
            while left[s] > eps:
                if left[node] < -eps:
                    flow = min([left[s], -left[node], *(room[k] for k in path)])
                    left[s] -= flow
                    left[node] += flow
                    for k in path:
                        room[k] -= flow
                        room[k ^ 1] += flow
                    path, node = [], s
                    continue
                while at[node] < len(out[node]):
                    k = out[node][at[node]]
                    if room[k] > eps and level[to[k]] == level[node] + 1:
                        break
                    at[node] += 1
                if at[node] < len(out[node]):
                    path.append(out[node][at[node]])
                    node = to[path[-1]]
                elif path:
                    k = path.pop()
                    node = to[k ^ 1]
                    at[node] += 1
                else:
                    break


def labelled(page: str) -> list[tuple[str, float, bool]]:
    """Each block, its log-odds and whether it is content."""
    found = blocks(page)
    odds = [evidence(b) for b in found]
    return [(b.text, x, keep) for b, x, keep in zip(found, odds, minimum_cut(odds, edges_between(found)), strict=True)]


def main_text(page: str) -> str:
    return " ".join(t for t, _, keep in labelled(page) if keep)


def extracted(pages: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """All columns of pages but `page` (and any called like `out`), then the main text as `out`."""
    names = others(pages, (page, out))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [main_text(t.decode(errors="replace")) if t else "" for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, batch.schema.field(batch.num_columns - 1).type)], schema=batch.schema)

    inner = pages.select(*(col(c).alias(f"c{i}") for i, c in enumerate(names)), col(page).cast("string").alias("t"))
    return inner.mapInArrow(each, inner.schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.col("t").alias(out))
