"""Main text of web pages by a minimum cut between content and boilerplate.

A page becomes its blocks of text in order. Two kinds of evidence, summed as log-odds, give each
block a cost of being called content and one of being called boilerplate, the capacities from the
source and to the sink: a logistic classifier of the block's own text and of its container's share
of the page's text, and what the elements around it are called. The classifier is fitted to blocks
inside elements whose tag tells what they are (article and main, nav and footer and the like) and
sees neither tags nor names. Successive blocks are tied by smoothness edges, the more so the nearer
they are in the document tree, as are blocks of one container with others between. The blocks on
the source's side of the minimum cut are the main text, so a block of little evidence goes with
those around it, and names that the text around contradicts don't decide alone.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the sample that the classifier is fitted to: pages, those of the least hash of page_id, and bytes of a page.
SAMPLE_PAGES, SAMPLE_BYTES = 1500, 1 << 18
#: Log-odds: most of the classifier; of a content element; of an element that calls itself boilerplate; of one that may be so.
LEARNED, CONTENT, BOILER, MAYBE = 2.0, 4.0, -8.0, -2.0
#: Capacities of the edges between successive blocks, and of nearness in the tree (that much for blocks of one container).
NEXT, NEAR = 0.5, 0.6

_ATTRIBUTES = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    # no text: up to the end tag, and without one scripts and styles reach to the end; the others only if closed before the next of their kind
    rf"|<(script|style)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    rf"|<(noscript|template|title|svg|iframe|object|textarea|select|button)\b(?!{_ATTRIBUTES}(?<=/)>){_ATTRIBUTES}>(?:[^<]++|<(?!/?\2\b))*+</\2\s*>"
    rf"|<(/?)([a-z][a-z0-9:-]*)({_ATTRIBUTES})>"
    r"|<[!?/a-z][^>]*+(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\shidden(?:[\s=]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PARTS = re.compile(r"[a-z]+")
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br img input label acronym button select svg iframe object textarea noscript template".split())
VOID = frozenset("br img input hr meta link area base col embed source track wbr param".split())
BOILER_TAGS = frozenset("nav header footer aside form dialog menu head".split())
CONTENT_TAGS = frozenset("article main".split())
#: Parts of a class, id or role that call an element boilerplate, as the last part of a name or with neutral parts alone.
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices gdpr nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside complementary contentinfo related recommended share sharing social comment comments disqus reply replies respond newsletter subscribe subscription signup login popup modal dialog overlay pagination pager search toolbar skip alert".split()
)
NEUTRAL_WORDS = frozenset("list slot area box section block wrap wrapper container left right top bottom inner outer links link item items unit group bar widget form site page global primary secondary".split())
#: Such a part before another says that something else has it, or is of it.
HAVING_WORDS = frozenset("has with no without is".split())
CONTENT_WORDS = frozenset("article post entry story content body text main".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class Block(NamedTuple):
    text: str
    path: tuple[int, ...]  # numbers of the elements around it, paragraphs and headings not counted
    named: float  # log-odds of being content by the names around it
    tagged: int  # 1 in a content element, -1 in a boilerplate one, by tags alone
    linked: float  # share of its text in links
    heading: bool


class Open(NamedTuple):
    tag: str
    path: tuple[int, ...]
    named: float
    tagged: int
    inside: bool  # of a content element


def called(attributes: str) -> float:
    """Log-odds by class, id and role: the strongest of its names, boilerplate before content."""
    if _HIDDEN.search(attributes):
        return 2 * BOILER
    found = 0.0
    for m in _ATTRIBUTE.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            parts = _PARTS.findall(name)
            boiler = [p in BOILER_WORDS for p in parts]
            content = any(p in CONTENT_WORDS for p in parts)
            if not any(boiler):
                found = found or (-MAYBE if content else 0.0)
            elif content and parts[-1] in ("header", "masthead"):
                continue
            elif parts[0] not in HAVING_WORDS and (boiler[-1] or all(b or p in NEUTRAL_WORDS for b, p in zip(boiler, parts, strict=True))):
                return BOILER
            else:
                found = min(found, 0.0) or MAYBE
    return found


def opened(tag: str, attributes: str, around: Open, number: int) -> Open:
    named, tagged, inside = around.named, around.tagged, around.inside
    if tag in CONTENT_TAGS and not inside:
        named, tagged, inside = named + CONTENT, tagged or 1, True
    elif tag in BOILER_TAGS and not (tag == "header" and inside):
        named, tagged = named + BOILER, -1
    if attributes and tag not in ("body", "html"):
        named += called(attributes)
    return Open(tag, around.path if tag == "p" or tag in HEADINGS else (*around.path, number), named, tagged, inside)


def blocks(page: str) -> list[Block]:
    """The blocks that have text, in order."""
    out: list[Block] = []
    stack = [Open("", (), 0.0, 0, False)]
    parts: list[str] = []
    linked, in_link, made = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                at = stack[-1]
                out.append(Block(text, at.path, at.named, at.tagged, min(1.0, linked / len(text)), at.tag in HEADINGS))
            parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        tag = m[4]
        if tag is None:
            text = m[0]
            if text[0] != "<" or len(text) == 1:
                parts.append(text)
                if in_link:
                    linked += len(text)
            elif m[1] or m[2]:
                parts.append(" ")
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if m[3] else 1
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        if m[3]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            in_link = 0
        elif tag not in VOID:
            closes = CLOSES.get(tag)
            if closes:
                while stack[-1].tag in closes:
                    stack.pop()
            elif stack[-1].tag == "p":
                stack.pop()
            made += 1
            stack.append(opened(tag, m[5], stack[-1], made))
    flush()
    return out


def traits(found: list[Block]) -> np.ndarray:
    """What the classifier sees of each block: its text, and its container's share of text; no tags or names of containers."""
    size: dict[tuple[int, ...], int] = {}
    for b in found:
        size[b.path] = size.get(b.path, 0) + round(len(b.text) * (1 - b.linked))
    most = max(1, *size.values()) if size else 1
    rows = [(1.0, min(len(b.text), 400) / 100, b.linked, b.text.count(",") + b.text.count(".") > 1, b.text[-1] in ".!?:;\"'", b.heading, size[b.path] / most) for b in found]
    return np.array(rows, np.float64).reshape(-1, 7)


def learn(pages: list[str], epochs: int = 300) -> np.ndarray:
    """Logistic weights from blocks inside elements whose tags tell what they are; without both kinds, plain ones."""
    x, y = [], []
    for p in pages:
        found = blocks(p)
        told = [b.tagged != 0 for b in found]
        x.append(traits(found)[told])
        y += [b.tagged > 0 for b in found if b.tagged]
    labels = np.array(y, float)
    if not 0 < labels.sum() < len(labels):
        return np.array([-2.0, 0.8, -3.0, 0.5, 0.5, 0.5, 2.0])
    seen, weights = np.concatenate(x), np.zeros(7)
    balance = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-seen @ weights))
        weights -= 0.3 * (seen.T @ (balance * (p - labels)) / len(labels) + 1e-3 * weights)
    return weights


def content_side(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut by Dinic's algorithm: node i is tied to the source by gain > 0, to the sink by -gain."""
    n = len(gain)
    to: list[list[int]] = [[] for _ in range(n)]
    head, room = [], []
    for a, b, c in edges:
        to[a].append(len(head))
        to[b].append(len(head) + 1)
        head += [b, a]
        room += [c, c]
    supply, demand = [max(g, 0.0) for g in gain], [max(-g, 0.0) for g in gain]
    while True:
        level, queue = [-1] * n, deque(i for i in range(n) if supply[i] > 1e-9)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            i = queue.popleft()
            reached |= demand[i] > 1e-9
            for e in to[i]:
                if room[e] > 1e-9 and level[head[e]] < 0:
                    level[head[e]] = level[i] + 1
                    queue.append(head[e])
        if not reached:
            return [x >= 0 for x in level]
        nth = [0] * n
        for s in range(n):
            while supply[s] > 1e-9:
                path, i = [], s
                while demand[i] <= 1e-9:
                    while nth[i] < len(to[i]) and not (room[to[i][nth[i]]] > 1e-9 and level[head[to[i][nth[i]]]] == level[i] + 1):
                        nth[i] += 1
                    if nth[i] < len(to[i]):
                        path.append(to[i][nth[i]])
                        i = head[path[-1]]
                    elif path:
                        i = head[path.pop() ^ 1]
                        nth[i] += 1
                    else:
                        break
                if demand[i] <= 1e-9:
                    break
                flow = min([supply[s], demand[i], *(room[e] for e in path)])
                supply[s] -= flow
                demand[i] -= flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow


def apart(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    """Steps through the tree from one container to another."""
    same = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        same += 1
    return len(a) + len(b) - 2 * same


def graph_of(found: list[Block], weights: np.ndarray) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Each block's gain of being content, and the smoothness edges."""
    gain = (np.clip(traits(found) @ weights, -LEARNED, LEARNED) + np.array([b.named for b in found])).tolist()
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, NEXT + NEAR / (1 + apart(found[i - 1].path, b.path))))
        if last.get(b.path, i - 1) < i - 1:
            edges.append((last[b.path], i, NEAR))
        last[b.path] = i
    return gain, edges


def main_text(page: str, weights: np.ndarray) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, content_side(*graph_of(found, weights)), strict=True) if keep)


def extract(pages: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """(page_id, url, text) of every page; null and empty html give an empty text.

    White space and character references are as HTML has them; blocks are joined by a line feed.
    Equal rows give equal rows; other columns are not read; an empty table gives an empty result.
    """
    named = pages.select("page_id", "html").toDF("_of", "_html")
    ids = named.select(F.col("_of").alias("_id")).filter("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
    short = named.filter(F.octet_length("_html") <= SAMPLE_BYTES).join(F.broadcast(ids), F.col("_of") == F.col("_id")).select("_of", "_html").orderBy("_of", "_html").limit(sample)
    learned = learn([r["_html"] for r in short.toLocalIterator()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["text"] = [main_text(h, learned) if isinstance(h, str) else "" for h in pdf["html"]]
            yield pdf[["page_id", "url", "text"]]

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInPandas(run, "page_id long, url string, text string")
