"""Main text of web pages by gradient-boosted trees over DOM nodes, with hierarchical decoding.

Two sets of trees score each node that holds text: whether all of its text is of the article, and whether any is.
Features are the density of its subtree (links, tags, stops, paragraphs per character), words of its own and of its
ancestors' attributes, its tag, depth and place, and how it compares with its siblings and its parent.

Decoding chooses one state for each node, from the leaves up: whole (all below is kept), none (nothing below is) or mixed
(at least one child is not whole and at least one is not none). The most likely consistent labelling of the tree is
found exactly, so that no node is kept inside a dropped one or dropped inside a kept one.

The trees are fitted on made-up pages (``layouts``), in a few seconds, once for each process.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import sliced
from quillstrata.llm.dom import Node, parse
from quillstrata.llm.gbt import Trees, fit
from quillstrata.llm.layouts import made_page

#: Words of classes, ids and roles, by what they speak for.
TOKENS = {
    "content": "article articles post entry story content body main text prose blog page single",
    "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager tabs tab toc topnav",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense",
    "foot": "footer foot copyright legal bottom colophon",
    "head": "header masthead logo top site brand",
    "side": "sidebar side aside widget widgets related recommended popular trending rail more teaser",
    "comment": "comment comments commentlist discussion disqus reply replies respond responses thread",
    "notice": "notice cookie cookies gdpr consent alert popup modal newsletter subscribe paywall warning overlay message",
    "share": "share sharing social follow tags buttons",
    "form": "form search login signup contact",
}
_GROUP = {word: i for i, words in enumerate(TOKENS.values()) for word in words.split()}
_TAGS = [
    {"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"li", "dt", "dd"}, {"ul", "ol", "dl", "menu"}, {"div"}, {"section", "center"}, {"article"}, {"main"}, {"nav"}, {"header", "hgroup"},
    {"footer"}, {"aside", "dialog"}, {"form", "fieldset", "legend", "label"}, {"table", "tr", "td", "th", "tbody", "thead", "tfoot"}, {"blockquote", "pre", "figure", "figcaption", "address"},
]
_TAG = {tag: i for i, tags in enumerate(_TAGS) for tag in tags}
_ABOVE = {"article": 0, "main": 1, "nav": 2, "aside": 3, "footer": 4, "header": 5, "form": 6, "li": 7}


class Unit:
    """A node with text, or (``node.tag`` aside) the text that stands directly in a node which also has such children."""

    __slots__ = ("node", "up", "below", "runs", "chars", "links", "tags", "stops", "paras", "controls", "blocks", "text", "first", "place", "alike", "chain")

    def __init__(self, node: Node, up: int, text: bool):
        self.node, self.up, self.text, self.below = node, up, text, []
        self.place = 0
        self.chain: list[Node] = []  # the node and outer ones that hold the same text
        self.alike: Counter[str] = Counter()  # children by tag
        self.runs = node.runs
        if text:
            self.chars, self.links, self.tags, self.stops, self.paras, self.controls, self.blocks = node.own, 0, 0, 0, 0, 0, len(node.runs)
        else:
            self.chars, self.links, self.tags, self.stops, self.paras, self.controls, self.blocks = node.chars, node.links, node.tags, node.stops, node.paras, node.controls, node.blocks


def units_of(root: Node) -> list[Unit]:
    """Units in document order, parents first. ``below`` and ``up`` are positions in the list; a leaf owns its runs.

    Nested nodes that hold the same text are one unit, that of the innermost: they would vote on one question many times.
    """
    found: list[Unit] = []
    stack = [(root, -1)]
    while stack:
        node, up = stack.pop()
        at = len(found)
        chain = [node]
        inside = [c for c in node.children if c.chars]
        while len(inside) == 1 and not node.runs:
            node = inside[0]
            chain.append(node)
            inside = [c for c in node.children if c.chars]
        unit = Unit(node, up, False)
        unit.chain = chain
        found.append(unit)
        if up >= 0:
            unit.place = len(found[up].below)
            found[up].below.append(at)
            found[up].alike[node.tag] += 1
        if inside:
            unit.runs = []
            if node.runs:
                found.append(own := Unit(node, at, True))
                own.runs, own.chain = node.runs, [node]
                unit.below.append(at + 1)
                unit.alike[node.tag] += 1
            stack += [(c, at) for c in reversed(inside)]
    return found


def features(units: list[Unit], n_runs: int) -> list[list[float]]:
    total = units[0].chars or 1
    groups: dict[int, tuple[int, ...]] = {}  # attribute words of the node, and of it and its ancestors, as bit sets
    rows = []
    firsts = [0] * len(units)  # the first run below each unit that has none of its own
    for at in range(len(units) - 1, -1, -1):
        own_runs = units[at].node.runs
        firsts[at] = own_runs[0] if own_runs else firsts[units[at].below[0]] if units[at].below else 0
    for at, u in enumerate(units):
        node = u.node
        above = groups[u.up] if u.up >= 0 else (0, 0, 0)
        own, over = 0, above[2]
        tag = [0.0] * (len(_TAGS) + 1)
        for n in u.chain:
            for word in n.tokens:
                if (g := _GROUP.get(word)) is not None:
                    own |= 1 << g
            over |= 1 << _ABOVE[n.tag] if n.tag in _ABOVE else 0
            tag[_TAG.get(n.tag, len(_TAGS))] = 1.0
        groups[at] = own, above[1] | own, over
        first = node.runs[0] if node.runs else -1
        u.first = first if first >= 0 else firsts[at]
        c = u.chars or 1
        if u.up >= 0:
            p = units[u.up]
            pc, beside, links_up = p.chars or 1, len(p.below), p.links / (p.chars or 1)
            rest = p.chars - u.chars
            place, same = u.place, p.alike[node.tag]
        else:
            pc, beside, links_up, rest, place, same = c, 1, u.links / c, 0, 0, 1
        rows.append([
            log1p(c), c / total, u.links / c, 100 * u.tags / c, 100 * u.stops / c, log1p(u.paras), log1p(u.blocks), c / (u.blocks or 1), 100 * u.controls / c, float(u.controls),
            c / pc, float(beside), place / beside, log1p(rest / max(1, beside - 1)) - log1p(c), float(same), same / beside, links_up, log1p(pc),
            float(min(node.depth, 12)), u.first / (n_runs or 1), (n_runs - u.first) / (n_runs or 1), float(u.text), float(any(n.hidden for n in u.chain)), float(len(u.below)),
            *tag,
            *(float(own >> g & 1) for g in range(len(TOKENS))),
            *(float(above[1] >> g & 1) for g in range(len(TOKENS))),
            *(float(above[2] >> g & 1) for g in range(len(_ABOVE))),
        ])
    return rows


WHOLE, NONE, MIXED = 0, 1, 2


def mixture(costs: list[list[float]]) -> tuple[float, list[int]]:
    """The least cost of children that are neither all whole nor all none, and their states.

    Either some child is mixed, and the others are what suits them best; or all are whole or none, with one of each.
    """
    best = [min(range(3), key=c.__getitem__) for c in costs]
    k = min(range(len(costs)), key=lambda i: costs[i][MIXED] - costs[i][best[i]])
    with_mixed = [*best[:k], MIXED, *best[k + 1 :]]
    plain = [WHOLE if c[WHOLE] <= c[NONE] else NONE for c in costs]
    if len(set(plain)) == 1:  # the one that is changed most cheaply
        k = min(range(len(costs)), key=lambda i: costs[i][1 - plain[i]] - costs[i][plain[i]])
        plain[k] = 1 - plain[k]

    def total(states: list[int]) -> float:
        return sum(c[s] for c, s in zip(costs, states, strict=True))

    if len(costs) == 1 or total(with_mixed) <= total(plain):
        return total(with_mixed), with_mixed
    return total(plain), plain


def decode(units: list[Unit], whole: np.ndarray, some: np.ndarray) -> list[int]:
    """Runs that are kept, ascending, under the most likely consistent states. whole, some: margins of the two models."""
    cost = np.stack([np.logaddexp(0, -whole) + np.logaddexp(0, -some), np.logaddexp(0, whole) + np.logaddexp(0, some), np.logaddexp(0, whole) + np.logaddexp(0, -some)], axis=1)
    best = cost.tolist()  # by WHOLE, NONE, MIXED, of the unit and all below
    states: dict[int, list[int]] = {}  # of the children of a mixed unit
    for at in range(len(units) - 1, -1, -1):
        row, below = best[at], [best[x] for x in units[at].below]
        if not below:
            row[MIXED] = np.inf
            continue
        mixed, states[at] = mixture(below)
        row[WHOLE] += sum(c[WHOLE] for c in below)
        row[NONE] += sum(c[NONE] for c in below)
        row[MIXED] += mixed
    kept: list[int] = []
    stack = [(0, min(range(3), key=best[0].__getitem__))]
    while stack:
        at, state = stack.pop()
        u = units[at]
        if state == WHOLE and not u.below:
            kept += u.runs
        elif state == WHOLE:
            stack += [(x, WHOLE) for x in u.below]
        elif state == MIXED:
            stack += zip(u.below, states[at], strict=True)
    return sorted(kept)


@cache
def trained(pages: int = 500, seed: int = 0) -> tuple[Trees, Trees]:
    """The two sets of trees: all of a node's text is of the article; any is."""
    rows: list[list[float]] = []
    whole, some = [], []
    for k in range(pages):
        html, article = made_page(seed + k)
        nodes, runs = parse(html)
        units = units_of(nodes[0])
        left = list(article)
        main = set()
        for i, (_, text) in enumerate(runs):  # article blocks occur in page order
            if left and text == left[0]:
                main.add(i)
                left.pop(0)
        good, every = [0] * len(units), [0] * len(units)
        for at in range(len(units) - 1, -1, -1):
            u = units[at]
            if not u.below:
                good[at], every[at] = sum(i in main for i in u.runs), len(u.runs)
            if u.up >= 0:
                good[u.up] += good[at]
                every[u.up] += every[at]
        rows += features(units, len(runs))
        whole += [g == e for g, e in zip(good, every, strict=True)]
        some += [g > 0 for g in good]
    x = np.array(rows)
    one = np.ones(len(x))
    return fit(x, np.array(whole, float), one), fit(x, np.array(some, float), one)


def extract_batch(pages: list[str | None], models: tuple[Trees, Trees]) -> Iterator[list[str]]:
    """Article blocks of each page. Scores are computed for the nodes of all the pages together."""
    parsed = []
    rows: list[list[float]] = []
    for html in pages:
        nodes, runs = parse(html or "")
        units = units_of(nodes[0]) if runs else []
        rows += features(units, len(runs)) if runs else []
        parsed.append((units, runs))
    x = np.array(rows)
    whole, some = (m.margin(x) for m in models) if rows else (x, x)
    at = 0
    for units, runs in parsed:
        end = at + len(units)
        yield [runs[i][1] for i in decode(units, whole[at:end], some[at:end])] if units else []
        at = end


def main_text(html: Column) -> Column:
    """The article's blocks joined by two line feeds. A null or empty page, or one without an article, gives ''."""
    models = trained()

    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        out: list[str] = []
        for some in sliced(p.as_py() for p in pages):
            out += ["\n\n".join(blocks) for blocks in extract_batch(some, models)]
        return pa.array(out, pa.string())

    return run(html)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row; only page_id, url and html are read, so other columns may have any name.

    Null and empty pages, and pages without an article, give '' and 0. Repeated rows give repeated results, null ids and
    urls stay null, an empty table gives an empty one. Pages of any length, depth and width are read in whole; of equally
    likely labellings of a page the one with more whole nodes is taken, so reruns agree.
    """
    done = pages.select("page_id", "url", main_text(F.col("html")).alias("text"))
    return done.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
