"""Main text of web pages: boosted trees over the nodes of the page's tree, decoded down the tree.

Each block element gets features of its subtree, attributes, place and siblings and, from the trees, a
probability that it holds article text. The decoding picks the likeliest consistent choice: below a rejected
element nothing is kept. The trees are fitted on the driver to TRAIN_PAGES pages that ``sample_pages`` writes
by rule in many layouts, with labels known from the writing; no page of the input is needed for it.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import in_batches
from .html_dom import Node, parse
from .html_samples import sample_pages

TRAIN_PAGES = 500
SCHEMA = "page_id long, url string, text string"
_GROUPS = [
    {"article", "main"}, {"section"}, {"div"}, {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "menu", "dl"}, {"li", "dt", "dd"}, {"nav"}, {"header"}, {"footer"},
    {"aside"}, {"form", "fieldset", "legend", "dialog", "search"}, {"table", "tr", "td", "th", "tbody", "thead"}, {"blockquote", "pre"}, {"figure", "figcaption"}, {"body", "html", "#root"},
]
#: Words that class, id and role attributes are made of, by what they tell.
_TOKENS = [
    {"article", "content", "post", "entry", "story", "body", "main", "text", "prose", "page", "blog", "articlebody", "hentry"},
    {"nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "tabs", "skip"},
    {"footer", "copyright", "legal", "colophon", "bottom"}, {"header", "masthead", "banner", "top", "logo", "branding"},
    {"sidebar", "side", "aside", "widget", "related", "rail", "recommended", "popular", "trending", "complementary", "archive", "more"},
    {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "promoted", "adsense", "dfp", "commercial"},
    {"cookie", "cookies", "consent", "notice", "alert", "gdpr", "popup", "modal", "overlay", "toast", "announcement", "warning", "privacy"},
    {"comment", "comments", "reply", "replies", "respond", "disqus", "discussion", "thread", "reader", "readers", "feedback", "responses"},
    {"form", "login", "signup", "subscribe", "newsletter", "search", "register", "contact"},
    {"share", "social", "tags", "tag", "meta", "byline", "author", "bio", "follow", "sharing"},
]
_SPLIT = re.compile(r"[^a-z]+")


def _tokens(node: Node) -> set[str]:
    a = node.attrs
    raw = " ".join(a.get(k, "") for k in ("class", "id", "role", "itemprop"))
    raw = re.sub(r"([a-z])([A-Z])", r"\1 \2", raw)
    return set(_SPLIT.split(raw.lower())) - {""}


def features(source: str) -> tuple[list[Node], np.ndarray, list[tuple[int, str]]]:
    """Nodes in page order (parents before children), their features, and blocks as (node number, text)."""
    root, blocks = parse(source)
    nodes, number = [], {}
    todo = [root]
    while todo:
        n = todo.pop()
        number[id(n)] = len(nodes)
        nodes.append(n)
        todo += reversed(n.children)
    size = len(nodes)
    chars, words, links, runs, stops, long = (np.zeros(size) for _ in range(6))
    for node, text in blocks:
        k = number[id(node)]
        w = text.count(" ") + 1
        chars[k] += len(text)
        words[k] += w
        runs[k] += 1
        stops[k] += text.count(".") + text.count(",") + text.count("。")
        long[k] += w >= 15
    for k, n in enumerate(nodes):
        links[k] = min(n.links, chars[k])
    below = np.ones(size)
    own = chars.copy()
    first = np.full(size, float(len(blocks)))
    for i, (node, _) in enumerate(blocks):
        k = number[id(node)]
        first[k] = min(first[k], i)
    parent = np.array([number[id(n.parent)] if n.parent else -1 for n in nodes])
    for k in range(size - 1, 0, -1):
        p = parent[k]
        for x in (chars, words, links, runs, stops, long, below):
            x[p] += x[k]
        first[p] = min(first[p], first[k])
    total = max(chars[0], 1.0)
    groups = np.array([next((g for g, tags in enumerate(_GROUPS) if n.tag in tags), -1) for n in nodes])
    mine = np.array([[bool(t & g) for g in _TOKENS] for t in map(_tokens, nodes)], float)
    above = np.zeros_like(mine)
    over = np.zeros((size, len(_GROUPS)))
    for k in range(1, size):  # what stands on the way from the root
        p = parent[k]
        above[k] = np.maximum(above[p], mine[p])
        over[k] = over[p]
        if groups[p] >= 0:
            over[k, groups[p]] = 1
    biggest = np.zeros(size)
    for k in range(1, size):
        biggest[parent[k]] = max(biggest[parent[k]], chars[k])
    kids = np.array([len(n.children) for n in nodes], float)
    sibs = np.where(parent >= 0, kids[np.maximum(parent, 0)], 1.0)
    index = np.array([n.index for n in nodes], float)
    has_article = float(any(n.tag in ("article", "main") for n in nodes))
    one = np.zeros((size, len(_GROUPS)))
    one[np.arange(size)[groups >= 0], groups[groups >= 0]] = 1
    up = np.maximum(parent, 0)
    cols = [
        np.log1p(chars), np.log1p(words), links / np.maximum(chars, 1), runs, stops / np.maximum(words, 1), long, chars / total, chars / np.maximum(below, 1),
        own / np.maximum(chars, 1), np.array([n.depth for n in nodes], float), index, sibs, index / np.maximum(sibs - 1, 1), first / max(len(blocks), 1), below,
        words / np.maximum(runs, 1), chars / np.maximum(chars[up], 1), chars / np.maximum(biggest[up], 1), np.full(size, has_article), np.array([n.hidden for n in nodes], float),
        np.full(size, math.log1p(total)), links[up] / np.maximum(chars[up], 1), runs[up], long[up],
    ]
    return nodes, np.column_stack([*cols, one, over, mine, above]), [(number[id(n)], t) for n, t in blocks]


def decoded(parent: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The likeliest choice of kept nodes in which no kept node stands below a rejected one."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    without, gain = np.log(1 - p), np.log(p)
    best = np.zeros(len(p))  # of the children, when this node is kept
    for k in range(len(p) - 1, -1, -1):
        up = max(gain[k] + best[k], without[k])
        if parent[k] >= 0:
            without[parent[k]] += without[k]
            best[parent[k]] += up
    kept = np.zeros(len(p), bool)
    for k in range(len(p)):
        if parent[k] < 0 or kept[parent[k]]:
            kept[k] = parent[k] < 0 or gain[k] + best[k] >= without[k]
    return kept


def _parents(nodes: list[Node]) -> np.ndarray:
    number = {id(n): k for k, n in enumerate(nodes)}
    return np.array([number[id(n.parent)] if n.parent else -1 for n in nodes])


@functools.lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES) -> BoostedTrees:
    """The trees, fitted to a fixed number of written pages; always the same."""
    xs, ys = [], []
    for source, kept_texts in sample_pages(pages):
        nodes, x, blocks = features(source)
        parent, y = _parents(nodes), np.zeros(len(nodes))
        for k, text in blocks:
            if text in kept_texts:
                while k >= 0:
                    y[k] = 1
                    k = parent[k]
        xs.append(x)
        ys.append(y)
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys))


def extract(sources: list[str | None], model: BoostedTrees) -> Iterator[str]:
    """The main text of each page."""
    pages = [features(s or "") for s in sources]
    p = model.probability(np.concatenate([x for _, x, _ in pages])) if pages else np.zeros(0)
    at = 0
    for nodes, _, blocks in pages:
        kept = decoded(_parents(nodes), p[at : at + len(nodes)])
        at += len(nodes)
        yield "\n".join(t for k, t in blocks if kept[k] and not nodes[k].hidden)


def main_text(pages: DataFrame, html: str = "html", train_pages: int = TRAIN_PAGES) -> DataFrame:
    """page_id, url and the main text of every page's whole source.

    Null or empty source gives an empty text. Repeated rows each give a row, null ids and urls pass through,
    an empty table gives an empty result. Further columns are ignored.
    """
    model = pages.sparkSession.sparkContext.broadcast(trained(train_pages))

    def run(batches):
        for batch in batches:
            sources = batch.column(2).to_pylist()
            for a in range(0, len(sources), 100):
                part = batch.slice(a, 100)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(extract(sources[a : a + 100], model.value)), pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return in_batches(rows, run, SCHEMA)
