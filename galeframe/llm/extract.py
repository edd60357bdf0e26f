"""Operator 7, HTML extraction: a tree-structured graphical model over the block elements of a page.

Each block element has a hidden state: does it hold a part of the article? Potentials of the elements come from their
tag, the words of their class and id, their text and link statistics; parent-child potentials connect them. Messages
pass upward from the leaves and downward from the root (sum-product), level by level for all pages of a batch, and
give each element's marginal. The weights are trained here by maximum likelihood on labelled pages, whose gradient
takes the same messages. The text blocks of elements with a marginal over one half, in page order, are the main text.

Defined results: a null or empty html has the empty text; malformed or cut-off html is read as far as it goes; repeated rows
get their result each; extra columns are ignored; nothing is dropped for its length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import by_pieces
from galeframe.llm.html_tree import Page
from galeframe.llm.page_samples import MAIN, REST, labelled

TAGS = {t: i for i, t in enumerate("#root html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside form fieldset button menu table tbody thead tr td th blockquote pre figure figcaption address details summary".split())}
#: Words of class, id and role attributes, in groups that share a weight each.
WORDS = {
    "navigation": "nav navigation navbar menu breadcrumb breadcrumbs topnav topbar pagination pager toc skip",
    "header": "header masthead branding logo banner top hero",
    "footer": "footer copyright legal bottom contentinfo colophon imprint",
    "side": "sidebar side aside rail widget widgets related recommended recommendations more complementary trending popular",
    "notice": "notice notices cookie cookies consent gdpr alert alerts popup modal overlay newsletter subscribe subscription paywall message disclaimer warning toast",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promos promotion promoted dfp adsense adslot",
    "form": "form search login signup signin contact register",
    "share": "share sharing social tags toolbar links follow",
    "comment": "comment comments discussion disqus response responses reply replies respond feedback",
    "article": "article content post entry story text body main news blog page",
}
_GROUP = {w: i for i, words in enumerate(WORDS.values()) for w in words.split()}
_TAG_GROUP = {tag: list(WORDS).index(group) for tag, group in {"nav": "navigation", "header": "header", "footer": "footer", "aside": "side", "form": "form"}.items()}
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_NUMBERS = ["bias", "own_text", "own_long", "subtree", "own_links", "subtree_links", "sentence", "in_group", "place", "leaf"]
N_FEATURES = len(TAGS) + 1 + 2 * len(WORDS) + len(_NUMBERS)


@lru_cache(maxsize=4096)
def _groups(name: str) -> tuple[int, ...]:
    return tuple(sorted({_GROUP[w.lower()] for w in _SPLIT.split(name) if w and w.lower() in _GROUP}))


@dataclass
class Forest:
    """The elements of many pages; parents come before their children."""

    parent: np.ndarray
    depth: np.ndarray
    edge: np.ndarray
    features: np.ndarray

    def levels(self) -> list[np.ndarray]:
        return _levels(self.depth)


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    """The elements of each depth."""
    return np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1])


def forest(pages: list[Page]) -> tuple[Forest, np.ndarray]:
    """All elements of the pages, and the first of each page."""
    sizes = np.array([len(p.tag) for p in pages])
    first = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    parent = np.concatenate([np.array(p.parent) + f * (np.array(p.parent) >= 0) for p, f in zip(pages, first, strict=True)])
    tag = np.array([TAGS.get(t, len(TAGS)) for p in pages for t in p.tag])
    names = [_groups(x) if x else () for p in pages for x in p.name]
    depth = np.array([d for p in pages for d in p.depth])
    own, links, ends = np.zeros(n), np.zeros(n), np.zeros(n)
    for p, f in zip(pages, first, strict=True):
        for node, text, linked in p.blocks:
            own[f + node] += len(text)
            links[f + node] += linked
            ends[f + node] += text[-1] in ".!?:\"'”»"
    total, total_links = own.copy(), links.copy()
    levels = _levels(depth)
    x = np.zeros((n, N_FEATURES), dtype=np.float32)
    x[np.arange(n), tag] = 1
    mine, t, g = slice(len(TAGS) + 1, len(TAGS) + 1 + len(WORDS)), len(TAGS) + 1, len(WORDS)
    for i, found in enumerate(names):
        for k in found:
            x[i, t + k] = 1
    said = x[:, mine].copy()
    for name, group in _TAG_GROUP.items():
        said[tag == TAGS[name], group] = 1
    for level in levels[1:]:  # what the elements around it are called
        x[level, t + g : t + 2 * g] = np.maximum(x[parent[level], t + g : t + 2 * g], said[parent[level]])
    for level in reversed(levels[1:]):
        np.add.at(total, parent[level], total[level])
        np.add.at(total_links, parent[level], total_links[level])
    k = t + 2 * g
    page_size = np.repeat(sizes, sizes)
    leaf = np.ones(n)
    leaf[parent[parent >= 0]] = 0
    bounds = np.repeat(total[first], sizes)
    x[:, k:] = np.stack([np.ones(n), np.log1p(own) / 5, own > 80, np.log1p(total) / 7, links / np.maximum(own, 1), total_links / np.maximum(total, 1), ends > 0, total / np.maximum(bounds, 1), (np.arange(n) - np.repeat(first, sizes)) / page_size, leaf], axis=1)
    return Forest(parent, depth, (own > 0).astype(np.int64), x), first


@dataclass
class Model:
    """Weights of the elements' features, and log potentials of (text or not) x parent state x child state."""

    weights: np.ndarray
    pairs: np.ndarray

    def marginals(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """P(state) of each element, and P(parent state, child state) of each edge, by sum-product."""
        n = len(f.parent)
        node = np.zeros((n, 2))
        node[:, 1] = f.features @ self.weights
        up, levels = np.zeros((n, 2)), f.levels()
        inner = node.copy()
        for level in reversed(levels[1:]):  # leaves to root
            m = np.logaddexp(self.pairs[f.edge[level], :, 0] + inner[level, None, 0], self.pairs[f.edge[level], :, 1] + inner[level, None, 1])
            up[level] = m
            np.add.at(inner, f.parent[level], m)
        belief, joint = inner.copy(), np.zeros((n, 2, 2))
        for level in levels[1:]:  # root to leaves
            above = belief[f.parent[level]] - up[level]
            j = above[:, :, None] + self.pairs[f.edge[level]] + inner[level][:, None, :]
            belief[level] = np.logaddexp(j[:, 0], j[:, 1])
            j -= j.max(axis=(1, 2), keepdims=True)
            e = np.exp(j)
            joint[level] = e / e.sum(axis=(1, 2), keepdims=True)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), joint


def train_model(pages: list[str] | None = None, steps: int = 160, rate: float = 0.15, ridge: float = 1e-5) -> Model:
    """Maximum likelihood on marked pages (page_samples when none are given)."""
    read, states = [], []
    for html in pages if pages is not None else labelled(500):
        page = Page(html)
        main = np.zeros(len(page.tag), np.int64)
        for node, text, _ in page.blocks:
            while node >= 0 and MAIN in text and not main[node]:
                main[node] = 1  # an element holds a part of the article if one in it does
                node = page.parent[node]
        page.blocks = [(i, text.replace(MAIN, "").replace(REST, "").strip() or "-", linked) for i, text, linked in page.blocks]
        read.append(page)
        states.append(main)
    f, _ = forest(read)
    y = np.concatenate(states)
    model = Model(np.zeros(N_FEATURES), np.zeros((2, 2, 2)))
    child = np.flatnonzero(f.parent >= 0)
    seen = np.zeros((len(y), 2, 2))
    seen[child, y[f.parent[child]], y[child]] = 1
    parameters = [model.weights, model.pairs]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for step in range(1, steps + 1):
        p, joint = model.marginals(f)
        change = (seen - joint)[child]
        edges = np.stack([change[f.edge[child] == k].sum(axis=0) for k in range(2)])
        for k, gradient in enumerate((f.features.T @ (y - p[:, 1]) / len(y) - ridge * model.weights, edges / len(y) - ridge * model.pairs)):
            first[k] = 0.9 * first[k] + 0.1 * gradient
            second[k] = 0.99 * second[k] + 0.01 * gradient**2
            parameters[k] += rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


@lru_cache(maxsize=1)
def default_model() -> Model:
    """The model of the generated pages, trained once a session."""
    return train_model()


def main_texts(model: Model, htmls: list) -> list[str]:
    pages = [Page(h or "") for h in htmls]
    if not pages:
        return []
    f, first = forest(pages)
    main = model.marginals(f)[0][:, 1] > 0.5
    return [" ".join(text for node, text, _ in page.blocks if main[at + node]) for page, at in zip(pages, first, strict=True)]


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars, a row for each row of pages."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = main_texts(model, batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(by_pieces(run, html_col), f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
