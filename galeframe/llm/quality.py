"""Operator 2, quality rules: document statistics, base rules and gradient-boosted trees.

The trees are grown here on a bounded sample of labelled documents, keep monotonic constraints on chosen
features, and are flattened into node arrays that score a whole batch at once.

Defined results: a null or empty text has no words (all statistics 0, base_failed). Rows are judged one by one, so
repeated rows get the same verdict each; extra columns are ignored. Without usable labels of both classes there is no
model and only the base rules decide.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import by_pieces
from galeframe.llm.kernel import SPACE_WORDS, Texts, counts, covered, grams, mix, repeated, valid_starts

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATS = [*BASE, "n_upper", "n_marks", "n_distinct_words", "n_lines"]
WINDOW = 8
#: Features of the trees, and how the estimate of quality may depend on each: -1 never rises with it, 0 free.
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "upper": -1, "marks": -1, "distinct": 0, "line_words": 0}


def document_stats(column) -> dict[str, np.ndarray]:
    """STATS of each text of an Arrow string column."""
    t = Texts(column, SPACE_WORDS)
    starts, ends, of = t.words()
    h = t.hashes(starts, ends)
    n = counts(of, t.n)
    whole = (t.raw & 0xC0) != 0x80
    out = {"n_words": n, "word_chars": t.per_text(whole & t.inside[t.raw])}
    for name, chars in (("n_symbols", b"[#*$%&|<>]"[1:-1]), ("n_upper", bytes(range(65, 91))), ("n_marks", b"!?")):
        flag = np.zeros(256, bool)
        flag[list(chars)] = True
        out[name] = t.per_text(flag[t.raw])
    ls, le, lo = t.lines()
    if len(starts):
        word = np.searchsorted(starts, ls)  # a line with a word has one that starts in it
        has = (word < len(starts)) & (starts[np.minimum(word, len(starts) - 1)] < le)
        ls, le, lo = ls[has], le[has], lo[has]
    else:
        ls, le, lo = ls[:0], le[:0], lo[:0]
    salt = mix(np.arange(t.n, dtype=np.uint64))
    key = t.hashes(ls, le, seed=1) ^ salt[lo]
    out["n_lines"] = counts(lo, t.n)
    out["n_dup_lines"] = out["n_lines"] - counts(lo[np.unique(key, return_index=True)[1]], t.n)
    out["n_distinct_words"] = counts(of[np.unique(h ^ salt[of], return_index=True)[1]], t.n)
    win = np.flatnonzero(valid_starts(of, WINDOW))
    again = win[repeated(grams(h, WINDOW)[win] ^ salt[of[win]])] if len(win) else win
    out["n_repeat_words"] = counts(of[covered(again, WINDOW, len(of))], t.n)
    return out


def base_failed(s: dict) -> np.ndarray:
    return (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])


def features(s: dict) -> np.ndarray:
    w = np.maximum(s["n_words"], 1)
    cols = [np.log1p(s["n_words"]), s["word_chars"] / w, s["n_symbols"] / w, s["n_dup_lines"] / np.maximum(s["n_lines"], 1), s["n_repeat_words"] / w, s["n_upper"] / np.maximum(s["word_chars"], 1), s["n_marks"] / w, s["n_distinct_words"] / w, s["n_words"] / np.maximum(s["n_lines"], 1)]
    return np.stack([np.asarray(c, dtype=np.float64) for c in cols], axis=1)


@dataclass
class Trees:
    """All trees in one set of node arrays; roots are their first nodes. A leaf points to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


@dataclass
class _Grower:
    x: np.ndarray
    bins: list
    code: np.ndarray
    signs: list
    depth: int
    ridge: float
    rate: float
    nodes: list = field(default_factory=list)

    def grow(self, rows, g, h, level=0, low=-np.inf, high=np.inf) -> int:
        me = len(self.nodes)
        self.nodes.append(None)
        weight = lambda gs, hs: -gs / (hs + self.ridge)
        best = (1e-6, None)
        if level < self.depth and len(rows) >= 10:
            G, H = g[rows].sum(), h[rows].sum()
            for f, sign in enumerate(self.signs):
                k = len(self.bins[f]) + 1
                gl = np.cumsum(np.bincount(self.code[rows, f], g[rows], k))[:-1]
                hl = np.cumsum(np.bincount(self.code[rows, f], h[rows], k))[:-1]
                nl = np.cumsum(np.bincount(self.code[rows, f], minlength=k))[:-1]
                wl, wr = np.clip(weight(gl, hl), low, high), np.clip(weight(G - gl, H - hl), low, high)
                score = lambda w, gs, hs: -(gs * w + 0.5 * (hs + self.ridge) * w * w)
                gain = score(wl, gl, hl) + score(wr, G - gl, H - hl) - score(np.clip(weight(G, H), low, high), G, H)
                gain[(nl < 5) | (len(rows) - nl < 5) | (sign * (wr - wl) < 0)] = -1
                if len(gain) and gain.max() > best[0]:
                    c = int(gain.argmax())
                    best = (gain[c], (f, c, wl[c], wr[c]))
        if best[1] is None:
            value = float(np.clip(weight(g[rows].sum(), h[rows].sum()), low, high)) * self.rate
            self.nodes[me] = (0, np.inf, me, me, value)
            return me
        f, c, wl, wr = best[1]
        goes = self.code[rows, f] <= c
        mid, sign = (wl + wr) / 2, self.signs[f]
        bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high),) * 2}[sign]
        a = self.grow(rows[goes], g, h, level + 1, *bounds[0])
        b = self.grow(rows[~goes], g, h, level + 1, *bounds[1])
        self.nodes[me] = (f, self.bins[f][c], a, b, 0.0)
        return me


def fit_trees(x: np.ndarray, y: np.ndarray, signs=None, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, bins: int = 48) -> Trees | None:
    """Logistic boosting with histogram splits. signs: the monotonic constraint of each feature. None if y has one class."""
    if len(y) < 20 or y.min() == y.max():
        return None
    signs = list(FEATURES.values()) if signs is None else list(signs)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    rate0 = y.mean()
    base = float(np.log(rate0 / (1 - rate0)))
    grower, roots, m = _Grower(x, cuts, code, signs, depth, ridge, rate), [], np.full(len(y), base)
    model = None
    for _ in range(trees):
        p = 1 / (1 + np.exp(-m))
        first = len(grower.nodes)
        roots.append(grower.grow(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-6)))
        f, t, a, b, v = (np.array(z) for z in zip(*grower.nodes, strict=True))
        model = Trees(base, np.array(roots), f, t, a, b, v, depth)
        one = Trees(0.0, np.array([first]), f, t, a, b, v, depth)
        m = m + one.margin(x)
    return model


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> Trees | None:
    """Fits the trees on at most most_labelled labelled ids, the first by hash, whatever the size of the corpus."""
    y = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg((F.avg("quality") >= 0.5).cast("int").alias("_y"))
    sample = y.orderBy(F.xxhash64(id_col), id_col).limit(most_labelled)
    # One text for each id (the first in order, where an id has several), so that what reaches the driver is bounded.
    picked = docs.select(id_col, text_col).join(F.broadcast(sample), id_col).groupBy(id_col, "_y").agg(F.min(text_col).alias(text_col))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = document_stats(batch.column(0))
        return pa.RecordBatch.from_arrays([pa.array(s[k], pa.int64()) for k in STATS] + [batch.column(1)], names=[*STATS, "_y"])

    got = picked.select(text_col, "_y").mapInArrow(by_pieces(run, text_col), ", ".join(f"{k} long" for k in STATS) + ", _y int").toPandas()
    s = {k: got[k].to_numpy() for k in STATS}
    use = ~base_failed(s)
    x, label = features(s)[use], got["_y"].to_numpy().astype(float)[use]
    order = np.lexsort([*x.T, label])  # the order in which Spark hands rows over doesn't matter
    return fit_trees(x[order], label[order])


def judge(docs: DataFrame, model: Trees | None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, BASE, base_failed, kept, the other STATS and quality (null without a model), a row for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = document_stats(batch.column(1))
        bad = base_failed(s)
        p = model.probability(features(s)) if model else np.full(len(bad), np.nan)
        longs = lambda names: [pa.array(s[k], pa.int64()) for k in names]
        cols = [batch.column(0), *longs(BASE), pa.array(bad), pa.array(~bad & ~(p < threshold)), *longs(more), pa.array(p, mask=np.isnan(p))]
        return pa.RecordBatch.from_arrays(cols, names=[id_col, *BASE, "base_failed", "kept", *more, "quality"])

    more = STATS[len(BASE) :]
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, kept boolean, " + ", ".join(f"{k} long" for k in more) + ", quality double"
    return docs.select(id_col, text_col).mapInArrow(by_pieces(run, text_col), schema)


def keep(docs: DataFrame, model: Trees | None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, in one pass without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = document_stats(batch.column(at))
        ok = ~base_failed(s)
        if model:
            ok &= ~(model.probability(features(s)) < threshold)
        return batch.filter(pa.array(ok))

    return docs.mapInArrow(by_pieces(run, text_col), docs.schema)
