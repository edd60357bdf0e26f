"""Gradient-boosted regression with monotonic constraints: histogram trees, any number of models grown side by side.

Spark ML's trees have no such constraints and fit one model at a time. Here rows stay on the executors, coded as bin
numbers. A model is a fold, a quantile, a feature set or a trial; a row names the models that it trains. Models are
grown in lots. Models of up to TASK_ROWS rows are dealt to tasks, a lot to each, since hundreds of deep trees would be
thousands of jobs. For larger ones, one job for each level of a tree sums the gradients by (model, node, feature, bin):
each task adds up its rows in NumPy arrays, the sums meet in an aggregate, and the driver picks the splits of all models
from a table whose size depends on models, nodes and bins, not on rows. Both grow the same trees. Only nodes that can
still be split have sums, some nodes at a time, so that the sums stay below MOST_CELLS or TASK_CELLS.

Absolute loss is the default: the gradient is the sign of the error, and a leaf gives the median error of its rows,
held within what the constraints allow.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.operators.cut import Scratch
from galeframe.operators.networks import uniform

#: Fitted settings of a model. loss: absolute or squared; rows, columns: the part of both that a tree sees.
PARAMETERS = {"trees": 100, "depth": 4, "rate": 0.1, "ridge": 1.0, "least": 5, "rows": 1.0, "columns": 1.0}
#: Sums (of one model, node, feature and bin) that the driver holds at a time, and a task that grows models.
MOST_CELLS, TASK_CELLS = 4_000_000, 400_000
#: Rows of a lot that is grown in a task.
TASK_ROWS = 50_000
#: Trees after which the margins of the rows are written.
MARGIN_TREES = 10
BINS = 64


@dataclass
class Boosted:
    """Trees as node arrays; a leaf's feature is -1, and a right child follows the left. NaN goes left or right as learned (missing)."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    missing: np.ndarray
    value: np.ndarray
    depth: int
    gain: np.ndarray
    weight: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, some = np.empty(len(x)), max(1, (1 << 20) // max(1, len(self.roots)))
        for a in range(0, len(x), some):
            part = x[a : a + some]
            rows, node = np.arange(len(part))[:, None], np.repeat(self.roots[None], len(part), axis=0)
            for _ in range(self.depth):
                f = self.feature[node]
                v = part[rows, f]
                node = np.where(f < 0, node, self.left[node] + np.where(np.isnan(v), self.missing[node], v > self.threshold[node]))
            out[a : a + some] = np.cumsum(np.column_stack([np.full(len(part), self.base), self.value[node]]), axis=1)[:, -1]
        return out

    def packed(self) -> bytes:
        return zlib.compress(pickle.dumps(self), 1)

    def importance(self) -> list[tuple[int, float, float]]:
        """(feature, total gain, splits)"""
        return [(i, float(g), float(w)) for i, (g, w) in enumerate(zip(self.gain, self.weight, strict=True))]


@dataclass
class Lot:
    """Settings of the models of a lot, an array entry for each."""

    trees: np.ndarray
    depth: np.ndarray
    rate: np.ndarray
    ridge: np.ndarray
    least: np.ndarray
    rows: np.ndarray
    columns: np.ndarray
    features: np.ndarray  # models x features: may the model use it?
    number: np.ndarray  # among all models
    signs: np.ndarray
    loss: str
    seed: int

    @property
    def n(self) -> int:
        return len(self.trees)


@dataclass
class Tree:
    """One tree of each model of a lot, as arrays of models and nodes. A model's nodes are numbered level by level, and a right child follows the left; a leaf's feature is -1. slot: where the sums of a node are at the moment, or -1."""

    number: int
    feature: np.ndarray
    cut: np.ndarray
    missing: np.ndarray
    left: np.ndarray
    value: np.ndarray
    slot: np.ndarray
    splits: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # (models, nodes) of each level

    @staticmethod
    def of_roots(number: int, n: int) -> Tree:
        return Tree(number, np.full((n, 1), -1, np.int16), np.zeros((n, 1), np.uint8), np.zeros((n, 1), bool), np.zeros((n, 1), np.int32), np.zeros((n, 1)), np.full((n, 1), -1, np.int32))

    def widen(self, nodes: int) -> None:
        """Makes room for so many nodes of each model."""
        for name, fill in (("feature", -1), ("cut", 0), ("missing", False), ("left", 0), ("value", 0.0), ("slot", -1)):
            setattr(self, name, widened(getattr(self, name), nodes, fill))

    def step(self, codes: np.ndarray, row: np.ndarray, model: np.ndarray, node: np.ndarray) -> np.ndarray:
        """One level down, for each pair of row and model."""
        f = self.feature[model, node]
        c = codes[row, f]
        right = np.where(c == BINS, self.missing[model, node], c > self.cut[model, node])
        return np.where(f < 0, node, self.left[model, node] + right)

    def place(self, codes: np.ndarray, row: np.ndarray, model: np.ndarray) -> np.ndarray:
        """The node of each pair of row and model, as far as the tree is grown."""
        node = np.zeros(len(row), np.int64)
        for _ in self.splits:
            node = self.step(codes, row, model, node)
        return node


def widened(x: np.ndarray, nodes: int, fill: float) -> np.ndarray:
    return np.concatenate([x, np.full((len(x), nodes - x.shape[1]), fill, x.dtype)], axis=1)


def seen(row_id: np.ndarray, tree: int, lot: Lot, model: np.ndarray) -> np.ndarray:
    """Which pairs a tree sees, by a hash of the row and the tree."""
    with np.errstate(over="ignore"):
        h = (row_id.astype(np.uint64) + np.uint64(tree * 2 + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)).astype(float) / 2**53 < lot.rows[model]


def gradient(loss: str, margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sign(margin - y) if loss == "absolute" else margin - y


def sums(tree: Tree, slots: int, codes: np.ndarray, row: np.ndarray, model: np.ndarray, node: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradients, rows) by slot, feature and bin, flat."""
    nf = codes.shape[1]
    size = slots * nf * (BINS + 1)
    g, n = np.zeros(size), np.zeros(size)
    for a in range(0, len(row), 1 << 18):
        at = slice(a, a + (1 << 18))
        slot = tree.slot[model[at], node[at]].astype(np.int64)
        use = slot >= 0
        cell = ((slot[use][:, None] * nf + np.arange(nf)) * (BINS + 1) + codes[row[at][use]]).ravel()
        g += np.bincount(cell, np.repeat(grad[at][use], nf), size)
        n += np.bincount(cell, minlength=size)
    return g, n


def choose(lot: Lot, m: np.ndarray, g: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gain, feature, cut, missing, left weight, right weight, rows left, rows) of the best split of each slot; gain is 0 where none is good.

    m: the slots' models. g, n: slots x features x bins. Of equal gains the first feature counts, then missing values to the left, then the lowest cut.
    """
    ridge, least = lot.ridge[m][:, None, None], lot.least[m][:, None, None]
    lo, hi = low[:, None, None], high[:, None, None]
    G, N = g[:, :1].sum(axis=2, keepdims=True), n[:, :1].sum(axis=2, keepdims=True)
    weight = lambda a, b: np.clip(-a / (b + ridge), lo, hi)
    score = lambda w, a, b: -(a * w + 0.5 * (b + ridge) * w * w)
    here = score(weight(G, N), G, N)
    options = []
    for lost in (0, 1) if n[..., BINS:].any() else (0,):
        gl, nl = np.cumsum(g[..., :BINS], axis=2)[..., :-1], np.cumsum(n[..., :BINS], axis=2)[..., :-1]
        if lost == 0:
            gl, nl = gl + g[..., BINS:], nl + n[..., BINS:]
        wl, wr = weight(gl, nl), weight(G - gl, N - nl)
        gains = score(wl, gl, nl) + score(wr, G - gl, N - nl) - here
        bad = (nl < least) | (N - nl < least) | (lot.signs[None, :, None] * (wr - wl) < 0) | ~allowed[m][:, :, None]
        if lost:
            bad |= n[..., BINS:] == 0
        options.append((np.where(bad, -1.0, gains), wl, wr, nl))
    gains, wl, wr, nl = (np.stack([o[k] for o in options], axis=2) for k in range(4))
    shape = gains.shape  # slots, features, lost, cuts
    best = gains.reshape(len(m), -1).argmax(axis=1)
    pick = lambda x: x.reshape(len(m), -1)[np.arange(len(m)), best]
    gain, (f, lost, k) = pick(gains), np.unravel_index(best, shape[1:])
    return np.where(gain > 1e-9, gain, 0.0), f, k, lost, pick(wl), pick(wr), pick(nl), N[:, 0, 0]


def held(tree: Tree, median: np.ndarray, count: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Leaf values from the leaves' medians: below a split with a constraint, the leaves on one side are kept to one side of the point between both sides' means."""
    total, rows = np.where(tree.feature < 0, median * count, 0.0), np.where(tree.feature < 0, count, 0.0)
    for m, i in reversed(tree.splits):
        left = tree.left[m, i]
        total[m, i], rows[m, i] = total[m, left] + total[m, left + 1], rows[m, left] + rows[m, left + 1]
    mean = total / np.maximum(rows, 1)
    low, high = np.full(median.shape, -np.inf), np.full(median.shape, np.inf)
    for m, i in tree.splits:
        left, sign = tree.left[m, i], signs[tree.feature[m, i]]
        mid = np.clip((mean[m, left] + mean[m, left + 1]) / 2, low[m, i], high[m, i])
        for child, upper in ((left, 1), (left + 1, -1)):
            low[m, child] = np.where(sign == -upper, mid, low[m, i])
            high[m, child] = np.where(sign == upper, mid, high[m, i])
    return np.clip(median, low, high)


Sums = Callable[[Tree, int], tuple[np.ndarray, np.ndarray]]
Medians = Callable[[Tree], tuple[np.ndarray, np.ndarray]]


def grow(lot: Lot, nf: int, start: Callable[[Tree], None], level_sums: Sums, medians: Medians, done: Callable[[Tree], None], gain: np.ndarray, weight: np.ndarray, cells: int) -> None:
    """Grows the lot's trees; start is handed each new one, done each finished one. gain, weight: models x features, added to. cells: sums at a time."""
    some = max(1, cells // (nf * (BINS + 1)))
    for number in range(int(lot.trees.max(initial=0))):
        tree, live = Tree.of_roots(number, lot.n), number < lot.trees
        start(tree)
        draw = uniform(lot.number[:, None] * 65537 + np.arange(nf), lot.seed, number)
        part = np.maximum(1, np.round(lot.columns * lot.features.sum(axis=1))).astype(int)
        order = np.argsort(np.argsort(np.where(lot.features, draw, 2.0), axis=1), axis=1)
        allowed = lot.features & (order < part[:, None])
        low, high, nodes = np.full((lot.n, 1), -np.inf), np.full((lot.n, 1), np.inf), np.ones(lot.n, int)
        m = np.flatnonzero(live & (lot.depth > 0))
        i = np.zeros(len(m), int)
        while len(m):  # the nodes of a level that can be split
            found = []
            for a in range(0, len(m), some):
                b, j = m[a : a + some], i[a : a + some]
                tree.slot[b, j] = np.arange(len(b))
                g, n = (x.reshape(len(b), nf, BINS + 1) for x in level_sums(tree, len(b)))
                tree.slot[b, j] = -1
                if not tree.splits:
                    tree.value[b, 0] = -g[:, 0].sum(axis=1) / (n[:, 0].sum(axis=1) + lot.ridge[b])
                found.append(choose(lot, b, g, n, low[b, j], high[b, j], allowed))
            got, f, cut, lost, wl, wr, nl, rows = (np.concatenate(x) for x in zip(*found, strict=True))
            ok = got > 0
            if not ok.any():
                break
            m, i, got, f, cut, lost, wl, wr, nl, rows = (x[ok] for x in (m, i, got, f, cut, lost, wl, wr, nl, rows))
            pairs = np.bincount(m, minlength=lot.n)
            left = nodes[m] + 2 * (np.arange(len(m)) - (np.cumsum(pairs) - pairs)[m])
            nodes += 2 * pairs
            tree.widen(int(nodes.max()))
            low, high = widened(low, int(nodes.max()), -np.inf), widened(high, int(nodes.max()), np.inf)
            tree.feature[m, i], tree.cut[m, i], tree.missing[m, i], tree.left[m, i] = f, cut, lost, left
            np.add.at(gain, (m, f), got)
            np.add.at(weight, (m, f), 1)
            sign, mid = lot.signs[f], (wl + wr) / 2
            for child, w, upper in ((left, wl, 1), (left + 1, wr, -1)):
                tree.value[m, child] = w
                low[m, child] = np.where(sign == -upper, mid, low[m, i])
                high[m, child] = np.where(sign == upper, mid, high[m, i])
            tree.splits.append((m, i))
            m, i, rows = np.repeat(m, 2), np.stack([left, left + 1], axis=1).ravel(), np.stack([nl, rows - nl], axis=1).ravel()
            more = (rows >= 2 * lot.least[m]) & (len(tree.splits) < lot.depth[m])
            m, i = m[more], i[more]
        if lot.loss == "absolute":
            tree.value = held(tree, *medians(tree), lot.signs)
        tree.value = np.where(live[:, None], tree.value * lot.rate[:, None], 0.0)
        done(tree)


def grow_here(lot: Lot, codes: np.ndarray, y: np.ndarray, row_id: np.ndarray, row: np.ndarray, model: np.ndarray, base: np.ndarray) -> tuple[list[Tree], np.ndarray, np.ndarray]:
    """(trees, gain, weight) of a lot, grown in this task. row, model: which rows train which models; base: where each model starts."""
    trees, nf = [], codes.shape[1]
    margin, node = base[model], np.zeros(len(row), np.int64)
    use, grad, level = np.zeros(0, int), np.zeros(0), 0

    def start(tree: Tree) -> None:
        nonlocal node, use, grad, level
        node, level = np.zeros(len(row), np.int64), 0
        use = np.flatnonzero(seen(row_id[row], tree.number, lot, model))
        grad = gradient(lot.loss, margin[use], y[row[use]])

    def placed(tree: Tree) -> np.ndarray:
        nonlocal node, level
        while level < len(tree.splits):
            node, level = tree.step(codes, row, model, node), level + 1
        return node

    def level_sums(tree: Tree, slots: int) -> tuple[np.ndarray, np.ndarray]:
        return sums(tree, slots, codes, row[use], model[use], placed(tree)[use], grad)

    def medians(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
        shape = tree.value.shape
        leaf, error = model[use] * shape[1] + placed(tree)[use], y[row[use]] - margin[use]
        order, count = np.lexsort((error, leaf)), np.bincount(leaf, minlength=tree.value.size)
        which = np.flatnonzero(count)
        median = np.zeros(tree.value.size)
        median[which] = error[order][(np.cumsum(count) - count)[which] + (count[which] - 1) // 2]
        return median.reshape(shape), count.reshape(shape)

    def done(tree: Tree) -> None:
        nonlocal margin
        margin = margin + tree.value[model, placed(tree)]
        trees.append(tree)

    gain, weight = np.zeros((lot.n, nf)), np.zeros((lot.n, nf))
    grow(lot, nf, start, level_sums, medians, done, gain, weight, TASK_CELLS)
    return trees, gain, weight


def _model(trees: list[Tree], m: int, base: float, cuts: list[np.ndarray], gain: np.ndarray, weight: np.ndarray) -> Boosted:
    """The trees of model m, with thresholds in place of bin numbers."""
    ends = np.full((len(cuts) + 1, BINS), np.inf)
    for f, c in enumerate(cuts):
        ends[f, : len(c)] = c[:BINS]
    roots, parts, first = [], [], 0
    for t in trees:
        n = 1 + 2 * int((t.feature[m] >= 0).sum())
        f = t.feature[m, :n]
        roots.append(first)
        parts.append((f, ends[f, t.cut[m, :n]], (t.left[m, :n] + first).astype(np.int32), t.missing[m, :n], np.where(f < 0, t.value[m, :n], 0.0)))
        first += n
    if not parts:
        parts = [(np.full(1, -1, np.int16), np.full(1, np.inf), np.zeros(1, np.int32), np.zeros(1, bool), np.zeros(1))]
    feature, threshold, left, missing, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Boosted(float(base), np.array(roots, int), feature, threshold, left, missing, value, max((len(t.splits) for t in trees), default=0), gain, weight)


def code(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin numbers; a bin ends with its cut, and BINS stands for a missing value."""
    return np.stack([np.where(np.isnan(x[:, f]), BINS, np.searchsorted(c, x[:, f], side="left")) for f, c in enumerate(cuts)], axis=1).astype(np.uint8)


def like(lists: pa.ListArray, values: np.ndarray) -> pa.ListArray:
    """Lists as long as the given ones."""
    ends = lists.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(values))


def lower_median(x: np.ndarray) -> float:
    return float(np.sort(x)[(len(x) - 1) // 2]) if len(x) else 0.0


def _lot(settings: list[dict], features: list[list[int]], signs: list[int], loss: str, seed: int, number: list[int]) -> Lot:
    full = [PARAMETERS | settings[k] for k in number]
    used = np.zeros((len(full), len(signs)), bool)
    for m, k in enumerate(number):
        used[m, features[k]] = True
    return Lot(**{k: np.array([s[k] for s in full]) for k in PARAMETERS}, features=used, number=np.array(number, int), signs=np.array(signs, int), loss=loss, seed=seed)


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int] | None = None, seed: int = 0, loss: str = "absolute", **settings) -> Boosted:
    """One model on arrays, grown as those on a table are. monotone: 1 rising, -1 falling, 0 free, for each feature."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    signs = list(monotone or [0] * x.shape[1])
    cuts = [np.unique(np.nanquantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="inverted_cdf")) if np.isfinite(x[:, f]).any() else np.zeros(0) for f in range(x.shape[1])]
    lot, rows = _lot([settings], [list(range(x.shape[1]))], signs, loss, seed, [0]), np.arange(len(y))
    base = lower_median(y) if loss == "absolute" else float(y.mean()) if len(y) else 0.0
    trees, gain, weight = grow_here(lot, code(x, cuts), y, rows, rows, np.zeros(len(y), int), np.array([base]))
    return _model(trees, 0, base, cuts, gain[0], weight[0])


class Table:
    """A batch of coded rows: pairs of row and model in place of the arrays of models. of: the numbers of the models wanted, ascending."""

    def __init__(self, batch: pa.RecordBatch, nf: int, of: np.ndarray):
        col = lambda name: batch.column(batch.schema.get_field_index(name))
        flat = lambda c: c.flatten().to_numpy(zero_copy_only=False)
        self.row_id, self.y = (col(c).to_numpy(zero_copy_only=False) for c in ("row_id", "y"))
        self.codes = np.frombuffer(b"".join(col("codes").to_pylist()), np.uint8).reshape(-1, nf)
        row = np.repeat(np.arange(batch.num_rows), np.diff(col("models").offsets.to_numpy()))
        number, margin = flat(col("models")), flat(col("margin"))
        model = np.minimum(np.searchsorted(of, number), len(of) - 1)
        use = of[model] == number
        self.row, self.model, self.margin, self.use = row[use], model[use], margin[use], use

    def add(self, trees: list[Tree]) -> np.ndarray:
        for t in trees:
            self.margin = self.margin + t.value[self.model, t.place(self.codes, self.row, self.model)]
        return self.margin


def fit_many(rows: DataFrame, names: list[str], signs: list[int], settings: list[dict], features: list[list[int]] | None = None, loss: str = "absolute", seed: int = 0, target: str = "y", key: Column | None = None) -> list[Boosted | None]:
    """As many models as settings. rows: the features, the target, and models array<int>, the numbers of the models that the row trains.

    A number twice in the array counts twice. Missing features have a bin of their own; rows without a target or models
    are left out; a model without rows is None. key tells rows apart when a tree sees a part of them only. Bins end at
    quantiles of all the rows and a model starts from a median, by sketches whose ranks are off by 1 in 100,000 rows at
    most; the medians of leaves, where models are grown by jobs, by 1 in 10,000 of the leaf's rows.
    """
    nf, spark = len(names), rows.sparkSession
    x = [F.col(c).cast("double") for c in names]
    rows = rows.where(F.col(target).isNotNull() & (F.size("models") > 0))
    found = rows.agg(*[F.percentile_approx(c, [k / BINS for k in range(1, BINS)], 100_000).alias(f"q{i}") for i, c in enumerate(x)]).first()
    cuts = [np.unique(np.array(found[i] or [], float)) for i in range(nf)]
    each = rows.select(F.explode("models").alias("model"), F.col(target).cast("double").alias("y")).groupBy("model")
    start = each.agg(F.percentile_approx("y", 0.5, 100_000).alias("base") if loss == "absolute" else F.avg("y").alias("base"), F.count("*").alias("rows")).collect()  # a row for each model
    bases, sizes = ({r["model"]: r[k] for r in start if r["model"] < len(settings)} for k in ("base", "rows"))
    out: list[Boosted | None] = [None] * len(settings)
    if not bases:
        return out
    base = np.array([bases.get(m, 0.0) for m in range(len(settings))], float)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes = code(np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[3:]], axis=1), cuts)
            models = b.column(1)
            margin = like(models, base[models.flatten().to_numpy(zero_copy_only=False)])
            yield pa.RecordBatch.from_arrays([b.column(0), models, pa.array([r.tobytes() for r in codes], pa.binary()), b.column(2), margin], ["row_id", "models", "codes", "y", "margin"])

    schema = "row_id long, models array<int>, codes binary, y double, margin array<double>"
    row_id = key if key is not None else F.xxhash64(*x, F.col(target).cast("double"))
    work = Scratch(spark)
    table = work.write(rows.select(row_id.alias("row_id"), F.transform("models", lambda m: m.cast("int")).alias("models"), F.col(target).cast("double").alias("y"), *x).mapInArrow(coded, schema)).persist()
    features = features or [list(range(nf))] * len(settings)
    full = [PARAMETERS | s for s in settings]
    grown = sorted(m for m in bases if full[m]["trees"] > 0)
    small, large = ([m for m in grown if (sizes[m] <= TASK_ROWS) == here] for here in (True, False))
    lots = dealt(small, sizes, max(math.ceil(sum(sizes[m] for m in small) / TASK_ROWS), 2 * spark.sparkContext.defaultParallelism))
    for m, model in _grow_in_tasks(table, lots, settings, features, signs, loss, seed, base, cuts):
        out[m] = model
    width = min(1 << max(0, max((full[m]["depth"] for m in large), default=1) - 1), max((sizes[m] for m in large), default=0))
    size = max(1, MOST_CELLS // (max(1, nf) * (BINS + 1) * max(1, width)))
    for first in range(0, len(large), size):
        part = large[first : first + size]
        lot = _lot(settings, features, signs, loss, seed, part)
        trees, gain, weight = _grow_on(table, work, lot, nf, schema)
        for k, m in enumerate(part):
            out[m] = _model([t for t in trees if t.number < lot.trees[k]], k, base[m], cuts, gain[k], weight[k])
    for m in bases:
        if full[m]["trees"] <= 0:
            out[m] = _model([], 0, base[m], cuts, np.zeros(nf), np.zeros(nf))
    table.unpersist()
    work.close()
    return out


def dealt(models: list[int], sizes: dict[int, int], n: int) -> list[list[int]]:
    """Models in lots of about as many rows, some n of them or more."""
    lots: list[list[int]] = []
    most, held = sum(sizes[m] for m in models) / n, 0
    for m in models:
        if not lots or held + sizes[m] > most:
            lots.append([])
            held = 0
        lots[-1].append(m)
        held += sizes[m]
    return lots


def _grow_in_tasks(table: DataFrame, lots: list[list[int]], settings: list[dict], features: list[list[int]], signs: list[int], loss: str, seed: int, base: np.ndarray, cuts: list[np.ndarray]) -> Iterator[tuple[int, Boosted]]:
    """(number, model) of lots that a task each holds."""
    if not lots:
        return
    spark, nf = table.sparkSession, len(signs)
    sent = spark.sparkContext.broadcast([_lot(settings, features, signs, loss, seed, part) for part in lots])

    def grown(rows: pd.DataFrame) -> pd.DataFrame:
        lot = sent.value[int(rows["lot"].iloc[0])]
        rows = rows.sort_values(["model", "row_id", "y"])
        codes, at = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(-1, nf), np.arange(len(rows))
        trees, gain, weight = grow_here(lot, codes, rows["y"].to_numpy(), rows["row_id"].to_numpy(), at, np.searchsorted(lot.number, rows["model"]), base[lot.number])
        models = [_model([t for t in trees if t.number < lot.trees[k]], k, base[m], cuts, gain[k], weight[k]) for k, m in enumerate(lot.number)]
        return pd.DataFrame({"model": lot.number, "packed": [m.packed() for m in models]})

    of = spark.createDataFrame([(m, k) for k, part in enumerate(lots) for m in part], "model int, lot int")
    pairs = table.select("row_id", "codes", "y", F.explode("models").alias("model")).join(F.broadcast(of), "model")
    got = pairs.repartitionById(len(lots), F.col("lot")).groupBy("lot").applyInPandas(grown, "model int, packed binary")
    for r in got.collect():  # as large as the trees
        yield r["model"], pickle.loads(zlib.decompress(r["packed"]))
    sent.unpersist()


def _grow_on(table: DataFrame, work: Scratch, lot: Lot, nf: int, schema: str) -> tuple[list[Tree], np.ndarray, np.ndarray]:
    """Grows a lot whose rows are a written table, by jobs."""
    spark, n, of = table.sparkSession, lot.n, lot.number
    trees: list[Tree] = []
    now, fresh = table, 0  # rows with the margins of the first `fresh` trees
    gain, weight = np.zeros((n, nf)), np.zeros((n, nf))

    def level_sums(tree: Tree, slots: int) -> tuple[np.ndarray, np.ndarray]:
        sent = spark.sparkContext.broadcast((lot, trees[fresh:], tree))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, before, at = sent.value
            size = slots * nf * (BINS + 1)
            g, k = np.zeros(size), np.zeros(size)
            for b in batches:
                t = Table(b, nf, of)
                margin, use = t.add(before), np.flatnonzero(seen(t.row_id[t.row], at.number, own, t.model))
                row, model = t.row[use], t.model[use]
                dg, dk = sums(at, slots, t.codes, row, model, at.place(t.codes, row, model), gradient(own.loss, margin[use], t.y[row]))
                g += dg
                k += dk
            cell = np.flatnonzero(k)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(g[cell]), pa.array(k[cell])], ["cell", "g", "k"])

        got = now.mapInArrow(run, "cell long, g double, k double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("k").alias("k")).toPandas()
        sent.unpersist()
        g, k = (np.zeros(slots * nf * (BINS + 1)) for _ in range(2))
        g[got.cell], k[got.cell] = got.g, got.k
        return g, k

    def medians(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
        sent = spark.sparkContext.broadcast((lot, trees[fresh:], tree))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, before, at = sent.value
            for b in batches:
                t = Table(b, nf, of)
                margin, use = t.add(before), seen(t.row_id[t.row], at.number, own, t.model)
                leaf = t.model * at.value.shape[1] + at.place(t.codes, t.row, t.model)
                yield pa.RecordBatch.from_arrays([pa.array(leaf[use]), pa.array((t.y[t.row] - margin)[use])], ["leaf", "error"])

        got = now.mapInArrow(run, "leaf long, error double").groupBy("leaf").agg(F.percentile_approx("error", 0.5, 10_000).alias("median"), F.count("*").alias("k")).toPandas()
        sent.unpersist()
        median, count = np.zeros(tree.value.size), np.zeros(tree.value.size)
        median[got.leaf], count[got.leaf] = got["median"], got.k
        return median.reshape(tree.value.shape), count.reshape(tree.value.shape)

    def done(tree: Tree) -> None:
        nonlocal now, fresh
        trees.append(tree)
        if len(trees) % MARGIN_TREES or len(trees) == lot.trees.max():
            return
        sent = spark.sparkContext.broadcast(trees[fresh:])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                t = Table(b, nf, of)
                margin = b.column(4).flatten().to_numpy(zero_copy_only=False).copy()
                margin[t.use] = t.add(sent.value)
                yield pa.RecordBatch.from_arrays([*b.columns[:4], like(b.column(1), margin)], b.schema.names)

        new = work.write(now.mapInArrow(run, schema)).persist()
        if now is not table:
            now.unpersist()
            work.drop(now)
        now, fresh = new, len(trees)
        sent.unpersist()

    grow(lot, nf, lambda tree: None, level_sums, medians, done, gain, weight, MOST_CELLS)
    if now is not table:
        now.unpersist()
    return trees, gain, weight


def predict_many(rows: DataFrame, models: list[Boosted | None], names: list[str], which: str, name: str, used: list[list[int]] | None = None) -> DataFrame:
    """Adds the prediction of the model whose number the column `which` has; NULL where there is none, or where a feature that the model uses (those listed in used) is missing."""
    sent = rows.sparkSession.sparkContext.broadcast(([m and m.packed() for m in models], used))  # bounded by the trees

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        known, lists = sent.value
        for number, *cols in batches:
            x = np.stack([np.asarray(c, float) for c in cols], axis=1)
            m, out = number.fillna(-1).to_numpy(int), np.full(len(number), np.nan)
            for k in np.unique(m):
                if 0 <= k < len(known) and known[k] is not None:
                    at = np.flatnonzero((m == k) & (np.isfinite(x[:, lists[k]]).all(axis=1) if lists else True))
                    out[at] = pickle.loads(zlib.decompress(known[k])).predict(x[at])
            yield pd.Series(out)

    got = rows.withColumn(name, score(F.col(which).cast("int"), *[F.col(c).cast("double") for c in names]))
    return got.withColumn(name, F.when(~F.isnan(name), F.col(name)))
