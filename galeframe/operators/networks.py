"""A perceptron and a convolutional net, trained on rows that stay where they are.

A step sums the gradients of all rows: in one task for a fold, by a job for a table, where each task sums its own rows,
and a few tasks sum the sums; the driver gets some rows of the size of the net, moves the weights, and sends them with
the next step. A barrier stage whose tasks gather each other's gradients would need no jobs, but a gather takes a second
whatever its size, and a job a fraction of it. What is random (batches, dropout, the stations kept for validation) is a
hash of row, step and station, so the weights don't depend on how rows are dealt to tasks.

Both nets are trained on the absolute error with decoupled weight decay; the rate is halved when the validation error
stays, and the weights of the best epoch are kept. The convolutional net adds up softplus steps, so its profiles never
fall nor are below 0. It has no batch normalisation, which would tie a row's gradient to the other rows of its task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Weights = dict[str, np.ndarray]
WIDTH = 5


@dataclass
class Settings:
    epochs: int = 100
    batches: int = 1
    rate: float = 0.02
    decay: float = 1e-4
    dropout: float = 0.1
    validation: float = 0.2
    patience: int = 25
    seed: int = 0


@dataclass
class Rows:
    """Examples: x (rows x features, or rows x channels x points), aux (rows x features), y (rows x outputs), and who they are."""

    x: np.ndarray
    aux: np.ndarray
    y: np.ndarray
    row_id: np.ndarray
    station: np.ndarray

    def of(self, at: np.ndarray) -> Rows:
        return Rows(self.x[at], self.aux[at], self.y[at], self.row_id[at], self.station[at])


def uniform(key: np.ndarray, *salts: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the keys and salts only."""
    h = key.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        for s in salts:
            h = (h + np.uint64(s + 1)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(27)
    return (h >> np.uint64(11)).astype(float) / 2**53


@dataclass
class Dense:
    """Linear layers with ReLU and dropout between them; weights w0, b0, w1, ... after a prefix."""

    sizes: tuple[int, ...]
    prefix: str = ""

    def start(self, rng: np.random.Generator) -> Weights:
        out = {}
        for k, (a, b) in enumerate(zip(self.sizes, self.sizes[1:], strict=False)):
            out[f"{self.prefix}w{k}"], out[f"{self.prefix}b{k}"] = rng.normal(0, math.sqrt(2 / max(1, a)), (a, b)), np.zeros(b)
        return out

    def forward(self, w: Weights, x: np.ndarray, drop: Callable[[int, int], np.ndarray] | None = None) -> tuple[np.ndarray, list]:
        cache, last = [], len(self.sizes) - 2
        for k in range(last + 1):
            z = x @ w[f"{self.prefix}w{k}"] + w[f"{self.prefix}b{k}"]
            gate = np.ones(z.shape) if k == last else (z > 0).astype(float)
            if drop and k < last:
                gate *= drop(k, z.shape[1])
            cache.append((x, gate))
            x = z * gate
        return x, cache

    def backward(self, w: Weights, cache: list, d: np.ndarray, g: Weights) -> np.ndarray:
        for k in range(len(cache) - 1, -1, -1):
            x, gate = cache[k]
            d = d * gate
            g[f"{self.prefix}w{k}"], g[f"{self.prefix}b{k}"] = x.T @ d, d.sum(axis=0)
            d = d @ w[f"{self.prefix}w{k}"].T
        return d


@dataclass
class Perceptron:
    """Features to one value."""

    features: int
    hidden: tuple[int, ...] = (32, 16)

    def __post_init__(self):
        self.net = Dense((self.features, *self.hidden, 1))

    def start(self, rng: np.random.Generator, level: np.ndarray) -> Weights:
        w = self.net.start(rng)
        w[f"b{len(self.hidden)}"] = np.array([level.mean()])
        return w

    def forward(self, w: Weights, r: Rows, drop=None) -> tuple[np.ndarray, list]:
        return self.net.forward(w, r.x, drop)

    def backward(self, w: Weights, cache: list, d: np.ndarray) -> Weights:
        g: Weights = {}
        self.net.backward(w, cache, d, g)
        return g


@dataclass
class Convolution:
    """Profiles to a profile: stacked convolutions along the points, their mean, the further features' embedding, and a head whose softplus steps are added up."""

    channels: int
    points: int
    aux: int = 0
    filters: tuple[int, ...] = (16, 32)
    embedding: int = 8
    hidden: tuple[int, ...] = (32,)

    def __post_init__(self):
        self.embed = Dense((self.aux, self.embedding, self.embedding), "e") if self.aux else None
        self.head = Dense((self.filters[-1] + (self.embedding if self.aux else 0), *self.hidden, self.points), "h")

    def start(self, rng: np.random.Generator, level: np.ndarray) -> Weights:
        w, before = {}, self.channels
        for k, n in enumerate(self.filters):
            w[f"c{k}"], w[f"d{k}"] = rng.normal(0, math.sqrt(2 / (before * WIDTH)), (before * WIDTH, n)), np.zeros(n)
            before = n
        w |= (self.embed.start(rng) if self.embed else {}) | self.head.start(rng)
        last = len(self.hidden)
        w[f"hw{last}"] *= 0.1
        w[f"hb{last}"] = np.log(np.expm1(np.maximum(np.diff(level, prepend=0.0), 1e-3)))
        return w

    def forward(self, w: Weights, r: Rows, drop=None) -> tuple[np.ndarray, tuple]:
        x, convs = r.x.transpose(0, 2, 1), []
        for k in range(len(self.filters)):
            padded = np.pad(x, ((0, 0), (WIDTH // 2, WIDTH // 2), (0, 0)))
            patches = np.concatenate([padded[:, j : j + x.shape[1]] for j in range(WIDTH)], axis=2)
            z = patches @ w[f"c{k}"] + w[f"d{k}"]
            convs.append((patches, z > 0))
            x = z * (z > 0)
        pooled = x.mean(axis=1)
        side, embedded = self.embed.forward(w, r.aux) if self.embed else (None, None)
        z, head = self.head.forward(w, pooled if side is None else np.concatenate([pooled, side], axis=1), drop)
        return np.cumsum(np.logaddexp(0, z), axis=1), (convs, embedded, head, z)

    def backward(self, w: Weights, cache: tuple, d: np.ndarray) -> Weights:
        convs, embedded, head, z = cache
        g: Weights = {}
        d = np.cumsum(d[:, ::-1], axis=1)[:, ::-1] / (1 + np.exp(-z))
        d = self.head.backward(w, head, d, g)
        if self.embed:
            self.embed.backward(w, embedded, d[:, self.filters[-1] :], g)
            d = d[:, : self.filters[-1]]
        d = np.repeat(d[:, None, :] / self.points, self.points, axis=1)
        for k in range(len(self.filters) - 1, -1, -1):
            patches, on = convs[k]
            d = d * on
            g[f"c{k}"], g[f"d{k}"] = np.tensordot(patches, d, axes=([0, 1], [0, 1])), d.sum(axis=(0, 1))
            if k:
                back, n = d @ w[f"c{k}"].T, w[f"c{k}"].shape[0] // WIDTH
                padded = np.zeros((len(d), self.points + WIDTH - 1, n))
                for j in range(WIDTH):
                    padded[:, j : j + self.points] += back[:, :, j * n : (j + 1) * n]
                d = padded[:, WIDTH // 2 : WIDTH // 2 + self.points]
        return g


Net = Perceptron | Convolution


@dataclass
class Fitted:
    """A net with its weights, and how its inputs are standardised; missing inputs count as the mean."""

    net: Net
    weights: Weights
    mean: np.ndarray
    sd: np.ndarray
    aux_mean: np.ndarray
    aux_sd: np.ndarray
    history: list[float] = field(default_factory=list)

    def standardised(self, x: np.ndarray, aux: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.nan_to_num((x - self.mean) / self.sd), np.nan_to_num((aux - self.aux_mean) / self.aux_sd)

    def predict(self, x: np.ndarray, aux: np.ndarray | None = None) -> np.ndarray:
        x, aux = self.standardised(x, aux if aux is not None else np.zeros((len(x), 0)))
        zero = np.zeros(len(x), int)
        return self.net.forward(self.weights, Rows(x, aux, np.zeros((len(x), 0)), zero, zero))[0]


def share(net: Net, s: Settings, w: Weights, r: Rows, step: int) -> Weights:
    """The sums that a step needs of some rows: error and values (both in training and in validation), and the gradients."""
    kept = uniform(r.station, s.seed, 1) < s.validation
    use = ~kept
    if s.batches > 1:
        use &= (uniform(r.row_id, s.seed, 2, step // s.batches) * s.batches).astype(int) == step % s.batches
    out = {"error": np.zeros(2), "values": np.zeros(2)}
    if kept.any() and step % s.batches == 0:
        part = r.of(np.flatnonzero(kept))
        got, _ = net.forward(w, part)
        out["error"][1], out["values"][1] = np.abs(got - part.y).sum(), part.y.size
    if use.any():
        part = r.of(np.flatnonzero(use))
        drop = None
        if s.dropout:
            drop = lambda layer, width: (uniform((part.row_id[:, None] * 4099 + np.arange(width)), s.seed, 3 + layer, step) >= s.dropout) / (1 - s.dropout)
        got, cache = net.forward(w, part, drop)
        out["error"][0], out["values"][0] = np.abs(got - part.y).sum(), part.y.size
        out |= net.backward(w, cache, np.sign(got - part.y))
    return out


def descend(w: Weights, s: Settings, sums: Callable[[Weights, int], Weights]) -> tuple[Weights, list[float]]:
    """(weights of the best epoch, validation errors) after the epochs, or fewer where the error stays. Without validation rows the last weights."""
    first, second, rate = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, s.rate
    best, best_error, since, history = w, math.inf, 0, []
    for step in range(s.epochs * s.batches):
        got = sums(w, step)
        if step % s.batches == 0 and got["values"][1]:
            error = float(got["error"][1] / got["values"][1])
            history.append(error)
            since += 1
            if error < best_error:
                best, best_error, since = w, error, 0
            elif since % 10 == 0:
                rate /= 2
            if since >= s.patience:
                break
        n = max(1.0, got["values"][0])
        now = {}
        for k, v in w.items():
            g = got.get(k, np.zeros_like(v)) / n
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            now[k] = v * (1 - rate * s.decay) - rate * (first[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(second[k] / (1 - 0.999 ** (step + 1))) + 1e-8)
        w = now
    return (best if history else w), history


def _standard(x: np.ndarray, axis=0) -> tuple[np.ndarray, np.ndarray]:
    if not x.shape[-1] or not len(x):
        return np.zeros(x.shape[1:]), np.ones(x.shape[1:])
    mean, sd = np.nanmean(x, axis=axis), np.nanstd(x, axis=axis)
    return np.nan_to_num(mean), np.where(np.nan_to_num(sd) < 1e-8, 1.0, sd)


def fit_arrays(net: Net, r: Rows, settings: Settings, batch: int | None = None) -> Fitted:
    """The net, trained in this task on the rows given. batch: rows of a step on average, in place of the settings' number of batches."""
    if batch:
        settings = replace(settings, batches=max(1, math.ceil((uniform(r.station, settings.seed, 1) >= settings.validation).sum() / batch)))
    f = Fitted(net, {}, *_standard(r.x), *_standard(r.aux))
    x, aux = f.standardised(r.x, r.aux)
    rows = Rows(x, aux, r.y, r.row_id, r.station)
    w = net.start(np.random.default_rng(settings.seed), np.nanmean(r.y, axis=0))
    f.weights, f.history = descend(w, settings, lambda w, step: share(net, settings, w, rows, step))
    return f


def _unflat(flat: np.ndarray, w: Weights) -> Weights:
    out, at = {"error": flat[:2], "values": flat[2:4]}, 4
    for k, v in w.items():
        out[k] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return out


def fit_table(net: Perceptron, rows: DataFrame, names: list[str], target: str, settings: Settings, station: str = "station_id", key: list[str] | None = None) -> Fitted:
    """The perceptron, trained on a table whose rows stay on the executors. Rows without a target are left out; key tells rows apart."""
    x = [F.col(c).cast("double") for c in names]
    table = rows.where(F.col(target).isNotNull()).select(F.xxhash64(*(key or [*names, target])).alias("row_id"), F.xxhash64(station).alias("station"), F.col(target).cast("double").alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(x)]).persist()
    facts = table.agg(F.avg("y").alias("y"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(x))], *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(len(x))]).first()
    mean = np.array([facts[f"m{i}"] or 0.0 for i in range(len(x))])
    sd = np.array([facts[f"s{i}"] or 0.0 for i in range(len(x))])
    f = Fitted(net, {}, mean, np.where(sd < 1e-8, 1.0, sd), np.zeros(0), np.ones(0))
    w, spark = net.start(np.random.default_rng(settings.seed), np.array([facts["y"] or 0.0])), rows.sparkSession

    def sums(w: Weights, step: int) -> Weights:
        sent = spark.sparkContext.broadcast(w)  # the net's size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, slot = None, 0
            for b in batches:
                if not b.num_rows:
                    continue
                row_id, station, y, *cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
                got, _ = f.standardised(np.stack(cols, axis=1).astype(float), np.zeros((len(y), 0)))
                one = share(net, settings, sent.value, Rows(got, np.zeros((len(y), 0)), y[:, None], row_id, station), step)
                flat = np.concatenate([one["error"], one["values"], *[one.get(k, np.zeros_like(v)).ravel() for k, v in sent.value.items()]])
                total, slot = flat if total is None else total + flat, int(row_id[0]) % 16
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["slot", "sums"])

        def added(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"sums": [np.sum(np.stack(list(part.sums)), axis=0)]})

        some = table.mapInArrow(run, "slot int, sums array<double>")
        if some.rdd.getNumPartitions() > 64:
            some = some.groupBy("slot").applyInPandas(added, "sums array<double>")
        got = [np.array(r["sums"]) for r in some.select("sums").collect()]
        sent.unpersist()
        return _unflat(np.sum(got, axis=0) if got else np.zeros(4 + sum(v.size for v in w.values())), w)

    f.weights, f.history = descend(w, settings, sums)
    table.unpersist()
    return f


def predictions(rows: DataFrame, model: Fitted, names: list[str], name: str) -> DataFrame:
    """Adds the perceptron's predictions, in Arrow batches."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            yield pd.Series(sent.value.predict(np.stack([np.asarray(c, float) for c in cols], axis=1))[:, 0])

    return rows.withColumn(name, score(*[F.col(c).cast("double") for c in names]))
