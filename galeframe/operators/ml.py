"""Bias correction: leave-one-station-out folds, final models, batch scoring, sweeps and hyper-parameter search."""

from __future__ import annotations

import itertools
import json
import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galeframe.functions import cdf, labels
from galeframe.functions.constants import N_QUANTILES
from galeframe.operators import boosting, networks
from galeframe.operators.cut import Scratch
from galeframe.operators.ordered import balanced, positions
from galeframe.operators.schema import derived_features, require



def features(long: DataFrame, winds: list[str], aux: list[str] = (), target: str = "observation") -> tuple[DataFrame, list[str], list[int]]:
    """(table, feature names, monotonic constraints): winds rise with the target, and so does qnum; others are free. Missing columns are an error."""
    df = derived_features(long)
    names = [*winds, "qnum", *aux]
    require(df, [*names, target])
    return df.withColumns({c: cdf.finite(F.col(c)) for c in [*names, target]}), names, [1] * (len(winds) + 1) + [0] * len(aux)


def neighbour_map(long: DataFrame, ids: str = "neighbors_km_site_ids") -> DataFrame:
    """(fold, station_id): stations near each GS station, itself included: what its fold must not train on."""
    gs = long.where(labels.observation_type(F.col("observation_type")) == "GS").select(F.col("station_id").alias("fold"), ids).distinct()
    near = gs.select("fold", F.explode(labels.ids_of(F.col(ids))).alias("station_id"))
    return near.unionByName(gs.select("fold", F.col("fold").alias("station_id"))).distinct()


def folds(long: DataFrame, excluded: DataFrame) -> DataFrame:
    """A row (fold, role) for each training row of a fold (all stations but the excluded) and each of its test rows. The training rows are repeated for each fold: meant for the observed stations, not for grids."""
    stations = excluded.select("fold").distinct()
    out = excluded.groupBy("station_id").agg(F.collect_set("fold").alias("_out"))  # a row for each observed station
    every = stations.agg(F.array_sort(F.collect_set("fold")).alias("_all"))  # one row
    known = long.join(F.broadcast(out), "station_id", "left").crossJoin(F.broadcast(every))
    train = known.withColumn("fold", F.explode(F.array_except("_all", F.coalesce("_out", F.array().cast(out.schema["_out"].dataType))))).drop("_out", "_all").withColumn("role", F.lit("train"))
    test = long.join(F.broadcast(stations.withColumnRenamed("fold", "station_id")), "station_id", "left_semi").withColumn("fold", F.col("station_id")).withColumn("role", F.lit("test"))
    return train.unionByName(test)


@dataclass(frozen=True)
class Run:
    """One model for each fold: what it sees, and how it is fitted. method: boosting, hybrid or wide."""

    names: tuple[str, ...]
    signs: tuple[int, ...]
    parameters: dict = field(default_factory=dict)
    method: str = "boosting"


def _numbered_folds(spark: SparkSession, kind: str, excluded: DataFrame) -> tuple[int, DataFrame]:
    """The number of folds, and (fold, no) of each: a row for each observed station."""
    stations = sorted(r["fold"] for r in excluded.select("fold").distinct().collect())
    return len(stations), spark.createDataFrame(list(zip(stations, range(len(stations)), strict=True)), f"fold {kind}, no int")


def _profiles_of_folds(rows: DataFrame, fold_of: DataFrame, excluded: DataFrame, n: int, balance: str | None, seed: int) -> DataFrame:
    """(station_id, height_m, cls, run, fold): the profiles that train each fold of each run. rows: the same without fold; balanced by whole profiles, in an order seeded by the fold."""
    out = excluded.join(F.broadcast(fold_of), "fold").groupBy("station_id").agg(F.collect_set("no").alias("_out"))
    of = F.array_except(F.sequence(F.lit(0), F.lit(n - 1)), F.coalesce("_out", F.array().cast("array<int>")))
    profiles = rows.distinct().join(F.broadcast(out), "station_id", "left").withColumn("no", F.explode(of)).drop("_out")
    if not balance:
        return profiles
    if balance not in ("downsample", "upsample"):
        raise ValueError(f"unknown strategy {balance!r}")
    sizes = profiles.groupBy("run", "no").agg(F.count_if(F.col("cls") == "GS").alias("_gs"), F.count_if(F.col("cls") != "GS").alias("_asos"))
    named = profiles.join(F.broadcast(fold_of), "no")
    order = F.sha1(F.concat_ws("|", labels.fold_seed(seed, F.col("fold")).cast("string"), F.col("station_id"), F.col("height_m").cast("string")).cast("binary"))
    placed = positions(named.withColumn("_h", order), [F.col("_h").asc()], ["run", "no", "cls"], "_r").join(sizes, ["run", "no"])
    own, other = (F.when(F.col("cls") == "GS", F.col(a)).otherwise(F.col(b)) for a, b in (("_gs", "_asos"), ("_asos", "_gs")))
    placed = placed.withColumns({"_own": own, "_other": other})
    if balance == "downsample":
        return placed.where("_other = 0 or _r < _other").select(*profiles.columns)
    times = F.expr("if(_other <= _own, 1, _other div _own + if(_r < _other % _own, 1, 0))")
    return placed.withColumn("_", F.explode(F.sequence(F.lit(1), times))).select(*profiles.columns)


def cross_validate(long: DataFrame, runs: list[Run], excluded: DataFrame, target: str = "observation", least_rows: int = 20, balance: str | None = "downsample", seed: int = 42, cutoff: int = 95, floor: float = 1e-3) -> DataFrame:
    """(run, station_id, height_m, qnum, observed, predicted): leave-one-out predictions of each run, counted from 0.

    The models of all runs and folds are grown together on one coded table; a row names the models that it trains. A
    model of fewer than least_rows rows predicts NULL. hybrid adds, from the cutoff on, models of the target's
    logarithm, where these have 20 rows; wide has a model for each quantile, and takes the running maximum.
    """
    names = list(dict.fromkeys(n for r in runs for n in r.names))
    sign = {n: s for r in runs for n, s in zip(r.names, r.signs, strict=True)}
    spark = long.sparkSession
    n, fold_of = _numbered_folds(spark, long.schema["station_id"].dataType.simpleString(), excluded)
    keep = list(dict.fromkeys(["station_id", "height_m", "qnum", *names]))
    rows = long.select(*keep, F.col(target).cast("double").alias("_y"), F.when(labels.observation_type(F.col("observation_type")) == "GS", "GS").otherwise("ASOS").alias("cls"))
    whole = [F.forall(F.array(*[F.col(c).isNotNull() for c in r.names]), lambda b: b) for r in runs]
    valid = F.array_compact(F.array(*[F.when(w, F.lit(k)) for k, w in enumerate(whole)]))
    usable = rows.where("_y is not null").withColumn("run", valid)
    profiles = _profiles_of_folds(usable.select("station_id", "height_m", "cls", F.explode("run").alias("run")), fold_of, excluded, n, balance, seed)
    chosen = profiles.groupBy(F.col("station_id").alias("_s"), F.col("height_m").alias("_hm"), F.col("cls").alias("_c")).agg(F.collect_list(F.col("run") * n + F.col("no")).alias("_models"))
    same = (F.col("station_id") == F.col("_s")) & F.col("height_m").eqNullSafe(F.col("_hm")) & (F.col("cls") == F.col("_c"))
    mine = usable.join(chosen, same).withColumn("models", F.filter("_models", lambda m: F.array_contains("run", F.floor(m / n).cast("int"))))
    work = Scratch(spark)
    mine = work.write(mine.select(*keep, "_y", "models"))
    sizes = {r["m"]: r["count"] for r in mine.select(F.explode("models").alias("m")).groupBy("m").count().collect()}
    enough = [sizes.get(m, 0) >= least_rows for m in range(len(runs) * n)]
    if not all(enough):
        trained = F.array(*[F.lit(m) for m, ok in enumerate(enough) if ok]).cast("array<int>")
        mine = mine.withColumn("models", F.filter("models", lambda m: F.array_contains(trained, m)))

    test = long.join(F.broadcast(fold_of), long["station_id"] == fold_of["fold"]).drop("fold").withColumn("run", F.explode(F.array(*[F.lit(k) for k in range(len(runs))])))
    test = test.select("run", "no", F.col("station_id"), F.col("height_m").cast("double").alias("height_m"), F.col("qnum").cast("int").alias("qnum"), *[n for n in names if n not in ("height_m", "qnum")], F.col(target).cast("double").alias("observed"), (F.col("run") * n + F.col("no")).alias("_m"))
    signs = [sign[c] for c in names]

    def models(table: DataFrame, of: list[int], per: int = 1, drop: str | None = None) -> tuple[list, list]:
        """Models of these runs, per of them for each fold, and the numbers of the features that each uses."""
        used = [[names.index(c) for c in runs[k].names if c != drop] for k in of for _ in range(n * per)]
        settings = [runs[k].parameters for k in of for _ in range(n * per)]
        return boosting.fit_many(table, names, signs, settings, used, seed=seed, target="_y"), used

    def numbered(of: list[int], m: Column) -> Column:
        """The number of a model among those of some runs."""
        return F.element_at(F.create_map(*[F.lit(x) for k, r in enumerate(of) for x in (r, k)]), F.floor(m / n).cast("int")) * n + m % n

    parts = []
    for method in ("boosting", "hybrid", "wide"):
        of = [k for k, r in enumerate(runs) if r.method == method]
        if not of:
            continue
        own = mine.withColumn("models", F.transform(F.filter("models", lambda m: F.floor(m / n).cast("int").isin(of)), lambda m: numbered(of, m)))
        asked = test.where(F.col("run").isin(of)).withColumn("_k", numbered(of, F.col("_m")))
        good = [enough[k * n + j] for k in of for j in range(n)]
        if method == "wide":
            per = N_QUANTILES
            of_quantile = lambda m: (m * per + F.col("qnum")).cast("int")
            fitted, used = models(own.withColumn("models", F.transform("models", of_quantile)), of, per, "qnum")
            fitted = [m if good[k // per] else None for k, m in enumerate(fitted)]
            got = boosting.predict_many(asked.withColumn("_k", of_quantile(F.col("_k"))), fitted, names, "_k", "predicted", used)
            w = Window.partitionBy("run", "station_id", "height_m").orderBy("qnum").rowsBetween(Window.unboundedPreceding, 0)
            got = got.withColumn("predicted", F.when(F.col("predicted").isNotNull(), F.max("predicted").over(w)))
        else:
            fitted, used = models(own, of)
            got = boosting.predict_many(asked, [m if ok else None for m, ok in zip(fitted, good, strict=True)], names, "_k", "predicted", used)
        if method == "hybrid":
            tail = own.where(F.col("qnum") >= cutoff).withColumn("_y", F.log(F.greatest("_y", F.lit(floor))))
            high = {r["m"] for r in tail.select(F.explode("models").alias("m")).groupBy("m").count().where("count >= 20").collect()}
            fitted, used = models(tail, of)
            fitted = [m if k in high and ok else None for k, (m, ok) in enumerate(zip(fitted, good, strict=True))]
            got = boosting.predict_many(got, fitted, names, "_k", "_tail", used)
            got = got.withColumn("predicted", F.when((F.col("qnum") >= cutoff) & F.col("_tail").isNotNull(), F.exp("_tail")).otherwise(F.col("predicted"))).drop("_tail")
        parts.append(got.select("run", "station_id", "height_m", "qnum", "observed", cdf.finite(F.col("predicted")).alias("predicted")))
    work.close()
    return reduce(DataFrame.unionByName, parts)


def _hashed(keys: pd.DataFrame) -> np.ndarray:
    return pd.util.hash_pandas_object(keys, index=False).to_numpy().view(np.int64)


def _perceptron(train, test, names, monotone, target, o) -> np.ndarray:
    """Stations are kept for validation where there are five or more."""
    hidden, s = o.get("hidden", (32, 16)), networks.Settings(**{k: v for k, v in o.items() if k not in ("hidden", "batch")})
    if train.station_id.nunique() < 5:
        s.validation = 0.0
    rows = networks.Rows(train[names].to_numpy(float), np.zeros((len(train), 0)), train[[target]].to_numpy(float), _hashed(train[["station_id", "height_m", "qnum"]]), _hashed(train[["station_id"]]))
    return networks.fit_arrays(networks.Perceptron(len(names), tuple(hidden)), rows, s, o.get("batch")).predict(test[names].to_numpy(float))[:, 0]


def _profiles(part: pd.DataFrame, channels: list[str], aux: list[str], target: str) -> tuple[networks.Rows, list]:
    """The profiles that have all of the points, and the rows of each."""
    most = part.groupby(["station_id", "height_m"]).size().max()
    kept = [g for _, g in part.groupby(["station_id", "height_m"], sort=True) if len(g) == most]
    first = pd.concat([g.head(1) for g in kept])
    rows = networks.Rows(np.stack([g[channels].to_numpy(float).T for g in kept]), first[aux].to_numpy(float), np.stack([g[target].to_numpy(float) for g in kept]), _hashed(first[["station_id", "height_m"]]), _hashed(first[["station_id"]]))
    return rows, [g.index for g in kept]


def _convolution(train, test, names, monotone, target, o) -> np.ndarray:
    """Winds are channels along the quantiles, other features an embedding beside them."""
    channels, aux = [n for n, m in zip(names, monotone, strict=True) if m and n != "qnum"], [n for n, m in zip(names, monotone, strict=True) if not m]
    shape = {k: o[k] for k in ("filters", "embedding", "hidden") if k in o}
    s = networks.Settings(**{k: v for k, v in o.items() if k not in shape and k != "batch"})
    rows, _ = _profiles(train, channels, aux, target)
    asked, places = _profiles(test.assign(**{target: test[target].fillna(0)}), channels, aux, target)
    out = pd.Series(np.nan, index=test.index)
    if asked.x.shape[2] == rows.x.shape[2]:
        if len(np.unique(rows.station)) < 5:
            s.validation = 0.0
        model = networks.fit_arrays(networks.Convolution(len(channels), rows.x.shape[2], len(aux), **shape), rows, s, o.get("batch"))
        for r, v in zip(places, model.predict(asked.x, asked.aux), strict=True):
            out[r] = v
    return out.to_numpy()


#: How a fold of whole profiles is fitted and scored, in one task.
METHODS = {"network": _perceptron, "convolution": _convolution}
#: What cross_validate() grows.
GROWN = ("boosting", "hybrid", "wide")


def _fold(train: pd.DataFrame, test: pd.DataFrame, seed: int, names: list[str], monotone: list[int], target: str, least_rows: int, balance: str | None, fit, o: dict) -> pd.DataFrame:
    """Predictions of one fold's station. Cohorts are balanced by whole profiles, in an order seeded by the fold."""
    test = test.sort_values(["height_m", "qnum"]).reset_index(drop=True)
    train = train[np.isfinite(train[[*names, target]].to_numpy(float)).all(axis=1)].sort_values(["station_id", "height_m", "qnum"])
    out = pd.DataFrame({"station_id": test.station_id, "height_m": test.height_m.astype(float), "qnum": test.qnum.astype(int), "observed": test[target].astype(float), "predicted": np.nan})
    if balance and len(train):
        profile = train[["station_id", "height_m", "observation_type"]].drop_duplicates()
        gs, rng = (profile.observation_type == "GS").to_numpy(), np.random.default_rng(seed)
        n = min(gs.sum(), (~gs).sum())
        if n:
            pick = np.concatenate([rng.permutation(np.flatnonzero(gs))[:n], rng.permutation(np.flatnonzero(~gs))[:n]])
            train = train.merge(profile.iloc[pick], on=["station_id", "height_m", "observation_type"]).sort_values(["station_id", "height_m", "qnum"])
    train = train.reset_index(drop=True)
    ok = np.isfinite(test[names].to_numpy(float)).all(axis=1)
    if len(train) >= least_rows and ok.any():
        got = np.full(len(test), np.nan)
        got[ok] = fit(train, test[ok].reset_index(drop=True), names, monotone, target, o)
        out["predicted"] = got
    return out


def leave_one_out(long: DataFrame, names: list[str], monotone: list[int], excluded: DataFrame, target: str = "observation", least_rows: int = 20, balance: str | None = "downsample", seed: int = 42, parameters: dict | None = None, method: str = "boosting") -> DataFrame:
    """(station_id, height_m, qnum, observed, predicted) for the rows of each fold's station; below least_rows the prediction is NULL."""
    if method in GROWN:
        return cross_validate(long, [Run(tuple(names), tuple(monotone), parameters or {}, method)], excluded, target, least_rows, balance, seed).drop("run")
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; there are {sorted([*GROWN, *METHODS])}")
    fit, o = METHODS[method], parameters or {}
    keep = list(dict.fromkeys(["station_id", "height_m", "qnum", *[n for n in names if n != "qnum"], target, "observation_type"]))
    kind = long.schema["station_id"].dataType.simpleString()
    schema = f"station_id {kind}, height_m double, qnum int, observed double, predicted double"
    n, fold_of = _numbered_folds(long.sparkSession, kind, excluded)
    settings = (names, monotone, target, least_rows, balance, fit, o)

    def dealt(part: pd.DataFrame) -> pd.DataFrame:
        return _fold(part[part.role == "train"], part[part.role == "test"], int(part.seed.iloc[0]), *settings)

    rows = folds(long.select(*keep), excluded).withColumn("seed", labels.fold_seed(seed, F.col("fold"))).join(F.broadcast(fold_of), "fold")
    done = rows.repartitionById(max(1, n), F.col("no")).groupBy("no").applyInPandas(dealt, schema)  # a task for each fold
    return done.withColumn("predicted", cdf.finite(F.col("predicted")))


def train(long: DataFrame, names: list[str], monotone: list[int], target: str = "observation", balance: str | None = "downsample", seed: int = 42, parameters: dict | None = None, loss: str = "absolute") -> boosting.Boosted:
    """The final model, on all balanced rows with finite features. Without such a row it is None."""
    rows = long
    for c in [*names, target]:
        rows = rows.where(F.col(c).isNotNull())
    rows = rows.withColumn("_cls", F.when(labels.observation_type(F.col("observation_type")) == "GS", "GS").otherwise("ASOS"))
    if balance:
        rows = balanced(rows, "_cls", "station_id", "height_m", "qnum", strategy=balance, seed=seed)
    rows = rows.withColumn("models", F.array(F.lit(0)))
    key = F.xxhash64("station_id", "height_m", "qnum")
    return boosting.fit_many(rows, names, monotone, [parameters or {}], loss=loss, seed=seed, target=target, key=key)[0]


def predict(df: DataFrame, model: boosting.Boosted, names: list[str], name: str = "pred_observation") -> DataFrame:
    """Scores in Arrow batches, JVM columns untouched; features that df lacks are missing values."""
    blob = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # bounded by the number of trees

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        m = pickle.loads(blob.value)
        for cols in batches:
            yield pd.Series(m.predict(np.stack([np.asarray(c, float) for c in cols], axis=1)))

    cols = [F.col(n).cast("double") if n in df.columns else F.lit(None).cast("double") for n in names]
    return df.withColumn(name, score(*cols))


def monotone_predictions(pred: DataFrame, keys: list[str], value: str = "pred_observation") -> DataFrame:
    """Running maximum over the quantiles of each key."""
    return pred.withColumn(value, F.max(value).over(Window.partitionBy(*keys).orderBy("qnum").rowsBetween(Window.unboundedPreceding, 0)))


def wide_models(arrays: DataFrame, inputs: list[str], aux: list[str], target: str, numbers: list[int], parameters: dict | None = None) -> list[boosting.Boosted | None]:
    """A separate model for each of the quantiles, grown side by side; score with wide_predictions()."""
    rows = _quantile_rows(arrays, inputs, aux, target, numbers).withColumn("models", F.array("which"))
    n = len(inputs) + len(aux)
    return boosting.fit_many(rows, [f"x{i}" for i in range(n)], [1] * len(inputs) + [0] * len(aux), [parameters or {}] * len(numbers))


def _quantile_rows(arrays: DataFrame, inputs: list[str], aux: list[str], target: str | None, numbers: list[int]) -> DataFrame:
    x = [F.get(F.col(c), F.col("qnum")).alias(f"x{i}") for i, c in enumerate(inputs)] + [F.col(a).cast("double").alias(f"x{len(inputs) + i}") for i, a in enumerate(aux)]
    y = [F.get(F.col(target), F.col("qnum")).alias("y")] if target else []
    rest = [c for c in arrays.columns if c not in (*inputs, *aux, target)]
    return arrays.select("*", F.posexplode(F.array(*[F.lit(q) for q in numbers])).alias("which", "qnum")).select(*rest, "which", "qnum", *x, *y)


def wide_predictions(arrays: DataFrame, models: list[boosting.Boosted | None], inputs: list[str], aux: list[str], numbers: list[int], keys: list[str], name: str = "pred_observation") -> DataFrame:
    """(keys, qnum, prediction) by each quantile's own model, and then the running maximum."""
    rows = _quantile_rows(arrays, inputs, aux, None, numbers).select(*keys, "which", "qnum", *[f"x{i}" for i in range(len(inputs) + len(aux))])
    got = boosting.predict_many(rows, models, [f"x{i}" for i in range(len(inputs) + len(aux))], "which", name)
    return monotone_predictions(got.select(*keys, "qnum", name), keys, name)


def hybrid_models(long: DataFrame, names: list[str], monotone: list[int], tail_names: list[str], tail_monotone: list[int], cutoff: int = 95, floor: float = 1e-3, **settings) -> tuple[boosting.Boosted, boosting.Boosted]:
    """A base model on all quantiles, and one for the logarithm of the target in the tail."""
    from galeframe.functions.wind import log_target

    tail = long.where(F.col("qnum") >= cutoff).withColumn("_log", log_target(F.col("observation"), floor))
    return train(long, names, monotone, **settings), train(tail, tail_names, tail_monotone, target="_log", **settings)


def hybrid_predictions(df: DataFrame, base: boosting.Boosted, tail: boosting.Boosted, names: list[str], tail_names: list[str], cutoff: int = 95) -> DataFrame:
    scored = predict(predict(df, base, names, "_base"), tail, tail_names, "_tail")
    return scored.withColumn("pred_observation", F.when(F.col("qnum") >= cutoff, F.exp("_tail")).otherwise(F.col("_base"))).drop("_base", "_tail")


def network(long: DataFrame, names: list[str], target: str = "observation", hidden: tuple[int, ...] = (32, 16), **settings) -> networks.Fitted:
    """The perceptron on all rows, which stay on the executors; predict with network_predictions()."""
    return networks.fit_table(networks.Perceptron(len(names), tuple(hidden)), long, names, target, networks.Settings(**settings), key=["station_id", "height_m", "qnum"])


def network_predictions(df: DataFrame, model: networks.Fitted, names: list[str], name: str = "pred_observation") -> DataFrame:
    return networks.predictions(df, model, names, name)


def feature_subsets(items: list[str], empty: bool = False) -> list[list[str]]:
    """All subsets in order of size, then position."""
    return [list(c) for k in range(0 if empty else 1, len(items) + 1) for c in itertools.combinations(items, k)]


def errors(done: DataFrame) -> DataFrame:
    """(run, rmse, mae, n) of cross-validated predictions."""
    e = F.col("predicted") - F.col("observed")
    return done.groupBy("run").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count(e).alias("n"))


def sweep(long: DataFrame, subsets: list[list[str]], aux: list[str], excluded: DataFrame, done: DataFrame | None = None, parameters: dict | None = None, **settings) -> DataFrame:
    """(label, features, rmse, mae, n): pooled leave-one-out errors with each feature subset, the models of all subsets and folds grown together.

    done: the manifest of an earlier sweep, whose subsets aren't run again but kept.
    """
    label = lambda names: "+".join(names) or "none"
    known = {r["label"] for r in done.select("label").collect()} if done is not None else set()
    todo = [s for s in subsets if label(s) not in known]
    table, _, _ = features(long, list(dict.fromkeys(n for s in subsets for n in s)), aux)
    schema = "label string, features string, rmse double, mae double, n long"
    got = long.sparkSession.createDataFrame([], schema)
    if todo:
        runs = [Run((*s, "qnum", *aux), (*[1] * (len(s) + 1), *[0] * len(aux)), parameters or {}) for s in todo]
        named = long.sparkSession.createDataFrame([(k, label(s), json.dumps(s)) for k, s in enumerate(todo)], "run int, label string, features string")
        got = named.join(errors(cross_validate(table, runs, excluded, **settings)), "run").drop("run")
    return got if done is None else done.select(*got.columns).unionByName(got)


def parameter_sweep(long: DataFrame, names: list[str], monotone: list[int], excluded: DataFrame, grid: dict[str, list], base: dict | None = None, **settings) -> DataFrame:
    """(parameter, value, rmse, mae, n): leave-one-out errors with one parameter changed at a time, all side by side."""
    changes = [(k, v) for k, values in grid.items() for v in values]
    runs = [Run(tuple(names), tuple(monotone), (base or {}) | {k: v}) for k, v in changes]
    named = long.sparkSession.createDataFrame([(i, k, float(v)) for i, (k, v) in enumerate(changes)], "run int, parameter string, value double")
    return named.join(errors(cross_validate(long, runs, excluded, **settings)), "run").drop("run")


#: Parameters that are searched, with their bounds; all on a logarithmic scale, whole where the bounds are.
SPACE = {"trees": (50, 200), "depth": (2, 6), "rate": (0.03, 0.3), "ridge": (0.1, 10.0)}


def parzen(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The density at some places of the unit interval: a normal around each point, as wide as their number tells, and one wide normal for what isn't known."""
    centre, width = np.append(points, 0.5), np.append(np.full(len(points), 1 / (1 + min(100, len(points)))), 1.0)
    z = (at[:, None] - centre) / width
    return (np.exp(-z * z / 2) / width / math.sqrt(2 * math.pi)).mean(axis=1)


def suggested(history: list[tuple[np.ndarray, float]], size: int, rng: np.random.Generator, n: int, good: float = 0.25, drawn: int = 32) -> list[np.ndarray]:
    """n places of the unit cube to try next: of some drawn around the good trials, those where good trials are densest against the others, parameter by parameter."""
    if len(history) < max(4, 2 * n):
        return [rng.random(size) for _ in range(n)]
    order = sorted(history, key=lambda h: h[1])
    k = max(2, math.ceil(good * len(order)))
    best, rest = np.stack([h[0] for h in order[:k]]), np.stack([h[0] for h in order[k:]])
    out = []
    for _ in range(n):
        pick = best[rng.integers(0, k, (drawn, size)), np.arange(size)]
        draws = np.clip(pick + rng.normal(0, 1 / (1 + min(100, k)), (drawn, size)), 0, 1)
        value = sum(np.log(parzen(best[:, j], draws[:, j])) - np.log(parzen(rest[:, j], draws[:, j])) for j in range(size))
        out.append(draws[int(np.argmax(value))])
    return out


def tpe(evaluate: Callable[[list[dict]], list[float]], space: dict[str, tuple], trials: int, side_by_side: int = 4, seed: int = 0) -> list[dict]:
    """Trials with their loss, best first. evaluate is handed some trials at a time, to run them together."""
    rng, history, runs = np.random.default_rng(seed), [], []
    low, high = (np.log(np.array([b[k] for b in space.values()], float)) for k in (0, 1))
    while len(runs) < trials:
        places = suggested(history, len(space), rng, min(side_by_side, trials - len(runs)))
        asked = [dict(zip(space, np.exp(low + p * (high - low)).tolist(), strict=True)) for p in places]
        asked = [{k: round(v) if isinstance(space[k][0], int) else v for k, v in a.items()} for a in asked]
        for p, a, loss in zip(places, asked, evaluate(asked), strict=True):
            history.append((p, loss))
            runs.append(a | {"loss": loss})
    return sorted(runs, key=lambda r: r["loss"])


def search(long: DataFrame, names: list[str], monotone: list[int], excluded: DataFrame, trials: int = 12, side_by_side: int = 4, seed: int = 0, space: dict | None = None, **settings) -> list[dict]:
    """Boosting settings by tree-structured Parzen search, best first; the trials of a round are grown together, over all folds."""

    def evaluate(asked: list[dict]) -> list[float]:
        done = cross_validate(long, [Run(tuple(names), tuple(monotone), a) for a in asked], excluded, **settings)
        found = {r["run"]: r["rmse"] for r in errors(done).collect()}
        return [found.get(k) if found.get(k) is not None else math.inf for k in range(len(asked))]

    return [{("rmse" if k == "loss" else k): v for k, v in r.items()} for r in tpe(evaluate, space or SPACE, trials, side_by_side, seed)]


def importance(spark: SparkSession, model: boosting.Boosted, names: list[str]) -> DataFrame:
    """(feature, gain, weight, total_gain, rank_gain): gain is the mean of a feature's splits."""
    rows = [(names[i], g / w if w else 0.0, w, g) for i, g, w in model.importance()]
    rows.sort(key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame([(*r, k + 1) for k, r in enumerate(rows)], "feature string, gain double, weight double, total_gain double, rank_gain int")


def standardised(df: DataFrame, names: list[str], fill: float = 0.0) -> DataFrame:
    """Columns less their mean, over their population deviation (1 below 1e-8); missing values take the fill."""
    stats = df.agg(*[F.avg(cdf.finite(F.col(c))).alias(f"_m_{c}") for c in names], *[F.stddev_pop(cdf.finite(F.col(c))).alias(f"_s_{c}") for c in names])
    out = df.crossJoin(F.broadcast(stats))
    return out.withColumns({c: F.coalesce((cdf.finite(F.col(c)) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < 1e-8, 1.0).otherwise(F.col(f"_s_{c}")), F.lit(fill)) for c in names}).drop(*[f"_{k}_{c}" for c in names for k in "ms"])


def training_counts(df: DataFrame, names: list[str], target: str = "observation") -> DataFrame:
    """Rows, rows with target, with all features, and by cohort."""
    whole = F.lit(True)
    for c in names:
        whole = whole & cdf.finite(F.col(c)).isNotNull()
    gs = labels.observation_type(F.col("observation_type")) == "GS"
    y = cdf.finite(F.col(target)).isNotNull()
    return df.agg(F.count("*").alias("total"), F.count_if(y).alias("with_target"), F.count_if(whole).alias("with_features"), F.count_if(y & whole & gs).alias("gs"), F.count_if(y & whole & ~gs).alias("asos"))


def quantile_numbers() -> list[int]:
    return list(range(N_QUANTILES))
