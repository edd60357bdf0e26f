"""Named experiments: features, method and settings of leave-one-out runs, and how they compare."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.operators import assemble, metrics, ml
from galeframe.operators.schema import present


@dataclass(frozen=True)
class Experiment:
    """What to train: the method of the folds, further features, and whether the whole distribution is a feature."""

    method: str = "boosting"
    aux: tuple = ()
    context: tuple = ()
    parameters: dict = field(default_factory=dict)


#: Features of site and terrain that the enriched experiments add.
TERRAIN = ("height_m", "elevation_m", "slope_deg", "aspect_sin", "aspect_cos")
EXPERIMENTS = {
    "baseline": Experiment(),
    "enriched": Experiment(aux=TERRAIN),
    "cdf_context": Experiment(context=(50, 90)),
    "wide": Experiment("wide"),
    "hybrid": Experiment("hybrid"),
    "hybrid_context": Experiment("hybrid", context=(50, 90)),
    "network": Experiment("network"),
    "convolution": Experiment("convolution"),
}

#: Full settings of a run by its method: the boosted trees' are those that a search found best. run() takes others as well.
_TREES = {"trees": 500, "depth": 20, "rate": 0.02216030268952961, "least": 4.2832509812996635, "rows": 0.6098353951742953, "columns": 0.9761640794652597}
FULL = {
    "boosting": _TREES,
    "hybrid": _TREES,
    "wide": _TREES,
    "network": {"epochs": 100, "batch": 512, "rate": 1e-3, "decay": 1e-4, "dropout": 0.3, "validation": 0.2, "patience": 15, "hidden": (128, 64)},
    "convolution": {"epochs": 300, "batch": 32, "rate": 1e-3, "decay": 1e-4, "dropout": 0.3, "validation": 0.2, "patience": 30, "filters": (32, 64, 128), "embedding": 32, "hidden": (128, 64)},
}


def prepared(name: str, long: DataFrame, winds: list[str]) -> tuple[DataFrame, list[str], list[int]]:
    """(table, features, constraints) of an experiment; terrain features that the table lacks are left out."""
    if name not in EXPERIMENTS:
        raise ValueError(f"unknown experiment {name!r}; there are {sorted(EXPERIMENTS)}")
    e = EXPERIMENTS[name]
    if e.context:
        long = assemble.whole_cdf(long, winds, list(e.context))
    table = ml.derived_features(long)
    extra = present(table, list(e.aux)) + [f"{w}_q{q:02d}" for w in winds for q in e.context]
    return ml.features(long, winds, extra)


def run(name: str, long: DataFrame, winds: list[str], excluded: DataFrame, parameters: dict | None = None, **settings) -> DataFrame:
    """Predictions of the folds' stations, with the name of the experiment."""
    table, names, signs = prepared(name, long, winds)
    e = EXPERIMENTS[name]
    done = ml.leave_one_out(table, names, signs, excluded, method=e.method, parameters={**e.parameters, **(parameters or {})}, **settings)
    return done.withColumn("experiment", F.lit(name))


def report(runs: dict[str, DataFrame], base: str) -> DataFrame:
    """Pooled and mean-station errors of the runs over the stations that all of them have, and the change against the base."""
    keys = ["station_id", "height_m", "qnum"]
    first = runs[base].select(*keys, F.col("observed").alias("observation"), F.col("predicted").alias("pred_observation"))
    others = {k: df.select(*keys, F.col("predicted").alias("pred_observation")) for k, df in runs.items() if k != base}
    both = metrics.compared(first, others, keys)
    return metrics.change(metrics.pooled_and_mean(both, "station_id", ["pred_base", *[f"pred_{k}" for k in others]]), "pred_base", "pooled_rmse")


def sweep_report(manifest: DataFrame, features: str, metric: str = "rmse") -> DataFrame:
    """Mean change of the metric, with its interval, when each feature is added: over all pairs of runs with and without it."""
    pairs = metrics.paired_changes(manifest, F.col(features), metric)
    return metrics.interval(pairs, ["feature"], "change")
