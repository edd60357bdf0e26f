"""Errors by row, quantile, station, dataset and height band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.functions import cdf
from galeframe.functions.labels import observation_type
from galeframe.operators.ordered import cumulative_share
from galeframe.operators.quantiles import medians, ranked_percentiles


def stacked(df: DataFrame, keep: list[str], columns: list[str], name: str = "dataset", value: str = "value") -> DataFrame:
    """One row of each of the columns, without NaN."""
    return df.select(*keep, *[cdf.finite(F.col(c)).alias(c) for c in columns]).unpivot(keep, columns, name, value)


def errors(e: Column) -> list[Column]:
    """Aggregates rmse, mae, bias and n of an error."""
    return [F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.count(e).alias("n")]


def error_rows(df: DataFrame, keep: list[str], datasets: list[str], observed: str = "observation") -> DataFrame:
    """(keep, dataset, error) of pairs that are both finite."""
    rows = stacked(df.withColumn("_o", cdf.finite(F.col(observed))), [*keep, "_o"], datasets)
    return rows.select(*keep, "dataset", (F.col("value") - F.col("_o")).alias("error")).where("error is not null")


def row_metrics(df: DataFrame, datasets: list[str], subset: str = "GS", observed: str = "observation") -> DataFrame:
    if subset != "ALL":
        df = df.where(observation_type(F.col("observation_type")) == subset)
    return error_rows(df, [], datasets, observed).groupBy("dataset").agg(*errors(F.col("error"))).withColumn("subset", F.lit(subset))


def metrics_by(df: DataFrame, keys: list[str], datasets: list[str], observed: str = "observation") -> DataFrame:
    """rmse, mae, bias and n by the keys and dataset: station, quantile, or any other."""
    return error_rows(df, keys, datasets, observed).groupBy(*keys, "dataset").agg(*errors(F.col("error")))


def pooled_and_mean(df: DataFrame, station: str, datasets: list[str], observed: str = "observation") -> DataFrame:
    """For each dataset: errors over all rows, and the means of the stations' errors. The pooled sums come from the stations' sums, so there's one shuffle of the rows."""
    e = F.col("error")
    by = error_rows(df, [station], datasets, observed).groupBy(station, "dataset").agg(F.sum(e * e).alias("s2"), F.sum(F.abs(e)).alias("s1"), F.count("*").alias("n"))
    return by.groupBy("dataset").agg(F.sqrt(F.sum("s2") / F.sum("n")).alias("pooled_rmse"), (F.sum("s1") / F.sum("n")).alias("pooled_mae"), F.avg(F.sqrt(F.col("s2") / F.col("n"))).alias("station_rmse"), F.avg(F.col("s1") / F.col("n")).alias("station_mae"), F.count("*").alias("n_stations"), F.sum("n").alias("n_rows"))


def change(metrics: DataFrame, base: str, value: str) -> DataFrame:
    """Per cent by which each dataset's value differs from the base dataset's."""
    b = metrics.where(F.col("dataset") == base).select(F.col(value).alias("_b"))
    return metrics.crossJoin(F.broadcast(b)).withColumn("change_pct", F.try_divide(F.col(value) - F.col("_b"), F.col("_b")) * 100).drop("_b")


def tail_report(df: DataFrame, cutoff: int, datasets: list[str], observed: str = "observation") -> DataFrame:
    """Errors over all quantiles, below the cutoff and from it on."""
    part = F.explode(F.array(F.lit("all"), F.when(F.col("qnum") >= cutoff, "tail").otherwise("body")))
    return error_rows(df.withColumn("part", part), ["part"], datasets, observed).groupBy("part", "dataset").agg(*errors(F.col("error")))


def site_bias(long: DataFrame, datasets: list[str], min_rows: int = 10, observed: str = "observation") -> DataFrame:
    """Means of each station and height by source, their biases and absolute biases; stations with less finite quantile numbers go."""
    names = [observed, *datasets]
    points = [cdf.collected(cdf.number(F.col("qnum")), F.col(c)).alias(f"_{c}") for c in names]
    g = long.groupBy("station_id", "height_m").agg(F.count(cdf.number(F.col("qnum"))).alias("_n"), F.min("observation_type").alias("observation_type"), *points).where(F.col("_n") >= min_rows)
    g = g.withColumn("observation_type", observation_type(F.col("observation_type"))).withColumns({f"mean_{c}": cdf.mean_dense(F.col(f"_{c}")) for c in names}).drop("_n", *[f"_{c}" for c in names])
    g = g.withColumns({f"bias_{d}": F.col(f"mean_{d}") - F.col(f"mean_{observed}") for d in datasets})
    return g.withColumns({f"absbias_{d}": F.abs(f"bias_{d}") for d in datasets})


def bias_rows(site: DataFrame, datasets: list[str], keep: list[str], observed: str = "mean_observation") -> DataFrame:
    """(keep, dataset, bias, absbias, pct) where the observed mean is positive."""
    rows = stacked(site.withColumn("_o", cdf.finite(F.col(observed))), [*keep, "_o"], [f"bias_{d}" for d in datasets], value="bias").where("bias is not null and _o > 0")
    return rows.select(*keep, F.substring("dataset", 6, 1000).alias("dataset"), "bias", F.abs("bias").alias("absbias"), (F.abs("bias") / F.col("_o") * 100).alias("pct"))


def _with_medians(rows: DataFrame, keys: list[str], of: dict[str, str], *more: Column) -> DataFrame:
    """Aggregates of groups of any size: medians, of = {new column: column}, by ranks, and others beside them."""
    middle = medians(rows, keys, list(of.values())).select(*[F.col(k).alias(f"_g_{k}") for k in keys], *[F.col(c).alias(n) for n, c in of.items()])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    return rows.groupBy(*keys).agg(*more).join(middle, same, "left").drop(*[f"_g_{k}" for k in keys])


def summary(site: DataFrame, datasets: list[str], keep: str = "observation_type") -> DataFrame:
    rows = bias_rows(site, datasets, [keep]).withColumnRenamed(keep, "subset")
    middle = {"median_bias": "bias", "median_abs_bias": "absbias", "median_abs_pct_bias": "pct"}
    return _with_medians(rows, ["dataset", "subset"], middle, F.avg("absbias").alias("mean_abs_bias"), F.avg("pct").alias("mean_abs_pct_bias"), F.count("*").alias("n_sites"))


def height_band(c: Column, width: int) -> Column:
    """Nearest multiple of the width, half to even."""
    return F.bround(c / F.lit(float(width)), 0) * float(width)


def band_biases(site: DataFrame, datasets: list[str], subset: str = "GS", width: int = 10) -> DataFrame:
    """(dataset, height_band_m, height_m, bias, absbias, pct): what the panels by height show."""
    rows = site.where(F.col("observation_type") == subset).withColumn("height_band_m", height_band(F.col("height_m"), width))
    return bias_rows(rows, datasets, ["height_band_m", "height_m"])


def band_metrics(site: DataFrame, datasets: list[str], subset: str = "GS", width: int = 10) -> DataFrame:
    rows = band_biases(site, datasets, subset, width)
    got = _with_medians(rows, ["dataset", "height_band_m"], {"median_abs_bias": "absbias"}, F.avg("bias").alias("mean_bias"), F.avg("absbias").alias("mean_abs_bias"), F.avg("pct").alias("mean_abs_pct_bias"), F.count("*").alias("n_sites"))
    return got.withColumn("subset", F.lit(subset))


def group_differences(long: DataFrame, dataset: str, predicted: str = "pred_observation", keys: tuple = ("station_id", "height_m"), observed: str = "observation") -> DataFrame:
    """|mean prediction - mean observed| - |mean dataset - mean observed| by group."""
    rows = long.withColumns({c: cdf.finite(F.col(c)) for c in (dataset, predicted, observed)}).dropna(subset=[dataset, predicted, observed, *keys])
    g = rows.groupBy(*keys).agg(F.avg(predicted).alias("_p"), F.avg(dataset).alias("_d"), F.avg(observed).alias("_o"))
    g = g.withColumns({"ml_abs_err_mean": F.abs(F.col("_p") - F.col("_o")), "ds_abs_err_mean": F.abs(F.col("_d") - F.col("_o"))})
    return g.withColumn("diff", F.col("ml_abs_err_mean") - F.col("ds_abs_err_mean")).drop("_p", "_d", "_o")


def difference_curve(diffs: DataFrame, *ties: str) -> DataFrame:
    """The differences with their cumulative share, and the share of groups that got better."""
    better = diffs.agg(F.avg((F.col("diff") < 0).cast("int")).alias("share_better"))
    return cumulative_share(diffs, "diff", *ties).crossJoin(F.broadcast(better))


def bias_quartiles(long: DataFrame, datasets: list[str], observed: str = "observation") -> DataFrame:
    """q25, median and q75 of the error by quantile number and dataset."""
    q = ranked_percentiles(error_rows(long, ["qnum"], datasets, observed), ["qnum", "dataset"], "error", [0.25, 0.5, 0.75])
    return q.groupBy("qnum", "dataset").agg(*[F.max(F.when(F.col("k") == i, F.col("value"))).alias(n) for i, n in enumerate(("q25", "median", "q75"))])


def limits(df: DataFrame, columns: list[str], trim: float = 0.02) -> DataFrame:
    """low and high: trimmed percentiles over the pooled columns; symmetric: the larger of their sizes."""
    q = ranked_percentiles(stacked(df, [], columns), [], "value", [trim, 1 - trim])
    low, high = F.max(F.when(F.col("k") == 0, F.col("value"))), F.max(F.when(F.col("k") == 1, F.col("value")))
    return q.agg(low.alias("low"), high.alias("high"), F.greatest(F.abs(low), F.abs(high)).alias("symmetric"))


def axis_limit(df: DataFrame, columns: list[str], default: float = 20.0) -> DataFrame:
    """1.05 times the 99th percentile over the pooled columns."""
    return ranked_percentiles(stacked(df, [], columns), [], "value", [0.99]).agg(F.coalesce(F.max("value") * 1.05, F.lit(default)).alias("x_max"))


def interval(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and 95 % interval (normal); NULL bounds with less than two values."""
    v = cdf.finite(F.col(value))
    half = F.when(F.count(v) >= 2, 1.96 * F.stddev_samp(v) / F.sqrt(F.count(v)))
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), (F.avg(v) - half).alias("low"), (F.avg(v) + half).alias("high"), F.count(v).alias("n"))


def bias_table(model: DataFrame, observed: DataFrame, keys: list[str], value: str = "mean_ws") -> DataFrame:
    """model - observed by key, pairs with both finite."""
    m = model.select(*keys, cdf.finite(F.col(value)).alias("model"))
    o = observed.select(*keys, cdf.finite(F.col(value)).alias("obs"))
    return m.join(o, keys).where("model is not null and obs is not null").withColumn("bias", F.col("model") - F.col("obs"))


def trimmed_stations(bias: DataFrame, key: str, trim: float = 0.02) -> DataFrame:
    """Keys whose bias is within the symmetric trimmed limit."""
    lim = limits(bias, ["bias"], trim).select("symmetric")
    return bias.crossJoin(F.broadcast(lim)).where(F.abs("bias") <= F.col("symmetric")).select(key)


def compared(base: DataFrame, experiments: dict[str, DataFrame], keys: list[str], predicted: str = "pred_observation") -> DataFrame:
    """Baseline rows of the stations that every experiment has, with each prediction as a column pred_<name>."""
    out = base.withColumnRenamed(predicted, "pred_base")
    for name, df in experiments.items():
        out = out.join(df.select(*keys, F.col(predicted).alias(f"pred_{name}")), keys)
    return out


def hybrid(df: DataFrame, cutoff: int, low: str, high: str, name: str = "pred_hybrid") -> DataFrame:
    """high from the cutoff quantile on, low below it."""
    return df.withColumn(name, F.when(F.col("qnum") >= cutoff, F.col(high)).otherwise(F.col(low)))


def paired_changes(runs: DataFrame, features: str, metric: str) -> DataFrame:
    """(feature, base set, change of the metric when the feature is added), over all pairs of runs S and S + feature. Joined on the set itself."""
    r = runs.select(F.array_sort(features).alias("_s"), F.col(metric).alias("_m"))
    larger = r.withColumn("feature", F.explode("_s")).select("feature", F.array_remove("_s", F.col("feature")).alias("_s"), F.col("_m").alias("_with"))
    return larger.join(r, "_s").select("feature", F.array_join("_s", "+").alias("base"), (F.col("_with") - F.col("_m")).alias("change"))


def subsets(sets: DataFrame, features: Column) -> DataFrame:
    """Each non-empty subset of a row's features, by bit mask."""
    rows = sets.withColumn("_f", features).withColumn("mask", F.explode(F.sequence(F.lit(1), (F.pow(F.lit(2), F.size("_f")) - 1).cast("int"))))
    return rows.withColumn("subset", F.filter("_f", lambda x, i: F.floor(F.col("mask") / F.pow(F.lit(2), i)) % 2 == 1)).drop("_f")
