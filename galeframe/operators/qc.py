"""Station quality control: metrics, robust z-scores, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.functions import cdf
from galeframe.functions.constants import MODELS
from galeframe.functions.labels import observation_type
from galeframe.operators.quantiles import medians
from galeframe.operators.schema import present


def row_mean(*columns: Column) -> Column:
    """Mean of the columns that are there."""
    there = F.filter(F.array(*[cdf.finite(c) for c in columns]), lambda x: x.isNotNull())
    return cdf.let(there, lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a)))


def robust_z(df: DataFrame, value: str, name: str = "zscore") -> DataFrame:
    """(x - median) / (1.4826 MAD), with the population deviation where the MAD is 0; NULL if nothing spreads."""
    v = cdf.finite(F.col(value))
    spread = df.agg(F.stddev_pop(v).alias("_sd"))
    centre = medians(df.select(v.alias("_m")), [], ["_m"])
    rows = df.crossJoin(F.broadcast(centre.crossJoin(F.broadcast(spread))))  # one row
    mad = medians(rows.select(F.abs(v - F.col("_m")).alias("_d")), [], ["_d"]).select((1.4826 * F.col("_d")).alias("_mad"))
    scale = F.when(F.col("_mad") > 1e-12, F.col("_mad")).when(F.col("_sd") > 1e-12, F.col("_sd"))
    return rows.crossJoin(F.broadcast(mad)).withColumn(name, (v - F.col("_m")) / scale).drop("_m", "_sd", "_mad")


def station_metrics(long: DataFrame, reference: str = "consensus", tolerance: float = 0.0, with_elevation: bool = False) -> DataFrame:
    """Of ASOS stations: finite rows, largest, 95th percentile and median, falling quantiles, the metric against the reference (median bias, or RMSE against the consensus), and its z-score."""
    models = present(long, MODELS) if reference == "consensus" else [reference]
    if not models or (lack := [m for m in models if m not in long.columns]):
        raise ValueError(f"no reference column {reference!r}" if not models else f"missing columns {lack}")
    rows = long.where(observation_type(F.col("observation_type")) == "ASOS").withColumn("_o", cdf.number(F.col("observation").cast("string"))).withColumn("_r", row_mean(*[F.col(m) for m in models]))
    e = F.col("_o") - F.col("_r")
    metric = F.sqrt(F.avg(e * e)) if reference == "consensus" else F.median(e)
    extra = [F.median(F.abs(F.col("elev_m") - F.col("elevation_m"))).alias("elev_diff")] if with_elevation else []
    points = F.array_sort(F.collect_list(F.struct(F.col("qnum").alias("q"), F.col("height_m").alias("h"), F.col("_o").alias("v")))) if "height_m" in long.columns else F.array_sort(F.collect_list(F.struct(F.col("qnum").alias("q"), F.col("_o").alias("v"))))
    g = rows.groupBy("station_id").agg(F.first("lat", True).alias("lat"), F.first("lon", True).alias("lon"), F.count("_o").alias("n_q"), F.max("_o").alias("obs_max"), F.percentile("_o", F.lit(0.95)).alias("obs_q95"), F.median("_o").alias("obs_med"), points.alias("_p"), metric.alias("metric"), *extra)
    g = g.withColumn("monotonic_violations", cdf.count_drops(F.col("_p.v"), tolerance)).drop("_p")
    return robust_z(g, "metric").withColumn("metric_label", F.lit("rmse_vs_consensus" if reference == "consensus" else f"bias_med_vs_{reference.upper()}"))


def flagged(stations: DataFrame, min_rows: int = 50, max_speed: float = 75.0, z_limit: float = 4.0, max_elevation: float | None = None) -> DataFrame:
    """Flags and their OR; a NULL never flags."""
    flags = {"flag_cov": F.col("n_q") < min_rows, "flag_wsmax": F.col("obs_max") > max_speed, "flag_mono": F.col("monotonic_violations") > 0, "flag_metric": F.abs("zscore") > z_limit}
    flags["flag_elev"] = F.col("elev_diff") > max_elevation if max_elevation is not None and "elev_diff" in stations.columns else F.lit(False)
    out = stations.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    any_of = F.lit(False)
    for k in flags:
        any_of = any_of | F.col(k)
    return out.withColumn("is_outlier", any_of)


def without_outliers(long: DataFrame, stations: DataFrame) -> DataFrame:
    """Rows of ASOS outlier stations go; other cohorts keep theirs."""
    bad = stations.where("is_outlier").select("station_id", F.lit("ASOS").alias("_t"))
    return long.withColumn("_t", observation_type(F.col("observation_type"))).join(bad, ["station_id", "_t"], "left_anti").drop("_t")
