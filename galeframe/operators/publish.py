"""Profiles as they are published: monotone, at the target heights, one file for each location."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.functions import cdf, labels
from galeframe.functions.constants import QCOLS, TARGET_HEIGHTS
from galeframe.operators.grid import vertical_fill


def profiles(wide: DataFrame, points: int = 101, index: str = "index") -> DataFrame:
    """(index, probability, windspeed_30m ... windspeed_100m), `points` rows (101 or 33) for each location."""
    if points not in (33, 101):
        raise ValueError("101 or 33 points")
    q = cdf.monotone(cdf.from_columns(QCOLS))
    rows = wide.select(labels.padded_index(F.col(index)).alias("index"), F.bround("height_m", 0).cast("int").alias("height_m"), (cdf.resampled(q, points) if points != 101 else q).alias("quantiles"))
    rows = rows.where(F.col("height_m").isin(TARGET_HEIGHTS)).dropDuplicates(["index", "height_m"])
    at = vertical_fill(rows, ["index"], TARGET_HEIGHTS)
    one = at.groupBy("index").agg(*[F.max(F.when(F.col("height_m") == h, F.col("profile"))).alias(f"windspeed_{h}m") for h in TARGET_HEIGHTS])
    out = one.select("index", F.posexplode(F.arrays_zip(*[f"windspeed_{h}m" for h in TARGET_HEIGHTS])).alias("_k", "_x"))
    return out.select("index", (F.col("_k") / float(points - 1)).alias("probability"), *[F.col(f"_x.windspeed_{h}m") for h in TARGET_HEIGHTS])


def location_index(wide: DataFrame) -> DataFrame:
    """One row of each location."""
    return wide.groupBy(labels.padded_index(F.col("index")).alias("index")).agg(F.min("latitude").alias("latitude"), F.min("longitude").alias("longitude"))


def equal_neighbours(profile_rows: DataFrame, columns: list[str], tolerance: float = 0.0) -> DataFrame:
    """Neighbouring points of each location's profiles that are equal."""
    arrays = profile_rows.groupBy("index").agg(F.array_sort(F.collect_list(F.struct("probability", *columns))).alias("_p"))
    return arrays.select("index", *[cdf.count_equal(F.col(f"_p.{c}"), tolerance).alias(c) for c in columns])


def latex_rows(summary: DataFrame, order: list[str], columns: list[str], digits: int = 3) -> list[str]:
    """Rows of a table, of an already aggregated result with a few rows."""
    got = {r["dataset"]: r for r in summary.select("dataset", *columns).collect()}
    return [" & ".join([d.replace("_", r"\_"), *["--" if got[d][c] is None else f"{got[d][c]:.{digits}f}" for c in columns]]) + r" \\" for d in order if d in got]
