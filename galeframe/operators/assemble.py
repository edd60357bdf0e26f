"""The long training table: cohorts, enrichment, site means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.functions import cdf, geo, wind
from galeframe.functions.constants import GWA_HEIGHTS, MODELS
from galeframe.operators.reshape import to_long, unique

KEYS = ["station_id", "height_m", "qnum"]


def cohort(label: str, era5: DataFrame, observed: DataFrame | None = None, models: dict[str, DataFrame] | None = None) -> DataFrame:
    """One cohort of wide tables as a long table, for the keys of its ERA5 table. All sources are stacked and pivoted in one shuffle; duplicates of a key give its smallest value."""
    sources = {"era5": era5, "observation": observed, **(models or {})}
    long, meta = None, None
    for name, wide in sources.items():
        if wide is None:
            continue
        one, m = to_long(wide, f"{label} {name}")
        meta = m if name == "era5" else meta
        one = one.withColumn("_s", F.lit(name))
        long = one if long is None else long.unionByName(one)
    names = ["observation", *MODELS]
    values = [F.min(F.when(F.col("_s") == n, F.col("value"))).alias(n) for n in names]
    table = long.groupBy(*KEYS).agg(*values, F.max((F.col("_s") == "era5").cast("int")).alias("_k")).where("_k = 1").drop("_k")
    return table.join(meta, ["station_id", "height_m"], "left").withColumn("observation_type", F.lit(label)).select("station_id", "name", "lat", "lon", "elev_m", "height_m", "qnum", *names, "observation_type")


def cohort_long(keys: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Long tables (station_id, height_m, qnum, value) left-joined to the keys, each as a column of its name."""
    stacked = None
    for name, df in sources.items():
        one = df.select(*KEYS, F.lit(name).alias("_s"), "value")
        stacked = one if stacked is None else stacked.unionByName(one)
    wide = stacked.groupBy(*KEYS).agg(*[F.min(F.when(F.col("_s") == n, F.col("value"))).alias(n) for n in sources])
    return keys.join(wide, KEYS, "left")


def at_places(rows: DataFrame, places: DataFrame, values: list[str], digits: int = 6, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Left join by rounded coordinates (never by raw doubles); the places must be unique."""
    p = places.select(geo.rounded(F.col(lat), digits).alias("_la"), geo.rounded(F.col(lon), digits).alias("_lo"), *values)
    keyed = rows.withColumns({"_la": geo.rounded(F.col(lat), digits), "_lo": geo.rounded(F.col(lon), digits)})
    return keyed.join(unique(p, ["_la", "_lo"]), ["_la", "_lo"], "left").drop("_la", "_lo")


def unique_sites(long: DataFrame) -> DataFrame:
    """station_id, observation_type (the least), median place."""
    return long.groupBy("station_id").agg(F.min("observation_type").alias("observation_type"), F.median("lat").alias("lat"), F.median("lon").alias("lon"))


def with_neighbours(long: DataFrame, lists: DataFrame) -> DataFrame:
    """Neighbour lists for GS rows, '' and 0 for all others."""
    gs = F.col("observation_type") == "GS"
    out = long.join(lists, "station_id", "left")
    return out.withColumns({"neighbors_km_site_ids": F.when(gs, F.coalesce("neighbors_km_site_ids", F.lit(""))).otherwise(""), "neighbors_km_count": F.when(gs, F.coalesce("neighbors_km_count", F.lit(0))).otherwise(0)})


def site_means(long: DataFrame, min_rows: int = 5) -> DataFrame:
    """Site-height table with the observed mean (true trapezoid); NULL with less than min_rows rows."""
    g = long.groupBy("station_id", "height_m").agg(F.count("*").alias("_n"), cdf.collected(F.col("qnum"), F.col("observation")).alias("_p"), *[F.first(c, ignorenulls=True).alias(c) for c in ("name", "lat", "lon", "elevation_m") if c in long.columns])
    return g.withColumn("ws_avg", F.when(F.col("_n") >= min_rows, cdf.mean_normalised(F.col("_p")))).drop("_n", "_p")


def gwa_at_height(sites: DataFrame, prefix: str = "gwa_", name: str = "gwa_interp") -> DataFrame:
    """Speed at the row's height from the atlas levels, by the piecewise power law."""
    return sites.withColumn(name, wind.power_law(F.col("height_m"), GWA_HEIGHTS, [cdf.finite(F.col(f"{prefix}{h}")) for h in GWA_HEIGHTS]))


def gwa_fitted(rows: DataFrame, prefix: str = "gwa_", name: str = "gwa_fit") -> DataFrame:
    """Speed at the row's height by the least-squares power law; a positive value already there stays."""
    fit = wind.fitted(F.col("height_m"), [cdf.finite(F.col(f"{prefix}{h}")) for h in GWA_HEIGHTS])
    return rows.withColumn(name, F.when(F.col(name) > 0, F.col(name)).otherwise(fit) if name in rows.columns else fit)


def with_gwa(long: DataFrame, gwa: DataFrame, value: str = "gwa_interp", covered_only: bool = False) -> DataFrame:
    """Atlas value by station and height; duplicates there would multiply rows, so the first (smallest) counts."""
    one = gwa.where("station_id is not null and height_m is not null").groupBy("station_id", "height_m").agg(F.min(value).alias(value))
    return long.join(one, ["station_id", "height_m"], "inner" if covered_only else "left").where(F.col(value).isNotNull() if covered_only else F.lit(True))


def whole_cdf(long: DataFrame, values: list[str], numbers: list[int] | None = None) -> DataFrame:
    """Quantiles of the row's whole distribution on each row, as columns like era5_q50."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("station_id", "height_m")
    return long.withColumns({f"{v}_q{q:02d}": F.max(F.when(F.col("qnum") == q, F.col(v))).over(w) for v in values for q in (numbers or [50, 90])})


def wide_means(wide: DataFrame) -> DataFrame:
    """station_id, name, lat, lon, height_m and mean_ws (trapezoid over neighbouring quantiles that are there) of a wide table."""
    from galeframe.operators.schema import aliased, quantile_columns

    q = quantile_columns(wide)
    w = aliased(wide, ["station_id", "lat", "lon"], ["name", "height_m"])
    return w.select(F.col("station_id").cast("string").alias("station_id"), "name", cdf.number(F.col("lat")).alias("lat"), cdf.number(F.col("lon")).alias("lon"), cdf.number(F.col("height_m")).alias("height_m"), cdf.mean_adjacent(F.array(*[cdf.number(F.col(c)) for c in q])).alias("mean_ws"))


def gwa_distinct(rows: DataFrame, places: DataFrame, levels: list[str]) -> DataFrame:
    """Atlas levels of the distinct places joined back to all rows, and the fitted speed at each row's height."""
    return gwa_fitted(at_places(rows, places, levels))
