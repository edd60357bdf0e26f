"""Gridded models: tiles, neighbour weights, vertical interpolation, quantiles of every point and height."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.functions import cdf, geo, wind
from galeframe.functions.constants import NEUTRAL_SHEAR
from galeframe.operators.spatial import idw_weights, nearest, project


def projected(points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """x and y (m) of the conic projection."""
    x, y = geo.conic(F.col(lat), F.col(lon))
    return points.withColumns({"x": x, "y": y})


def with_tiles(points: DataFrame, tile_km: float = 250.0) -> DataFrame:
    """tile_id of each point, counted from the smallest x and y."""
    p = points if {"x", "y"} <= set(points.columns) else projected(points)
    corner = p.agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"))
    step = tile_km * 1000.0
    p = p.crossJoin(F.broadcast(corner))
    return p.withColumn("tile_id", geo.tile_id(F.floor((F.col("x") - F.col("_x0")) / step), F.floor((F.col("y") - F.col("_y0")) / step))).drop("_x0", "_y0")


def missing_tiles(needed: DataFrame, there: DataFrame) -> DataFrame:
    return needed.select("tile_id").distinct().join(there.select("tile_id"), "tile_id", "left_anti")


def neighbour_weights(points: DataFrame, grid: DataFrame, point_id: str, grid_id: str, k: int = 4, power: float = 1.0) -> DataFrame:
    """(point_id, grid_id, weight): inverse distance to the k nearest grid points in the plane."""
    return idw_weights(nearest(points, grid, k, point_id, grid_id), point_id, power)


def needed_levels(heights: list[float], available: list[int]) -> list[int]:
    """Native levels that the heights lie between; only these are read."""
    out, levels = set(), sorted(available)
    for z in heights:
        if z in levels:
            out.add(z)
            continue
        lo = max([i for i, h in enumerate(levels) if h <= z], default=0)
        lo = min(lo, len(levels) - 2)
        out |= {levels[lo], levels[lo + 1]}
    return sorted(out)


def point_speeds(series: DataFrame, weights: DataFrame, point_id: str, grid_id: str, time: str, heights: list[float], levels: list[int], speed: str = "ws", direction: str = "wd", height: str = "height_m") -> DataFrame:
    """(point_id, time, z, speed): components are weighted at the native levels, turned into speeds, and carried to the heights from the upper of the two levels around."""
    u, v = wind.components(F.col(speed), F.col(direction))
    native = series.where(F.col(height).isin(needed_levels(heights, levels))).select(grid_id, time, height, u.alias("u"), v.alias("v"))
    at = project(native, weights, point_id, grid_id, [time, height], ["u", "v"]).withColumn("s", wind.magnitude(F.col("u"), F.col("v")))
    level = at.groupBy(point_id, time).agg(F.map_from_entries(F.collect_list(F.struct(F.col(height).cast("int"), F.col("s")))).alias("m"))
    made = []
    for z in heights:
        b = [h for h in needed_levels([z], levels)]
        lo, hi = b[0], b[-1]
        s = lambda h: F.try_element_at("m", F.lit(h))
        value = s(lo) if lo == hi else s(hi) * F.pow(F.lit(z / hi), wind.shear(s(lo), s(hi), lo, hi, NEUTRAL_SHEAR))
        made.append(F.struct(F.lit(float(z)).alias("z"), value.alias("speed")))
    return level.select(point_id, time, F.explode(F.array(*made)).alias("x")).select(point_id, time, F.col("x.z").alias("z"), F.col("x.speed").alias("speed"))


def tile_quantiles(speeds: DataFrame, point_id: str) -> DataFrame:
    """101 quantiles of each point and height over all times, as an array of floats, with the number of valid times."""
    return speeds.groupBy(point_id, F.col("z").alias("height_m")).agg(cdf.quantile_rows(F.col("speed")).cast("array<float>").alias("quantiles"), F.count(cdf.finite(F.col("speed"))).alias("n_hours"))


def surface_speeds(series: DataFrame, height: str = "height_m", fallback: float = NEUTRAL_SHEAR) -> DataFrame:
    """speed at the row's height from components at 10 and 100 m."""
    s10, s100 = wind.magnitude(F.col("u10"), F.col("v10")), wind.magnitude(F.col("u100"), F.col("v100"))
    return series.withColumn("speed", wind.at_height(s100, wind.shear(s10, s100, fallback=fallback), F.col(height)))


def vertical_fill(profiles: DataFrame, keys: list[str], heights: list[int], values: str = "quantiles", height: str = "height_m") -> DataFrame:
    """(keys, height_m, profile) at all the heights: the one that is there, between the two around, or from the nearest with neutral shear."""
    have = profiles.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.bround(F.col(height), 0).cast("int").alias("h"), F.col(values).alias("v")))).alias("p"))
    rows = have.withColumn("want", F.explode(F.array(*[F.lit(h) for h in heights])))
    lo = F.try_element_at(F.filter("p", lambda x: x["h"] < F.col("want")), F.lit(-1))
    hi = F.get(F.filter("p", lambda x: x["h"] > F.col("want")), F.lit(0))
    rows = rows.withColumns({"_same": F.get(F.filter("p", lambda x: x["h"] == F.col("want")), F.lit(0)), "_lo": lo, "_hi": hi})
    rows = rows.withColumn("_near", F.array_min(F.transform("p", lambda x: F.struct(F.abs(x["h"] - F.col("want")).alias("d"), x["h"].alias("h"), x["v"].alias("v")))))
    h = lambda c: F.col(f"{c}.h").cast("double")
    between = F.zip_with("_lo.v", "_hi.v", lambda a, b: a * F.pow(F.col("want") / h("_lo"), wind.clipped_shear(a, b, h("_lo"), h("_hi"))))
    near = F.transform("_near.v", lambda a: a * F.pow(F.col("want") / h("_near"), F.lit(NEUTRAL_SHEAR)))
    profile = F.when(F.col("_same").isNotNull(), F.col("_same.v")).when(F.col("_lo").isNotNull() & F.col("_hi").isNotNull(), between).otherwise(near)
    return rows.select(*keys, F.col("want").alias("height_m"), profile.alias("profile"))


def height_means(wide: DataFrame, q: list[str], digits: int = 6) -> DataFrame:
    """Mean of each row's quantiles, with rounded coordinate keys."""
    return wide.select(geo.rounded(F.col("lat"), digits).alias("lat_r"), geo.rounded(F.col("lon"), digits).alias("lon_r"), F.bround("height_m", 0).cast("int").alias("height_m"), cdf.mean_complete(cdf.from_columns(q)).cast("float").alias("mean_ws"))


def difference_map(predicted: DataFrame, dataset: DataFrame) -> DataFrame:
    """predicted - dataset where both have a mean at the rounded place and height."""
    keys = ["lat_r", "lon_r", "height_m"]
    return predicted.join(dataset.withColumnRenamed("mean_ws", "dataset_ws"), keys).withColumn("diff", F.col("mean_ws") - F.col("dataset_ws"))
