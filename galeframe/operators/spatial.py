"""Radius, nearest-neighbour and nearest-height joins by cells, and interpolation from neighbours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galeframe.functions.constants import EARTH_KM
from galeframe.functions.geo import haversine_km, idw
from galeframe.operators.cut import cut


#: Points whose neighbours one task looks for.
TASK_POINTS = 20_000


def radius_pairs(left: DataFrame, right: DataFrame, radius_km: float, left_id: str, right_id: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(left_id, right_id, km) of points within the radius. Both sides carry only ids and places; the left side is put in nine cells.

    Cells are as high as the radius and, so that nine suffice at any latitude, as wide as it is at the poleward edge of
    the bands beside their own. Points at the date line see each other (longitudes wrap round).
    """
    step = math.degrees(radius_km / EARTH_KM) * 1.0000001
    band = lambda y: F.floor((F.col(y) + 90.0) / step).cast("long")

    def columns_of(b: Column) -> Column:
        """Cells of a band that go round the earth: each is the radius wide at least, on the side nearer the pole."""
        edge = F.least(F.greatest(F.abs((b - 1) * step - 90.0), F.abs((b + 2) * step - 90.0)), F.lit(90.0))
        half = F.asin(F.least(F.lit(1.0), math.sin(min(radius_km / EARTH_KM / 2, math.pi / 2)) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-9))))
        return F.greatest(F.floor(F.lit(math.pi) / F.greatest(half, F.lit(1e-9)) * 0.999999), F.lit(1)).cast("long")

    cell = lambda x, n: F.least(F.floor(F.pmod(x + 180.0, F.lit(360.0)) / 360.0 * n).cast("long"), n - 1)
    b = right.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(right_id).alias("_b"), F.col(lat).cast("double").alias("_blat"), F.col(lon).cast("double").alias("_blon"))
    b = b.withColumn("_cy", band("_blat")).withColumn("_cx", cell(F.col("_blon"), columns_of(F.col("_cy"))))
    a = left.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(left_id).alias("_a"), F.col(lat).cast("double").alias("_alat"), F.col(lon).cast("double").alias("_alon"))
    a = a.withColumn("_cy", F.explode(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: band("_alat") + d)))
    n = columns_of(F.col("_cy"))
    a = a.withColumn("_n", n).withColumn("_c", cell(F.col("_alon"), F.col("_n")))
    a = a.withColumn("_cx", F.explode(F.array_distinct(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.pmod(F.col("_c") + d, F.col("_n")))))).drop("_n", "_c")
    km = haversine_km(F.col("_alat"), F.col("_alon"), F.col("_blat"), F.col("_blon"))
    return a.join(b, ["_cy", "_cx"]).withColumn("km", km).where(F.col("km") <= radius_km).select(F.col("_a").alias(left_id), F.col("_b").alias(right_id), "km")


def neighbour_lists(sites: DataFrame, radius_km: float = 10.0) -> DataFrame:
    """For GS sites: neighbours_km_site_ids (sorted, comma-separated) and count of other sites within the radius."""
    from galeframe.functions.labels import observation_type

    s = sites.withColumn("_type", observation_type(F.col("observation_type")))
    pairs = radius_pairs(s.where("_type = 'GS'").withColumnRenamed("station_id", "gs"), s, radius_km, "gs", "station_id").where("gs <> station_id")
    lists = pairs.groupBy("gs").agg(F.array_sort(F.collect_list(F.col("station_id").cast("string"))).alias("_l"))
    gs = s.where("_type = 'GS' and lat is not null and lon is not null").select(F.col("station_id")).distinct()
    return gs.join(lists.withColumnRenamed("gs", "station_id"), "station_id", "left").select("station_id", F.array_join(F.coalesce("_l", F.array().cast("array<string>")), ",").alias("neighbors_km_site_ids"), F.coalesce(F.size("_l"), F.lit(0)).alias("neighbors_km_count"))


def nearest(points: DataFrame, grid: DataFrame, k: int, point_id: str, grid_id: str, x: str = "x", y: str = "y", cell: float | None = None, measure: str = "euclid") -> DataFrame:
    """(point_id, grid_id, distance, rank) of the k nearest grid points of each point; ties by grid_id.

    Points look in the 3 x 3 cells around their own; those that don't find k within one cell's width look again with
    cells three times as wide, until all are served. measure: euclid (planar units) or km (x, y are degrees east and north; longitudes don't wrap round).
    """
    spark = points.sparkSession
    g = grid.where(f"`{x}` is not null and `{y}` is not null").select(F.col(grid_id).alias("_g"), F.col(x).cast("double").alias("_gx"), F.col(y).cast("double").alias("_gy"))
    p = points.where(f"`{x}` is not null and `{y}` is not null").select(F.col(point_id).alias("_p"), F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py"))
    b = g.agg(F.min("_gx"), F.max("_gx"), F.min("_gy"), F.max("_gy"), F.count("*")).first()
    if not b[4]:
        return spark.createDataFrame([], f"`{point_id}` {points.schema[point_id].dataType.simpleString()}, `{grid_id}` {grid.schema[grid_id].dataType.simpleString()}, distance double, rank int")
    out_box = p.agg(F.min("_px"), F.max("_px"), F.min("_py"), F.max("_py"), F.count("*")).first()
    width, height = max(b[1] - b[0], 1e-9), max(b[3] - b[2], 1e-9)
    reach = max(width, height, *[abs(v - w) for v, w in zip(out_box[:4], b[:4], strict=True) if v is not None]) if out_box[0] is not None else max(width, height)
    size = cell or max(math.sqrt(width * height * max(k, 1) / b[4]), 1e-9)
    d = haversine_km(F.col("_py"), F.col("_px"), F.col("_gy"), F.col("_gx")) if measure == "km" else F.hypot(F.col("_px") - F.col("_gx"), F.col("_py") - F.col("_gy"))
    # A point is some forty rows below, sorted where it lies; a table of points may be one small file, read by one task.
    found, left = None, p.repartition(max(spark.sparkContext.defaultParallelism, -(-out_box[4] // TASK_POINTS)))
    while True:
        last = size > 2 * reach + 1
        g_cells = g.withColumns({"_cx": F.floor(F.col("_gx") / size), "_cy": F.floor(F.col("_gy") / size)})
        steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
        p_cells = left.withColumn("_cx", F.explode(F.transform(steps, lambda i: F.floor(F.col("_px") / size) + i))).withColumn("_cy", F.explode(F.transform(steps, lambda i: F.floor(F.col("_py") / size) + i)))
        near = p_cells.join(g_cells, ["_cx", "_cy"]).withColumn("distance", d)
        best = near.withColumn("rank", F.row_number().over(Window.partitionBy("_p").orderBy("distance", "_g"))).where(F.col("rank") <= k)
        # Sure if the k-th is nearer than what may lie outside the cells.
        if measure == "km":
            safe = 2 * EARTH_KM * F.asin(F.cos(F.radians(F.least(F.abs("_py") + size, F.lit(90.0)))) * math.sin(math.radians(min(size, 180.0)) / 2)) * 0.999
        else:
            safe = F.lit(size)
        sure = best.groupBy("_p").agg(F.count("*").alias("_n"), F.max("distance").alias("_d"), F.max(safe).alias("_s")).where(F.lit(last) | ((F.col("_n") >= k) & (F.col("_d") <= F.col("_s")))).select("_p")
        sure = cut(sure) if not last else sure
        part = best.join(sure, "_p", "left_semi")
        found = part if found is None else found.unionByName(part)
        if last:
            break
        left = cut(left.join(sure, "_p", "left_anti"))
        size *= 3
        if left.isEmpty():
            break
    return found.select(F.col("_p").alias(point_id), F.col("_g").alias(grid_id), "distance", "rank")


def idw_weights(neighbours: DataFrame, point_id: str, power: float = 1.0) -> DataFrame:
    """neighbours with weights that add up to one for each point; a neighbour at distance 0 takes all (the first of them)."""
    w = Window.partitionBy(point_id)
    hit = F.min(F.when(F.col("distance") <= 0, F.col("rank"))).over(w)
    return neighbours.withColumn("_hit", hit).withColumn("weight", F.when(F.col("_hit").isNotNull(), (F.col("rank") == F.col("_hit")).cast("double")).otherwise(idw(F.col("distance"), power) / F.sum(idw(F.col("distance"), power)).over(w))).drop("_hit")


def project(series: DataFrame, weights: DataFrame, point_id: str, grid_id: str, time: list[str], values: list[str]) -> DataFrame:
    """Weighted sums of gridded series at the points: one equi-join on the grid id, then a partial aggregation."""
    return series.join(weights.select(point_id, grid_id, "weight"), grid_id).groupBy(point_id, *time).agg(*[F.sum(F.col(v) * F.col("weight")).alias(v) for v in values])


def nearest_height(c: Column, heights: list[float]) -> Column:
    """The available height nearest to c; the lower of two equals."""
    return F.array_min(F.array(*[F.struct(F.abs(F.lit(float(h)) - c).alias("d"), F.lit(float(h)).alias("h")) for h in heights]))["h"]


def lookup(points: DataFrame, table: DataFrame, heights: list[float], value: str, point_id: str = "id") -> DataFrame:
    """value of the nearest site (great circle) at the nearest available height: an equi-join on the height, one nearest site each."""
    asked = points.withColumn("_h", nearest_height(F.col("height_m"), heights))
    out = None
    for h in heights:  # a few levels
        some = asked.where(F.col("_h") == float(h))
        level = table.where(F.col("height_m") == float(h))
        near = nearest(some, level.withColumn("_site", F.monotonically_increasing_id()) if "site" not in level.columns else level.withColumnRenamed("site", "_site"), 1, point_id, "_site", "lon", "lat", measure="km")
        got = near.join(level.select(F.col("site").alias("_site"), F.col(value)), "_site").select(point_id, F.lit(float(h)).alias("height_used"), F.col("_site").alias("site"), "distance", value)
        out = got if out is None else out.unionByName(got)
    return out


def bilinear(points: DataFrame, grid: DataFrame, step: float, values: list[str], point_id: str = "id", how: str = "linear", time: list[str] = ()) -> DataFrame:
    """values of a regular grid (lat, lon multiples of step) at points; outside the grid NULL. Joins the four corners by whole-number keys."""
    g = grid.select((F.bround(F.col("lat") / step, 0)).cast("long").alias("_i"), F.bround(F.col("lon") / step, 0).cast("long").alias("_j"), *time, *values)
    y, x = F.col("lat") / step, F.col("lon") / step
    if how == "nearest":
        keyed = points.withColumns({"_i": F.bround(y, 0).cast("long"), "_j": F.bround(x, 0).cast("long")})
        return keyed.join(g, ["_i", "_j"], "left").select(point_id, *time, *values)
    near = lambda v: F.when(F.abs(v - F.bround(v, 0)) < 1e-9, F.bround(v, 0)).otherwise(v)
    p = points.withColumns({"_y": near(y), "_x": near(x)})
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    p = p.withColumn("_c", F.explode(corners)).withColumns({"_fy": F.col("_y") - F.floor("_y"), "_fx": F.col("_x") - F.floor("_x")})
    p = p.withColumn("_w", F.when(F.col("_c.a") == 0, 1 - F.col("_fy")).otherwise(F.col("_fy")) * F.when(F.col("_c.b") == 0, 1 - F.col("_fx")).otherwise(F.col("_fx")))
    p = p.where("_w > 0").withColumns({"_i": F.floor("_y") + F.col("_c.a"), "_j": F.floor("_x") + F.col("_c.b")})
    joined = p.join(g, ["_i", "_j"], "left")
    inside = lambda v: F.when(F.sum(F.when(F.col(v).isNotNull(), F.col("_w")).otherwise(0.0)) > 1 - 1e-9, F.sum(F.col(v) * F.col("_w"))).alias(v)
    return joined.groupBy(point_id, *time).agg(*[inside(v) for v in values])


def once_per_key(df: DataFrame, keys: list[str], compute) -> DataFrame:
    """compute(distinct keys) joined back to all rows: for what is dear to compute."""
    return df.join(compute(df.select(*keys).distinct()), keys, "left")
