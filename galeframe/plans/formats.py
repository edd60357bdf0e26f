"""Gridded files: tables are written as HDF5, GRIB and GeoTIFF files by the executors, and read back whole."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.operators.cut import scratch
from galeframe.plans import encode
from galeframe.plans.base import POINTS, SITES, places, r, rounded, table
from galeframe.sources import grib, hdf5, ranges, tiff

#: Places of the series, and times of a year.
GIDS, DAYS = 48, 366


def _written(df: DataFrame, key: str, make) -> list[str]:
    """A file for each value of key, written by the task that has its rows; make(rows) gives its name and bytes."""
    folder = scratch(df.sparkSession)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        name, data = make(part)
        ranges.write(f"{folder}/{name}", data)
        return pd.DataFrame({"path": [f"{folder}/{name}"]})

    return sorted(row["path"] for row in df.groupBy(key).applyInPandas(one, "path string").collect())


def _orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), (F.dayofyear("o_orderdate") - 1).alias("day"), (F.col("o_custkey") % GIDS).alias("gid"))
    return o.groupBy("year", "day", "gid").agg(F.count("*").alias("n"))


def _series(part: pd.DataFrame) -> tuple[str, bytes]:
    """A year's orders by day and place, kept as whole numbers of a hundredth less one."""
    year = int(part.year.iloc[0])
    raw = np.zeros((DAYS, GIDS), "<i2")
    raw[part.day, part.gid] = part.n * 100
    times = np.array([f"{year}-{k:03d}".encode() for k in range(DAYS)])
    at = np.stack([25 + np.arange(GIDS) / 2, -120 + np.arange(GIDS) / 4], axis=1).astype("<f4")
    return f"conus_{year}.h5", encode.hdf5({"windspeed_10m": raw, "time_index": times, "coordinates": at}, {"windspeed_10m": {"scale_factor": 100.0, "add_offset": -1.0}}, {"windspeed_10m": (60, 20)})


def q129_hdf5_series(spark: SparkSession, d: str) -> DataFrame:
    """Yearly files by one of several names as one series: facts of each place, with its coordinates."""
    paths = _written(_orders(spark, d), "year", _series)
    root, years = paths[0].rpartition("/")[0], range(1990, 2030)
    files = ranges.yearly_files(root, list(years), ["wtk_conus_{year}.h5", "conus_{year}.h5", "conus-{year}.h5"], missing="skip")
    s = hdf5.read_series(spark, list(files.values()), "windspeed_10m")
    facts = s.groupBy("gid").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("high"), F.countDistinct("file").alias("files"), F.max(F.when(F.col("value") > -1, F.col("time"))).alias("last"))
    return rounded(facts.join(hdf5.read_places(spark, next(iter(files.values()))), "gid"))


def q130_hdf5_filtered(spark: SparkSession, d: str) -> DataFrame:
    """A season of the places east of the middle: both filters reach the files' chunks."""
    paths = _written(_orders(spark, d), "year", _series)
    s = hdf5.read_series(spark, paths, "windspeed_10m").where((F.col("gid") >= GIDS // 2) & (F.col("time") >= "1995-100") & (F.col("time") <= "1995-190"))
    return rounded(s.select("gid", "time", "value"))


#: Rows and columns of the fields.
LATS, LONS = 9, 14


def _fields(part: pd.DataFrame) -> tuple[str, bytes]:
    """A file of one variable: a message for each month, of edition 1 for even years and 2 for odd ones; cells without rows are missing."""
    name, out = part.name.iloc[0], b""
    for month, rows in part.groupby("month", sort=True):
        values, at = np.full((LATS, LONS), np.nan), datetime(int(month[:4]), int(month[5:7]), 1)
        values[rows.i, rows.j] = rows.value
        u = name == "u10"
        out += encode.grib2(values, 2 if u else 3, 10, at, 50.0, -125.0, 0.5, bits=20) if at.year % 2 else encode.grib1(values, 165 if u else 166, at, 50.0, -125.0, 0.5, bits=20)
    return f"{name}.grib", out


def q131_grib_fields(spark: SparkSession, d: str) -> DataFrame:
    """Two variables in a file each, merged by time and place."""
    t = table(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month"), (F.col("l_partkey") % LATS).cast("int").alias("i"), (F.col("l_suppkey") % LONS).cast("int").alias("j")).agg(F.sum("l_quantity").cast("double").alias("u10"), F.max("l_discount").cast("double").alias("v10"))
    paths = _written(t.unpivot(["month", "i", "j"], ["u10", "v10"], "name", "value"), "name", _fields)
    return rounded(grib.read_fields(spark, paths, ["u10", "v10"]).where("u10 is not null or v10 is not null"))


#: Rows and columns of the raster.
ROWS, COLUMNS = 23, 50


def _raster(part: pd.DataFrame) -> tuple[str, bytes]:
    cells = np.full((ROWS, COLUMNS), -9999.0, "<f4")
    cells[part.i, part.j] = part.n
    name, settings = ("tiled", {"tile": 16}) if part.kind.iloc[0] else ("striped", {"tile": None, "compression": 8, "predictor": 3})
    return f"{name}.tif", encode.tiff(cells, -120.0, 48.0, 1.0, nodata=-9999.0, **settings)


def q132_geotiff(spark: SparkSession, d: str) -> DataFrame:
    """An uncompressed tiled raster and a compressed one in strips, sampled at places inside, outside and without a value."""
    c = F.col("o_custkey")
    cells = table(spark, d, "orders").groupBy((c % ROWS).cast("int").alias("i"), (c % 37).cast("int").alias("j")).agg(F.count("*").alias("n"))
    paths = _written(cells.withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1)))), "kind", _raster)
    points = places(table(spark, d, "customer"), "c_custkey").unionByName(places(table(spark, d, "supplier"), "s_suppkey").withColumn("lat", F.col("lat") + 10))
    got = tiff.sample_rasters(points, {0: paths[0], 1: paths[1], 2: None})
    return rounded(got.select("id", "lat", "gwa_0", "gwa_1", "gwa_2"))


QUERIES = {k: f for k, f in globals().items() if k[0] == "q" and k[1:3].isdigit()}

_DAYS = f"o as (select year(o_orderdate) y, dayofyear(o_orderdate) - 1 k, o_custkey % {GIDS} gid, count(*) n from orders group by all), g as (select y, k, gid from (select distinct y from o), range({DAYS}) a(k), range({GIDS}) b(gid)), s as (select g.y, g.gid, g.y || '-' || lpad(g.k::varchar, 3, '0') t, coalesce(n, 0) - 1.0::double v from g left join o using (y, k, gid))"

ORACLES = {
    "q129_hdf5_series": f"with {_DAYS} select gid::bigint gid, count(*)::bigint n, {r('sum(v)')} total, {r('max(v)')} high, count(distinct y)::bigint files, max(t) filter (where v > -1) as last, {r('25 + gid / 2.0')} lat, {r('-120 + gid / 4.0')} lon from s group by gid",
    "q130_hdf5_filtered": f"with {_DAYS} select gid::bigint gid, t as time, {r('v')} as value from s where gid >= {GIDS // 2} and t between '1995-100' and '1995-190'",
    "q131_grib_fields": f"select strftime(date_trunc('month', l_shipdate), '%Y-%m-%dT00:00:00') as time, {r(f'50 - (l_partkey % {LATS}) * 0.5')} lat, {r(f'-125 + (l_suppkey % {LONS}) * 0.5')} lon, {r('sum(l_quantity)')} u10, {r('max(l_discount)')} v10 from lineitem group by 1, 2, 3",
    "q132_geotiff": f"with {SITES}, {POINTS}, c as (select o_custkey % {ROWS} i, o_custkey % 37 j, count(*) n from orders group by all), p as (select id, lat, lon from points union all select id, lat + 10, lon from sites), e as (select id, lat, n::double n from p left join c on i = cast(floor(48 - lat) as bigint) and j = cast(floor(lon + 120) as bigint)) select id, {r('lat')} lat, {r('n')} gwa_0, {r('n')} gwa_1, null::double gwa_2 from e",
}
