"""Paged HTTP services, rasters kept as tables, and outside services that are asked by place; read by the executors.

Gridded HDF5 and GRIB files are read by hdf5.py and grib.py, raster files by tiff.py.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

from galeframe.sources.grib import GribSource
from galeframe.sources.hdf5 import H5PlacesSource, H5Source

RETRY = frozenset({429, 500, 502, 503, 504})


def fetch(url: str, tries: int = 5, wait: float = 0.75, timeout: float = 20.0, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> str:
    """Text of the url; transient failures are tried again after 1, 2, 4... times the wait."""
    for k in range(tries):
        try:
            with opener(url, timeout=timeout) as r:
                return r.read().decode("utf-8")
        except urllib.error.HTTPError as e:
            if e.code not in RETRY or k == tries - 1:
                raise
        except (urllib.error.URLError, TimeoutError):
            if k == tries - 1:
                raise
        sleep(wait * 2**k)
    raise RuntimeError("no tries")


class PagedReader(DataSourceReader):
    """One partition for each key; pages are read until one is empty or repeats the one before."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in json.loads(self.options["keys"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page, before = 0, None
        while True:
            query = urllib.parse.urlencode({"key": partition.value, "page": page})
            text = fetch(f"{self.options['path']}?{query}", int(self.options.get("tries", 5)))
            if not text.strip() or text == before:
                return
            yield partition.value, page, text
            page, before = page + 1, text


class PagedStreamReader(DataSourceStreamReader):
    """An offset is the number of pages of each key, so that a download that was stopped goes on behind them.

    How many pages there are by now is found in a few requests, by doubling and halving: a page that is empty or repeats
    the one before is behind the end. A batch takes a limited number of pages of each key; the first one after a restart
    takes all that are left, as Spark doesn't tell the source where it stands.
    """

    def __init__(self, options: dict):
        self.options, self.keys = options, json.loads(options["keys"])
        self.pages, self.reached = int(options.get("pages", 64)), None

    def initialOffset(self) -> dict:
        self.reached = dict.fromkeys(self.keys, 0)
        return dict(self.reached)

    def _page(self, key: str, page: int) -> str:
        query = urllib.parse.urlencode({"key": key, "page": page})
        return fetch(f"{self.options['path']}?{query}", int(self.options.get("tries", 5)))

    def _there(self, key: str, page: int) -> bool:
        text = self._page(key, page)
        return bool(text.strip()) and (page == 0 or text != self._page(key, page - 1))

    def _count(self, key: str, known: int) -> int:
        """Pages of a key, of which the first `known` are there."""
        low, step = known, 1
        while self._there(key, low + step - 1):
            low, step = low + step, step * 2
        high = low + step - 1
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self._there(key, middle) else (low, middle)
        return low

    def latestOffset(self) -> dict:
        if self.reached is None:
            return {k: self._count(k, 0) for k in self.keys}
        return {k: min(self._count(k, p), p + self.pages) for k, p in self.reached.items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.reached = {k: end.get(k, 0) for k in self.keys}
        size = max(1, self.pages // 8)
        return [InputPartition((k, a, min(end[k], a + size))) for k in end for a in range(start.get(k, 0), end[k], size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        key, first, end = partition.value
        for page in range(first, end):
            yield key, page, self._page(key, page)

    def commit(self, end: dict) -> None:
        """The checkpoint keeps the offset."""


class PagedSource(DataSource):
    """spark.read.format("paged").options(path=url, keys='["a", "b"]').load() -> key, page, body; the same with readStream, whose checkpoint keeps the number of pages of each key."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "key string, page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (PagedSource, H5Source, H5PlacesSource, GribSource):
        spark.dataSource.register(source)


def raster_cells(raster: DataFrame, west: float, north: float, dx: float, dy: float, points: DataFrame, value: str = "value", nodata: float | None = None, lat: str = "lat", lon: str = "lon", name: str = "sample") -> DataFrame:
    """Samples a raster, kept as (row, col, value), at points: an equi-join by cell. nodata and values of -1e20 and less are NULL, points outside too."""
    r = F.floor((F.lit(north) - F.col(lat)) / dy).cast("long")
    c = F.floor((F.col(lon) - F.lit(west)) / dx).cast("long")
    good: Column = F.col(value) > -1e20
    if nodata is not None:
        good = good & (F.col(value) != nodata)
    cells = raster.select(F.col("row").cast("long").alias("_r"), F.col("col").cast("long").alias("_c"), F.when(good, F.col(value).cast("double")).alias(name))
    return points.withColumns({"_r": r, "_c": c}).join(cells, ["_r", "_c"], "left").drop("_r", "_c")


def looked_up(points: DataFrame, ask: Callable[[float, float, float], float | None], name: str = "elevation_m", pixel_sizes: tuple = (10.0, 30.0, 90.0), lat: str = "lat", lon: str = "lon", partitions: int = 16) -> DataFrame:
    """Values of an outside service at distinct places, asked once each by the executors; the first pixel size with an answer. reason tells why there is none."""
    places = points.select(lat, lon).where(f"{lat} is not null and {lon} is not null").distinct().repartition(partitions)

    def run(batches):
        for b in batches:
            rows = []
            for y, x in zip(b[lat], b[lon], strict=True):
                got, why = None, "no_value"
                for size in pixel_sizes:
                    try:
                        got = ask(y, x, size)
                    except Exception as e:
                        why = type(e).__name__
                        continue
                    if got is not None and np.isfinite(got):
                        break
                    got = None
                rows.append((y, x, got, None if got is not None else why))
            yield pd.DataFrame(rows, columns=[lat, lon, name, "reason"])

    found = places.mapInPandas(run, f"`{lat}` double, `{lon}` double, `{name}` double, reason string")
    return points.join(found, [lat, lon], "left")


def failures(looked: DataFrame, samples: int = 10, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Failed places by reason, with a few of them."""
    bad = looked.where("reason is not null").select("reason", lat, lon).distinct()
    # A rank that is limited is cut in each task before the rows of a reason meet.
    first = bad.withColumn("_k", F.row_number().over(Window.partitionBy("reason").orderBy(lat, lon))).where(F.col("_k") <= samples)
    shown = first.groupBy("reason").agg(F.array_sort(F.collect_list(F.struct(lat, lon))).alias("examples"))
    return bad.groupBy("reason").agg(F.count("*").alias("n")).join(shown, "reason")
