"""Between wide and long quantile tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.functions import cdf, labels
from galeframe.functions.constants import N_QUANTILES, QCOLS
from galeframe.operators.schema import aliased, quantile_columns, require


def _stacked(wide: DataFrame, columns: list[str], ids: list[str]) -> DataFrame:
    """(ids, _q, value): a row for each of the columns, as a number. The columns travel as one array, so that a row isn't projected once for each."""
    values = F.array(*[cdf.number(F.col(c)) for c in columns])
    names = F.array(*[F.lit(c) for c in columns])
    return wide.select(*ids, F.posexplode(values).alias("_k", "value")).select(*ids, F.get(names, F.col("_k")).alias("_q"), "value")


def to_long(wide: DataFrame, label: str = "table", default_height: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """(station_id, height_m, qnum, value), and one row of metadata for each station and height."""
    q = quantile_columns(wide)
    if len(q) < 50:
        raise ValueError(f"{label}: {len(q)} quantile columns")
    if "height_m" not in wide.columns and not {"height", "z"} & {c.lower() for c in wide.columns}:
        wide = wide.withColumn("height_m", F.lit(default_height))
    w = aliased(wide, ["station_id", "lat", "lon", "height_m"], ["name", "elev_m"])
    w = w.withColumns({c: cdf.number(F.col(c)) for c in ("lat", "lon", "height_m", "elev_m")}).withColumns({"station_id": F.col("station_id").cast("string"), "name": F.coalesce(F.col("name").cast("string"), F.col("station_id").cast("string"))})
    w = w.dropna(subset=["station_id", "height_m", "lat", "lon"])
    long = _stacked(w, q, ["station_id", "height_m"]).select("station_id", "height_m", labels.quantile_number(F.col("_q")).alias("qnum"), "value")
    meta = w.groupBy("station_id", "height_m").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("name", "lat", "lon", "elev_m")])
    return long, meta


def to_wide(long: DataFrame, keys: list[str], value: str, qnum: str = "qnum", numbers: range = range(N_QUANTILES)) -> DataFrame:
    """Columns q000 to q100, the mean on duplicates. The values are given, so there's no pass to find them."""
    names = [f"q{i:03d}" for i in numbers]
    return long.groupBy(*keys).pivot(qnum, list(numbers)).agg(F.avg(value)).select(*keys, *[F.col(f"`{i}`").alias(n) for i, n in zip(numbers, names, strict=True)])


def to_arrays(long: DataFrame, keys: list[str], values: list[str], complete: bool = True, aux: list[str] = ()) -> DataFrame:
    """One row of each key with an array by qnum of each value; with complete, only keys of exactly 101 rows."""
    rows = long.groupBy(*keys).agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct("qnum", *[F.col(v).alias(v) for v in values]))).alias("_x"), *[F.first(a, ignorenulls=True).alias(a) for a in aux])
    if complete:
        rows = rows.where(F.col("_n") == N_QUANTILES)
    return rows.select(*keys, *[F.col(f"_x.{v}").alias(v) for v in values], *aux)


def arrays_to_long(rows: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """(keys, qnum, a column for each array)"""
    return rows.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("qnum", "_x")).select(*keys, "qnum", *[F.col(f"_x.{a}").alias(a) for a in arrays])


def dataset_columns(wide: DataFrame, datasets: list[str], dataset: Column) -> DataFrame:
    """Inference rows: wide tables of several models -> (lat, lon, elevation_m, height_m, qnum, a column for each model), the mean on duplicates."""
    require(wide, ["lat", "lon", "height_m", "elevation_m"])
    q = quantile_columns(wide)
    per = 10.0 if max(int(c[1:]) for c in q) > 100 else 1.0
    rows = wide.withColumn("_d", labels.dataset(dataset)).where(F.col("_d").isin(datasets))
    ids = ["lat", "lon", "elevation_m", "height_m", "_d"]
    long = _stacked(rows, q, ids).where("value is not null").withColumn("qnum", (F.substring("_q", 2, 4).cast("int") / per))
    return long.groupBy("lat", "lon", "elevation_m", "height_m", "qnum").pivot("_d", datasets).agg(F.avg("value"))


def predictions_wide(pred: DataFrame, sites: DataFrame, digits: int = 6) -> DataFrame:
    """(index, latitude, longitude, height_m, q000..q100) of long predictions, matched to sites on rounded coordinates; what matches no site is left out."""
    from galeframe.functions.geo import rounded
    from galeframe.operators.schema import whole_quantiles

    keyed = whole_quantiles(pred).withColumns({"_la": rounded(F.col("lat"), digits), "_lo": rounded(F.col("lon"), digits)}).where("height_m is not null")
    at = unique(sites.withColumns({"_la": rounded(F.col("latitude"), digits), "_lo": rounded(F.col("longitude"), digits)}).select("index", "latitude", "longitude", "_la", "_lo"), ["_la", "_lo"])
    return to_wide(keyed.join(at, ["_la", "_lo"]), ["index", "latitude", "longitude", "height_m"], "pred_observation")


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, which fails when it is run if a key occurs twice (many-to-one joins)."""
    from pyspark.sql.window import Window

    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("_n", F.when(n > 1, F.raise_error(F.lit(f"keys {keys} aren't unique"))).otherwise(n)).where("_n = 1").drop("_n")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by name; columns that a frame lacks are NULL there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def quantile_table(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A wide quantile table of raw samples."""
    block = samples.groupBy(*keys).agg(cdf.quantile_rows(F.col(value)).alias("_q"), F.count(cdf.finite(F.col(value))).alias("n"))
    return block.select(*keys, "n", *[F.get("_q", F.lit(i)).alias(c) for i, c in enumerate(QCOLS)])
