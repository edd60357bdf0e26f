"""Tables as files: by extension, by name pattern, with a JSON header, and the sinks that can be resumed."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from galeframe.functions import cdf
from galeframe.functions.constants import QCOLS, TARGET_HEIGHTS
from galeframe.operators.reshape import union_all
from galeframe.operators.schema import choose, quantile_columns, with_columns

PER_HEIGHT = r"(hrrr|wtk|wtk_led)_quantiles_(\d+)m\.(?:csv|parquet|pq)$"


def fs_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = fs_path(spark, path)
    return fs.exists(p)


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Parquet for .parquet and .pq (and for folders without an extension), else CSV with a header. A CSV without a schema is read as text."""
    kind = re.search(r"\.(parquet|pq)/?$", path) or not re.search(r"\.[A-Za-z0-9]+(\.gz)?/?$", path)
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path) if kind else reader.option("header", True).csv(path)
    return df.select(*columns) if columns else df


def read_optional(spark: SparkSession, path: str | None, schema: str | None = None) -> DataFrame | None:
    """None where the file is missing; with a schema, an empty table."""
    if path and exists(spark, path):
        return read_table(spark, path, schema)
    return spark.createDataFrame([], schema) if schema else None


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if re.search(r"\.(parquet|pq)/?$", path):
        writer.parquet(path)
    else:
        writer.option("header", True).csv(path)


def list_files(spark: SparkSession, folder: str, pattern: str = r"\.(parquet|pq|csv)$") -> list[str]:
    p, fs = fs_path(spark, folder)
    return sorted(f.getPath().toString() for f in fs.listStatus(p) if re.search(pattern, f.getPath().getName())) if fs.exists(p) else []


def _csv_files(spark: SparkSession, files: list[str], columns: list[str], names: str) -> DataFrame:
    """(file, columns as text, NULL where a file lacks one) of CSV files whose headers differ, in one scan.

    A file's first line is its header; each line finds its columns' places in it. names: a pattern of further columns to
    take; which of them there are is found in the headers.
    """
    lines = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    heads = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("head"))
    heads = heads.withColumn("head", F.transform(F.split("head", ","), lambda x: F.trim(F.regexp_replace(x, '[\r"\ufeff]', ""))))
    known = heads.agg(F.max(F.size("head")).alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("head")))).alias("all")).first()  # the few names of all headers
    wanted = list(dict.fromkeys([*columns, *[c for c in known["all"] or [] if re.fullmatch(names, c)]]))
    place = F.array(*[F.array_position("head", c) for c in wanted])  # from 1; 0 for none
    of_file = heads.select(F.col("file").alias("_f"), F.array_join("head", ",").alias("_head"), place.alias("_place"))
    cells = F.from_csv(F.col("value"), ", ".join(f"c{k} string" for k in range(known["n"] or 1)))
    rows = lines.join(F.broadcast(of_file), F.col("file") == F.col("_f")).where((F.regexp_replace("value", '[\r"\ufeff ]', "") != F.regexp_replace("_head", " ", "")) & (F.trim("value") != ""))
    rows = rows.select("file", "_place", cells.alias("_c")).select("file", "_place", F.array(*[F.col(f"_c.c{k}") for k in range(known["n"] or 1)]).alias("_v"))
    return rows.select("file", *[F.when(F.get("_place", F.lit(k)) > 0, F.get("_v", F.get("_place", F.lit(k)).cast("int") - 1)).alias(c) for k, c in enumerate(wanted)])


def _parquet_files(spark: SparkSession, files: list[str], columns: list[str], names: str) -> DataFrame:
    """The same of Parquet files. Files whose columns have different types can't be scanned together: they are scanned by schema."""
    try:
        parts = [spark.read.option("mergeSchema", True).parquet(*files)]
    except Exception as e:
        if "MERGE" not in str(e):
            raise
        by_schema: dict[str, list[str]] = {}
        for f in files:
            by_schema.setdefault(spark.read.parquet(f).schema.json(), []).append(f)
        parts = [spark.read.parquet(*some) for some in by_schema.values()]
    wanted = list(dict.fromkeys([*columns, *[c for p in parts for c in p.columns if re.fullmatch(names, c)]]))
    return union_all([p.select(F.col("_metadata.file_path").alias("file"), *[(F.col(c) if c in p.columns else F.lit(None)).cast("string").alias(c) for c in wanted]) for p in parts])


def read_files(spark: SparkSession, files: list[str], columns: list[str], names: str = "(?!)") -> DataFrame:
    """(file, columns as text) of Parquet and CSV files with different columns, in a scan for each of both formats. names: a pattern of further columns to take."""
    parquet = [f for f in files if re.search(r"\.(parquet|pq)$", f)]
    rest = [f for f in files if f not in set(parquet)]
    return union_all([read(spark, some, columns, names) for read, some in ((_parquet_files, parquet), (_csv_files, rest)) if some])


def read_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Tile files of any of the formats: grid_id, lat, lon, height_m and all 101 quantiles, NULL where a file lacks one; rows without place go."""
    got = read_files(spark, list_files(spark, folder), ["grid_id", "lat", "lon", "height_m", *QCOLS])
    return got.select("grid_id", *[cdf.number(F.col(c)).alias(c) for c in ["lat", "lon", "height_m", *QCOLS]]).dropna(subset=["lat", "lon"])


def read_per_height(spark: SparkSession, folder: str) -> DataFrame:
    """Files named <model>_quantiles_<height>m: source and height from the name; a height_m in the file comes first. Quantile columns that a file lacks are NULL."""
    files = list_files(spark, folder, PER_HEIGHT)
    if not files:
        raise FileNotFoundError(f"no files like <model>_quantiles_<height>m in {folder}")
    got = read_files(spark, files, ["grid_id", "lat", "lon", "height_m"], r"q\d{3,4}")
    in_path = PER_HEIGHT.replace("$", "(?:/|$)")  # a table may be a folder of files
    told = F.coalesce(cdf.number(F.col("height_m")), F.regexp_extract("file", in_path, 2).cast("double"))
    numbers = {c: cdf.number(F.col(c)) for c in got.columns if c not in ("file", "grid_id", "height_m")}
    return got.withColumns({**numbers, "height_m": told, "source": F.regexp_extract("file", in_path, 1)}).drop("file")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """lat, lon, height_m and q000..q100; latitude and longitude are renamed, missing quantiles NULL."""
    df = read_table(spark, path)
    names = {choose(df, ["lat", "latitude"]): "lat", choose(df, ["lon", "longitude"]): "lon"}
    df = with_columns(df.withColumnsRenamed({k: v for k, v in names.items() if k}), QCOLS, "double")
    return df.withColumns({c: cdf.number(F.col(c)) for c in ["lat", "lon", "height_m", *QCOLS]})


def read_sites(spark: SparkSession, path: str, with_height: bool = False) -> DataFrame:
    """Site list: station_id, name, lat, lon (and height_m), one row each: the first by name and place."""
    from galeframe.operators.ordered import first_rows
    from galeframe.operators.schema import aliased

    need = ["station_id", "lat", "lon", *(["height_m"] if with_height else [])]
    df = aliased(read_table(spark, path), need, ["name"]).select(*need, "name")
    df = df.withColumns({c: cdf.number(F.col(c)) for c in need[1:]}).dropna(subset=need)
    return first_rows(df, ["station_id", *(["height_m"] if with_height else [])], F.col("name"), F.col("lat"), F.col("lon"))


def station_catalogue(spark: SparkSession, path: str, country: str = "US") -> DataFrame:
    """Stations of the country: station_id from two padded codes without sentinels, first and last year, distinct."""
    from galeframe.functions.labels import station_code, year_prefix

    df = spark.read.option("header", True).csv(path)
    df = df.where(F.col("CTRY") == country).withColumns({"u": F.lpad("USAF", 6, "0"), "w": F.lpad("WBAN", 5, "0")}).where("u <> '999999' and w <> '99999'")
    return df.select(station_code(F.col("u"), F.col("w")).alias("station_id"), F.col("STATION NAME").alias("name"), cdf.number(F.col("LAT")).alias("lat"), cdf.number(F.col("LON")).alias("lon"), cdf.number(F.col("ELEV(M)")).alias("elev_m"), year_prefix(F.col("BEGIN")).alias("begin_year"), year_prefix(F.col("END")).alias("end_year")).dropDuplicates(["station_id"])


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Raw station CSVs: DATE and WND of whatever columns and in whatever order they have, the station from the file name."""
    got = _csv_files(spark, [path], ["DATE", "WND"], "(?!)")
    return got.select(F.col("DATE").try_cast("timestamp").alias("DATE"), "WND", F.regexp_extract("file", r"([^/.]+)[^/]*$", 1).alias("station_id"))


def read_station_quantiles(spark: SparkSession, path: str, header_schema: str) -> DataFrame:
    """Files with a line '# {json}' above (quantile, wind_speed_m_s) rows: a struct header and an array of the rows, a row for each file."""
    text = spark.read.text(path, wholetext=True).withColumn("lines", F.split("value", "\r?\n"))
    body = F.filter(F.slice("lines", 3, 1 << 20), lambda x: F.trim(x) != "")
    pairs = F.transform(body, lambda x: F.struct(F.get(F.split(x, ","), F.lit(0)).try_cast("int").alias("q"), F.get(F.split(x, ","), F.lit(1)).try_cast("double").alias("v")))
    return text.select(F.from_json(F.regexp_replace(F.get("lines", F.lit(0)), r"^#\s*", ""), header_schema).alias("header"), pairs.alias("points"))


def station_rows(files: DataFrame) -> DataFrame:
    """Wide rows of read_station_quantiles(): 101 quantiles, gaps interpolated, edges carried on."""
    by = F.map_from_entries(F.transform(F.filter("points", lambda p: p["q"].isNotNull()), lambda p: F.struct(p["q"], p["v"])))
    full = files.withColumn("_m", by).withColumn("_q", cdf.interpolated(F.transform(F.sequence(F.lit(0), F.lit(100)), lambda i: cdf.finite(F.try_element_at(F.col("_m"), i)))))
    return full.select("header.*", *[F.get("_q", F.lit(i)).alias(c) for i, c in enumerate(QCOLS)])


def write_station_files(rows: DataFrame, path: str, header: list[str]) -> None:
    """One folder per station, each with a text file: the JSON header line, then the rows of its quantiles."""
    line = F.concat(F.lit("# "), F.to_json(F.struct(*header)))
    body = F.transform(F.array(*[F.col(c) for c in QCOLS]), lambda v, i: F.concat(i.cast("string"), F.lit(","), F.coalesce(v.cast("string"), F.lit(""))))
    text = rows.select("station_id", F.array_join(F.concat(F.array(line, F.lit("quantile,wind_speed_m_s")), body), "\n").alias("value"))
    text.write.partitionBy("station_id").text(path)


def append(df: DataFrame, path: str, done_keys: list[str] | None = None, partition_by: list[str] = ()) -> DataFrame:
    """Appends the rows whose keys aren't in the table yet, and returns them: safe to run again."""
    spark = df.sparkSession
    if done_keys and exists(spark, path):
        df = df.join(spark.read.parquet(path).select(*done_keys).distinct(), done_keys, "left_anti")
    df.write.mode("append").partitionBy(*partition_by).parquet(path)
    return df


def write_partitions(df: DataFrame, path: str, by: list[str], format: str = "parquet") -> None:
    """One folder for each value of `by` (tile, height); only the partitions in df are replaced."""
    writer = df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    (writer.parquet(path) if format == "parquet" else writer.option("header", True).csv(path))


def write_locations(profiles: DataFrame, path: str) -> None:
    """A gzipped CSV for each location (folder index=...): probability and the target heights, in order."""
    cols = ["probability", *[f"windspeed_{h}m" for h in TARGET_HEIGHTS]]
    profiles.select("index", *cols).repartition("index").sortWithinPartitions("index", "probability").write.partitionBy("index").option("header", True).option("compression", "gzip").csv(path)


def model_features(text: str) -> list[str] | None:
    """Feature names of a stored list, or of an object with a list of features."""
    try:
        got = json.loads(text)
    except ValueError:
        return None
    got = got.get("features") if isinstance(got, dict) else got
    return [str(x) for x in got] if isinstance(got, list) else None


def feature_table(spark: SparkSession, path: str) -> DataFrame:
    """Importance table; total_gain and total_cover are the mean times the splits where they are missing."""
    df = read_table(spark, path)
    for total, mean in (("total_gain", "gain"), ("total_cover", "cover")):
        have = cdf.number(F.col(total)) if total in df.columns else F.lit(None).cast("double")
        df = df.withColumn(total, F.coalesce(have, cdf.number(F.col(mean)) * cdf.number(F.col("weight")) if {mean, "weight"} <= set(df.columns) else have))
    return df


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """grid_id, lat, lon; without ids, six-digit numbers in order of latitude (from the north) and longitude."""
    from galeframe.operators.ordered import ranked
    from galeframe.operators.schema import aliased

    df = aliased(read_table(spark, path), ["lat", "lon"])
    df = df.withColumns({c: cdf.number(F.col(c)) for c in ("lat", "lon")}).dropna(subset=["lat", "lon"])
    if "grid_id" not in df.columns:
        df = ranked(df, "lat", "lon", descending=True, name="_i").withColumn("grid_id", F.lpad((F.col("_i") - 1).cast("string"), 6, "0"))
    return df.select(F.col("grid_id").cast("string").alias("grid_id"), "lat", "lon")


def yearly_paths(folder: str, pattern: str, years: list[int]) -> list[str]:
    """The pattern with each year for {year}."""
    return [f"{folder.rstrip('/')}/{pattern.format(year=y)}" for y in years]
