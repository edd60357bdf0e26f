"""Files with exact names: a line of text for each row, a file for each name.

Spark's own writers choose file names. Here a task writes its files to a place of its own attempt and moves them to
their names when all of them are whole, so a task that is killed leaves no half file, and its repetition leaves one. A
file is written by one task, line by line, in the order of the rows; tables that must not pass through one task stay
partitioned folders (tables.write_partitions).
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from galeframe.functions.constants import QCOLS, TARGET_HEIGHTS
from galeframe.sources.ranges import exists, system


@dataclass
class Written(WriterCommitMessage):
    files: int


class NamedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.root, self.header = options["path"].rstrip("/"), options.get("header")
        self.existing = options.get("existing", "replace" if overwrite else "error")
        self.staging = f"{self.root}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = system(self.root)
        task = TaskContext.get()
        own = f"{system(self.staging)[1]}/{f'{task.partitionId()}-{task.taskAttemptId()}' if task else uuid.uuid4().hex}"
        fs.create_dir(own, recursive=True)
        names: dict[str, bool] = {}
        now, out = None, None
        for batch in iterator:
            for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != now:
                    if out:
                        out.close()
                    if name in names:
                        raise ValueError(f"the rows of {name} aren't next to each other")
                    if self.existing == "error" and exists(f"{self.root}/{name}"):
                        raise FileExistsError(f"{self.root}/{name}")
                    raw = fs.open_output_stream(f"{own}/{name}", compression=None)
                    now, out = name, gzip.GzipFile(fileobj=raw, mode="wb", mtime=0, filename="") if name.endswith(".gz") else raw
                    if name.endswith(".gz"):
                        out.myfileobj = raw  # closed with the stream
                    names[name] = True
                    if self.header is not None:
                        out.write(f"{self.header}\n".encode())
                out.write(f"{line}\n".encode())
        if out:
            out.close()
        for name in names:
            if self.existing == "skip" and exists(f"{self.root}/{name}"):
                fs.delete_file(f"{own}/{name}")
            else:
                fs.move(f"{own}/{name}", f"{root}/{name}")
        return Written(len(names))

    def _clear(self) -> None:
        fs, staging = system(self.staging)
        if fs.get_file_info(staging).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(staging)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()


class NamedSource(DataSource):
    """df.select(name, line).write.format("named").option("path", folder).mode("append").save().

    Options: header (first line of each file), existing (error, replace or skip; replace for mode overwrite). A name
    that ends with .gz is compressed.
    """

    @classmethod
    def name(cls) -> str:
        return "named"

    def schema(self) -> str:
        return "name string, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return NamedWriter(dict(self.options), overwrite)


def write_named(df: DataFrame, path: str, name: Column, line: Column, order: list[Column], header: str | None = None, existing: str = "error") -> None:
    """A file for each value of name, with a line for each row in the order given."""
    df.sparkSession.dataSource.register(NamedSource)
    names = [f"_o{k}" for k in range(len(order))]
    rows = df.select(name.alias("name"), line.alias("line"), *[o.alias(n) for o, n in zip(order, names, strict=True)]).where("name is not null")
    rows = rows.repartition("name").sortWithinPartitions("name", *names).select("name", "line")
    writer = rows.write.format("named").option("path", path).option("existing", existing).mode("append")
    (writer.option("header", header) if header is not None else writer).save()


def csv_line(*columns: Column) -> Column:
    """Values joined by commas; a missing one is empty, and one with a comma, quote or line break is quoted."""
    told = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    quoted = [F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t) for t in told]
    return F.concat_ws(",", *quoted)


def export_stations(rows: DataFrame, path: str, header: list[str], existing: str = "skip") -> None:
    """<station_id>_quantiles.csv: a line '# {json}' of the header's columns, then quantile,wind_speed_m_s and the 101 quantiles. Stations that have a file keep it."""
    first = F.array(F.concat(F.lit("# "), F.to_json(F.struct(*header))), F.lit("quantile,wind_speed_m_s"))
    body = F.transform(F.array(*[F.col(c) for c in QCOLS]), lambda v, i: F.concat(i.cast("string"), F.lit(","), F.coalesce(v.cast("string"), F.lit(""))))
    lines = rows.select("station_id", F.posexplode(F.concat(first, body)).alias("k", "line"))
    write_named(lines, path, F.concat("station_id", F.lit("_quantiles.csv")), F.col("line"), [F.col("k")], existing=existing)


def export_locations(profiles: DataFrame, path: str, existing: str = "replace") -> None:
    """<index>.csv.gz: probability and the target heights, a row for each probability."""
    columns = ["probability", *[f"windspeed_{h}m" for h in TARGET_HEIGHTS]]
    write_named(profiles, path, F.concat("index", F.lit(".csv.gz")), csv_line(*[F.col(c) for c in columns]), [F.col("probability")], ",".join(columns), existing)


def export_heights(wide: DataFrame, path: str, prefix: str, columns: list[str], existing: str = "replace") -> None:
    """<prefix>_quantiles_<height>m.csv: one row of each grid_id, ordered by it."""
    height = F.bround("height_m", 0).cast("int")
    rows = wide.where(F.col("height_m").isNotNull()).dropDuplicates(["grid_id", "height_m"])
    write_named(rows, path, F.concat(F.lit(f"{prefix}_quantiles_"), height.cast("string"), F.lit("m.csv")), csv_line(*[F.col(c) for c in columns]), [F.col("grid_id")], ",".join(columns), existing)


def export_tiles(rows: DataFrame, path: str, tile: str, columns: list[str], order: list[str], existing: str = "skip") -> None:
    """tile_<id>.csv; tiles that have a file keep it."""
    write_named(rows, path, F.concat(F.lit("tile_"), F.col(tile).cast("string"), F.lit(".csv")), csv_line(*[F.col(c) for c in columns]), [F.col(c) for c in order], ",".join(columns), existing)


def read_named(spark: SparkSession, path: str) -> DataFrame:
    """(name, line, at): the lines of a folder's files, with the file's name and the line's number from 0."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    return text.select("name", F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("at", "line"))
