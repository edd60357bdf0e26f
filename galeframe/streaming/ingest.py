"""Incremental ingestion: station reports as they arrive, windowed statistics, resumable by checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from galeframe.operators.observations import station_reports


def reports(spark: SparkSession, path: str, schema: str = "station_id string, DATE timestamp, WND string") -> DataFrame:
    """CSV files of reports as they appear in a folder."""
    return spark.readStream.schema(schema).option("header", True).csv(path)


def speeds(stream: DataFrame, late: str = "2 days", seed: int = 0) -> DataFrame:
    """Speeds of the reports, each station and time once, as long as they come within the allowed lateness."""
    once = stream.withWatermark("DATE", late).dropDuplicatesWithinWatermark(["station_id", "DATE"])
    return station_reports(once, seed=seed)


def windowed(stream: DataFrame, time: str, value: str, keys: list[str], length: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """n, mean, least and largest value of each key and event-time window."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    g = stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "mean", "low", "high")


def append_once(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Takes in all files there are and stops; run again, it goes on where it stopped. The file sink writes each batch once."""
    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).option("path", table).format("parquet").outputMode("append").start()


def transform_in_batches(stream: DataFrame, transform, table: str, checkpoint: str) -> StreamingQuery:
    """A batch transformation over a stream of files: each batch replaces its own partition, so a repeated batch does no harm."""

    def put(batch: DataFrame, number: int) -> None:
        transform(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(put).start()
