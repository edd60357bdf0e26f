"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A batch handed to the text kernel holds about this many bytes of text, or a single longer text.
BATCH_BYTES = 6 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(id_col: str, text_col: str) -> Column:
    """Identity of a row: rows with equal id and equal text are one document, other rows never are."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def pieces(batch: pa.RecordBatch, text: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut so that each piece has a bounded number of text bytes, or one row."""
    col = batch.column(batch.schema.get_field_index(text))
    if not len(col):
        return
    size = pa.compute.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < len(col):
        done = size[at - 1] if at else 0
        to = max(at + 1, int(size.searchsorted(done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def by_pieces(f: Callable[[pa.RecordBatch], pa.RecordBatch], text: str) -> Callable:
    """For mapInArrow: applies f to pieces of bounded size."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, text):
                yield f(piece)

    return run
