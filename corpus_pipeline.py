"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, mixing to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from galeframe.llm import decontaminate, jaccard, lines, mixing, quality
from galeframe.llm.common import read
from galeframe.llm.queries import WEIGHTS
from galeframe.llm.store import Work


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the trees go. The trees are fitted on labelled documents of this input."""
    return quality.keep(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and with them documents of which no line that holds a word is left."""
    return lines.dedup_lines(docs, drop_emptied=True).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their place in the mixture by the exact weights."""
    return mixing.mix(docs, WEIGHTS, keep_columns=True)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("source_mixing", source_mixing)]

#: The trees of the first stage can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result but the last is written to the shared folder and read again."""
    docs, work = read(spark, sf_dir, "documents"), Work(spark)
    for _, stage in STAGES[:-1]:
        docs = work.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
