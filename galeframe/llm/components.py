"""Connected components by alternating large-star and small-star steps, every step a join and a partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.store import Work


def components(edges: DataFrame, work: Work) -> DataFrame:
    """edges (a long, b long) -> (node, root), root being the smallest node that node is connected with. Nodes without an edge to another node are missing."""

    def stats(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def dealt_anew(low: DataFrame) -> DataFrame:
        # As a new expression the key isn't known to be partitioned. So the join deals both sides anew, instead of taking
        # over the aggregate's partitions, and can split the edges of a large star over tasks.
        return low.select(F.col("a").bitwiseXOR(F.lit(0).cast("long")).alias("a"), "m")

    star = work.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = stats(star)
    while True:
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(dealt_anew(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(dealt_anew(lowest), "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()
        new = work.write(small)
        work.drop(star)
        after = stats(new)
        if after == before:
            return new.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(new.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        star, before = new, after
