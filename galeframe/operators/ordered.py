"""Ranks, runs, top lists and samples. Global orders are built from ranges sized to the rows, so no task holds the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galeframe.operators.cut import cut


#: Rows that a range of a global order holds, about.
RANGE_ROWS = 1_000_000
#: Rows for which another core is worth a range of its own.
BUSY_ROWS = 20_000


def positions(df: DataFrame, order: list[Column], group: list[str] | None = None, name: str = "position", range_rows: int = RANGE_ROWS, write: Callable[[DataFrame], DataFrame] = cut, weight: str | None = None) -> DataFrame:
    """Each row's place, from 0, in the order given within its group (without groups, in the whole table). With a weight, the sum of the weights before the row.

    As many ranges as the rows need are cut from a sample of the order, each about range_rows long whatever the values:
    rows that are equal in all of the order are told apart by where they were read, so one value in half the table is
    many ranges. The ranges are sorted and written, so that a repeated task can't move a row; a row's place is its place
    in the range plus the rows of the ranges before, of which a small table of counts tells. NULL is a group and a value.
    """
    group = group or []
    n = df.count()
    ranges = max(1, -(-n // range_rows), min(df.sparkSession.sparkContext.defaultParallelism, n // BUSY_ROWS))
    keys = [*[F.col(g).asc_nulls_first() for g in group], *order, F.col("_read").asc()]
    told = df.withColumn("_read", F.monotonically_increasing_id())
    laid = write(told.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("_read").withColumn("_at", F.monotonically_increasing_id()))
    laid = laid.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    if weight:
        before_row = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        laid = laid.withColumn("_at", F.coalesce(F.sum(weight).over(before_row), F.lit(0)))
    counted = laid.groupBy("_range").agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    before = counted.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row for each range
    placed = laid.join(F.broadcast(before), "_range").withColumn(name, F.col("_at") + F.col("_before")).drop("_range", "_at", "_before")
    if not group:
        return placed
    first = placed.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(F.min(name).alias("_first"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return placed.join(first, same).withColumn(name, F.col(name) - F.col("_first")).drop("_first", *[f"_g_{g}" for g in group])


def ranked(df: DataFrame, value: str, *ties: str, descending: bool = False, name: str = "rank", range_rows: int = RANGE_ROWS) -> DataFrame:
    """A global row number by value, then ties; NULLs last."""
    v = F.col(value).cast("double")
    key = F.coalesce(-v if descending else v, F.lit(float("inf")))
    return positions(df, [key.asc(), *[F.col(t).asc() for t in ties]], name=name, range_rows=range_rows).withColumn(name, F.col(name) + 1)


def cumulative_share(df: DataFrame, value: str, *ties: str) -> DataFrame:
    """share = (rank - 0.5) / rows, of the value in ascending order."""
    total = df.agg(F.count("*").alias("_total"))
    return ranked(df, value, *ties).crossJoin(F.broadcast(total)).withColumn("share", (F.col("rank") - 0.5) / F.col("_total")).drop("_total")


def dense(df: DataFrame, value: str, name: str, descending: bool = False, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rank of each row's value among the distinct values, from 0; NULLs last. The distinct values are ranked, and their ranks joined."""
    v = F.col(value)
    order = v.desc_nulls_last() if descending else v.asc_nulls_last()
    ranks = positions(df.select(value).distinct(), [order], name=name, range_rows=range_rows).withColumnRenamed(value, "_value")
    return df.join(ranks, v.eqNullSafe(F.col("_value"))).drop("_value")


def dense_axes(points: DataFrame, digits: int = 6, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """grid_id LLLPPP of each point, rows kept: latitudes counted from the north, longitudes from the west."""
    from galeframe.functions.geo import rounded

    rows = points.withColumns({"_la": rounded(F.col(lat), digits), "_lo": rounded(F.col(lon), digits)})
    code = lambda c: F.when(F.col(c) < 1000, F.lpad(F.col(c).cast("string"), 3, "0")).otherwise(F.col(c).cast("string"))
    placed = dense(dense(rows, "_la", "_i", descending=True), "_lo", "_j")
    return placed.withColumn("grid_id", F.concat(code("_i"), code("_j"))).drop("_la", "_lo", "_i", "_j")


def shares(df: DataFrame, value: str, *ties: str) -> DataFrame:
    """value's dense rank (largest first), its position with ties told apart, and its share of the total."""
    total = df.agg(F.sum(value).alias("_total"))
    placed = positions(df, [F.desc(value), *[F.col(t).asc() for t in ties]]).withColumn("position", F.col("position") + 1)
    placed = dense(placed, value, "dense", descending=True).withColumn("dense", F.col("dense") + 1)
    return placed.crossJoin(F.broadcast(total)).withColumn("share", F.try_divide(F.col(value), F.col("_total"))).drop("_total")


def runs(df: DataFrame, value: str, span: int = 1 << 20) -> DataFrame:
    """Contiguous runs of the distinct whole numbers: start and end (exclusive). Found within spans and then joined over their borders."""
    x = df.select(F.col(value).cast("long").alias("x")).where("x is not null").distinct().withColumn("b", F.floor(F.col("x") / span))
    w = Window.partitionBy("b").orderBy("x")
    local = x.withColumn("g", F.col("x") - F.row_number().over(w)).groupBy("b", "g").agg(F.min("x").alias("start"), (F.max("x") + 1).alias("end"))
    touches = (F.pmod(F.col("start"), F.lit(span)) == 0) | (F.pmod(F.col("end"), F.lit(span)) == 0)
    inner, edge = local.where(~touches).select("start", "end"), local.where(touches).select("start", "end")
    w = Window.orderBy("start")  # two runs of a span at most
    linked = edge.withColumn("new", (F.coalesce(F.lag("end").over(w), F.lit(None)).eqNullSafe(F.col("start"))).cast("int"))
    joined = linked.withColumn("g", F.sum(1 - F.col("new")).over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("g").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return inner.unionByName(joined.select("start", "end"))


def top(df: DataFrame, by: str, n: int, *ties: str, descending: bool = True) -> DataFrame:
    order = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
    return df.orderBy(order, *ties).limit(n)


def top_and_bottom(df: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    """The n best and n worst rows with their end: 'low' or 'high'. A row may be in both."""
    return top(df, by, n, *ties, descending=False).withColumn("end", F.lit("low")).unionByName(top(df, by, n, *ties).withColumn("end", F.lit("high")))


def union_of_tops(df: DataFrame, columns: list[str], n: int, key: str) -> DataFrame:
    """Rows that are among the n largest of any of the columns, once."""
    keys = None
    for c in columns:
        one = top(df, c, n, key).select(key)
        keys = one if keys is None else keys.unionByName(one)
    return df.join(keys.distinct(), key, "left_semi")


def sample_rows(df: DataFrame, n: int, *key: str, seed: int = 42) -> DataFrame:
    """n rows, chosen and ordered by a hash of the key and the seed: the same ones every time."""
    return df.orderBy(F.sha1(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))).cast("binary")), *key).limit(n)


def balanced(df: DataFrame, cls: str, *key: str, strategy: str = "downsample", seed: int = 42, range_rows: int = RANGE_ROWS) -> DataFrame:
    """As many rows of each class: a hash-ordered part of the larger (downsample), or the smaller repeated (upsample)."""
    if strategy not in ("downsample", "upsample"):
        raise ValueError(f"unknown strategy {strategy!r}")
    sizes = df.groupBy(cls).agg(F.count("*").alias("_n"))
    goal = sizes.agg((F.min if strategy == "downsample" else F.max)("_n").alias("_goal"))
    order = F.sha1(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))).cast("binary"))
    placed = positions(df.withColumn("_h", order), [F.col("_h").asc(), *[F.col(k).asc() for k in key]], [cls], "_r", range_rows)
    placed = placed.join(F.broadcast(sizes.withColumnRenamed(cls, "_class_of")), F.col(cls).eqNullSafe(F.col("_class_of"))).drop("_class_of").crossJoin(F.broadcast(goal))  # a row for each class
    if strategy == "downsample":
        out = placed.where("_r < _goal")
    else:
        out = placed.withColumn("_", F.explode(F.sequence(F.lit(0), F.expr("_goal div _n + if(_r < _goal % _n, 1, 0) - 1")))).drop("_")
    return out.drop("_h", "_r", "_n", "_goal")


def first_rows(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key: the first by the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def not_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Restart filter: what isn't done yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")
