"""Exact quantiles of groups of any size: nothing of a large group is ever held in one task.

The aggregate in functions.cdf keeps a group's distinct values in one task, which fits stations. Here only the order
statistics that a quantile needs are looked for. Large groups are cut in bins of equal width, whose rows are counted, and
only the bins that hold an asked place are looked into again; rows don't move before few of them are left. What has become
small is ranked group by group. Groups that are too many to be cut in bins, or whose bins don't get smaller, are ordered
in ranges of the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galeframe.functions import cdf
from galeframe.functions.constants import N_QUANTILES
from galeframe.operators.cut import Scratch
from galeframe.operators.ordered import RANGE_ROWS, positions

#: Blocks that a group's places are cut in, to find the asked ones; one value covers so many at most.
BLOCKS = 2000
#: Bins of all groups together, that a task counts.
MOST_BINS = 1 << 20
#: Places of all groups together up to which groups and bins are broadcast.
MOST_PLACES = 200_000
#: Values are counted before all else if they are met so many times on average, by those of one in PART of the hashes.
MANY_TIMES, PART = 4, 64
#: How often the rows of a bin are cut in bins again.
MOST_ROUNDS = 4


def ranked_quantiles(samples: DataFrame, keys: list[str], value: str, n: int = N_QUANTILES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(keys, qnum, value) of n evenly spaced quantiles with linear interpolation; groups without a finite value are missing."""
    return ranked_percentiles(samples, keys, value, [k / (n - 1) for k in range(n)], range_rows, "qnum")


def ranked_percentiles(samples: DataFrame, keys: list[str], value: str, probabilities: list[float], range_rows: int = RANGE_ROWS, name: str = "k") -> DataFrame:
    """(keys, k, value) for the k-th of the probabilities, counted from 0 in a column of the given name. Without keys the whole table is one group."""
    return _percentiles(samples, keys, value, probabilities, range_rows, name)[0]


def _percentiles(samples: DataFrame, keys: list[str], value: str, probabilities: list[float], range_rows: int, name: str) -> tuple[DataFrame, DataFrame]:
    """What ranked_percentiles() gives, and all groups."""
    work = Scratch(samples.sparkSession)
    rows = samples.select(*keys, (cdf.finite(F.col(value)) + 0.0).alias("_v"))  # + 0.0 makes one of both zeros
    part = rows.where(f"pmod(xxhash64(_v), {PART}) = 0 and _v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    seen, different = part.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count("*")).first()
    counts = F.count("*").alias("_n")
    x = work.write(rows.groupBy(*keys, "_v").agg(counts) if seen >= MANY_TIMES * different > 0 else rows.withColumn("_n", F.lit(1).cast("long")))  # read three times
    every = work.write(x.groupBy(*keys).agg(*_size()))
    sizes = every.where("_n > 0")
    # The quantile of probability p lies at (n - 1) p: between the values at its floor and its ceiling.
    asked = sizes.select(*keys, "_n", F.posexplode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("_k", "_p")).withColumn("_at", (F.col("_n") - 1) * F.col("_p"))
    sides = F.array(F.struct(F.floor("_at").alias("at"), F.lit(0).alias("side")), F.struct(F.ceil("_at").alias("at"), F.lit(1).alias("side")))
    asked = asked.select(*keys, "_k", (F.col("_at") - F.floor("_at")).alias("_f"), F.inline(sides).alias("_ask", "_side"))
    found = _picked(x, keys, sizes, asked.select(*keys, F.col("_ask").alias("_place"), "_ask").distinct(), range_rows, work)
    met = _met(asked, found, [*keys, "_ask"])
    low, high = (F.max(F.when(F.col("_side") == i, F.col("_v"))) for i in (0, 1))
    out = met.groupBy(*keys, "_k").agg(low.alias("_lo"), high.alias("_hi"), F.max("_f").alias("_f"))
    return out.select(*keys, F.col("_k").alias(name), (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("value")), every.select(*keys)


def _size() -> tuple[Column, ...]:
    """What is to be known of a group or a bin."""
    n = F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))), F.lit(0))
    return n.alias("_n"), F.count("_v").alias("_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high")


def _met(rows: DataFrame, other: DataFrame, keys: list[str], small: bool = False, how: str = "inner") -> DataFrame:
    """Rows joined to others by the keys, of which NULL is one. small: the others are broadcast."""
    other = other.withColumnsRenamed({k: f"_m_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_m_{k}"))
    return rows.join(F.broadcast(other) if small else other, same, how).drop(*[f"_m_{k}" for k in keys])


def _last_before(starts: DataFrame, asked: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """asked with the values of the group's last row whose _start isn't beyond the _place. All rows of a group are in one task."""
    a = starts.select(*keys, F.col("_start").alias("_place"), F.lit(None).cast("long").alias("_ask"), F.struct("_start", *values).alias("_s"))
    rows = a.unionByName(asked.select(*keys, "_place", "_ask"), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_place", F.col("_ask").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_s", F.last("_s", ignorenulls=True).over(w)).where("_ask is not null").select(*keys, "_place", "_ask", "_s.*")


def _starts(counted: DataFrame, keys: list[str], order: str) -> DataFrame:
    """counted with _start, the rows of the group before. All rows of a group are in one task."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("_start", F.coalesce(F.sum("_n").over(w), F.lit(0)))


def _picked(x: DataFrame, keys: list[str], sizes: DataFrame, asked: DataFrame, range_rows: int, work: Scratch, rounds: int = 0) -> DataFrame:
    """(keys, _ask, _v): the value at each asked _place, from 0, of its group. x is a written table (keys, _v, _n: how many) that may be dropped, asked has (keys, _place, _ask), sizes a row for each group."""
    groups, largest = sizes.agg(F.count("*"), F.max("_rows")).first()
    if groups and largest > range_rows // 10 and rounds < MOST_ROUNDS and asked.count() <= MOST_PLACES:
        return _binned(x, keys, sizes, asked, max(16, MOST_BINS // groups), range_rows, work, rounds)
    counted = x.where("_v is not null").groupBy(*keys, "_v").agg(F.sum("_n").alias("_n"))
    if not groups or largest <= range_rows:
        return _last_before(_starts(counted, keys, "_v"), asked, keys, ["_v"]).select(*keys, "_ask", "_v")
    rows = positions(work.write(counted), [F.col("_v").asc()], keys, "_start", range_rows, weight="_n").withColumn("_end", F.col("_start") + F.col("_n"))
    width = sizes.select(*keys, F.expr(f"greatest(1, _n div {BLOCKS})").alias("_width"))  # values and places meet by blocks of places
    rows = _met(rows, width, keys).withColumn("_block", F.explode(F.expr("sequence(_start div _width, (_end - 1) div _width)"))).drop("_width")
    wanted = _met(asked, width, keys).select(*keys, F.expr("_place div _width").alias("_block"), "_place", "_ask")
    return _met(rows, wanted, [*keys, "_block"]).where("_place >= _start and _place < _end").select(*keys, "_ask", "_v")


def _binned(x: DataFrame, keys: list[str], sizes: DataFrame, asked: DataFrame, bins: int, range_rows: int, work: Scratch, rounds: int) -> DataFrame:
    """What _picked() gives, from the bins of the groups that hold an asked place. A bin of one value is known without its rows."""
    order = Window.orderBy(*keys) if keys else Window.orderBy(F.lit(0))
    sizes = work.write(sizes.withColumn("_group", F.row_number().over(order).cast("long")))  # MOST_PLACES rows at most
    group = F.expr(f"_bin div {bins}")
    wide = F.col("_high") * 0.5 - F.col("_low") * 0.5  # halves, so that no difference is infinite
    share = (F.col("_v") * 0.5 - F.col("_low") * 0.5) / wide
    number = F.when(wide > 0, F.least(F.floor(share * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    placed = _met(x.where("_v is not null"), sizes.drop("_n", "_rows"), keys, small=True).select((F.col("_group") * bins + number).alias("_bin"), "_v", "_n")
    counted = work.write(placed.groupBy("_bin").agg(*_size()))
    starts = _starts(counted.withColumn("_group", group), ["_group"], "_bin")
    met = work.write(_last_before(starts, _met(asked, sizes.select(*keys, "_group"), keys, small=True), ["_group"], ["_bin", "_n", "_rows", "_low", "_high"]))
    known = met.where("_low = _high").select("_group", "_ask", F.col("_low").alias("_v"))
    inside = met.where("_low < _high")
    hit = inside.select("_bin", "_n", "_rows", "_low", "_high").distinct()
    rest = work.write(_met(placed, hit.select("_bin"), ["_bin"], small=True, how="left_semi"))
    work.drop(x, counted)
    places = inside.select("_bin", (F.col("_place") - F.col("_start")).alias("_place"), "_ask")
    deeper = _picked(rest, ["_bin"], hit, places, range_rows, work, rounds + 1).select(group.alias("_group"), "_ask", "_v")
    return _met(known.unionByName(deeper), sizes.select("_group", *keys), ["_group"], small=True).select(*keys, "_ask", "_v")


def blocks(samples: DataFrame, keys: list[str], value: str, name: str = "quantiles", n: int = N_QUANTILES) -> DataFrame:
    """(keys, array of n exact quantiles) of groups of any size; NULL for a group without a finite value."""
    rows, groups = _percentiles(samples, keys, value, [k / (n - 1) for k in range(n)], RANGE_ROWS, "qnum")
    found = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("qnum", "value"))).alias("_q"))
    return _met(groups, found, keys, how="left").select(*keys, F.col("_q.value").alias(name))


def medians(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, columns): the median of each column's finite values in each group; groups without one in any column are missing."""
    each = F.array(*[F.struct(F.lit(c).alias("c"), cdf.finite(F.col(c)).alias("v")) for c in columns])
    rows = df.select(*keys, F.inline(each).alias("_c", "_x"))
    found = ranked_percentiles(rows, [*keys, "_c"], "_x", [0.5])
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_c") == c, F.col("value"))).alias(c) for c in columns])
