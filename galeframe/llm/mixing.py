"""Operator 1, mixing sources to target weights: Pfair scheduling of source blocks, with DataFrame operations only.

Documents of a source are put in a fixed order (by the MD5 of their id) and cut into blocks. Time is slots, one block a
slot. Weights become whole numbers by their common denominator, so that the target shares hold exactly. At virtual time
v source i with b_i blocks has had its fluid share min(b_i, w_i v), and the slot of v is the sum of these shares. Block j
is released at the slot of j / w_i (rounded down) and due by that of (j + 1) / w_i (rounded up), both by integer
arithmetic; among released blocks the earliest deadline goes first. The fluid shares fit the slots, so every block is
placed in its window, and at any time each source is less than one block off its target share, for any number of
sources. A source that runs out leaves; the others keep their proportions. Nothing is dropped or repeated.

Shares are whole at whole v, so the stretches between (periods) are scheduled independently. Blocks with equal weight and
number have the same window and are placed together, sources in the order of their MD5: the fold of a period takes as
many steps as it has different windows, however many sources there are. Ranks, of documents in a source and of sources in
a window, come from ranges of the MD5 and ranges of these, so that no task holds more than a range.

Defined results: a null source is the source ''; a null id is the id ''; rows with equal id and source are ordered
arbitrarily among themselves; sources without a given weight get the default weight; an empty table gives no rows.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galeframe.llm.store import Work

#: Rows of one rank range, about.
RANGE_ROWS = 2000

#: The fluid share of all sources at the virtual time j / w of a period, as whole blocks and w-ths of a block; k: weight, total and windows of each weight.
_SHARE = """
aggregate(k, named_struct('whole', 0L, 'part', cast(0 as decimal(38, 0))), (s, z) -> if(cast(z.w as decimal(19, 0)) * cast({j} as decimal(19, 0)) div {w} >= size(z.a),
    named_struct('whole', s.whole + z.total, 'part', s.part),
    named_struct('whole', s.whole + z.a[cast(cast(z.w as decimal(19, 0)) * cast({j} as decimal(19, 0)) div {w} as int)].before, 'part', cast(s.part
      + cast(cast(z.w as decimal(19, 0)) * cast({j} as decimal(19, 0)) % {w} as decimal(19, 0)) * cast(z.a[cast(cast(z.w as decimal(19, 0)) * cast({j} as decimal(19, 0)) div {w} as int)].c as decimal(19, 0)) as decimal(38, 0)))),
  s -> s.whole + (s.part + {up}) div cast({w} as decimal(38, 0)))"""

#: The windows of a period by release.
_WINDOWS = f"""
array_sort(flatten(transform(k, x -> transform(x.a, y -> named_struct('r', {_SHARE.format(j="y.j", w="x.w", up="0")}, 'd', {_SHARE.format(j="(y.j + 1)", w="x.w", up="x.w - 1")}, 'w', x.w, 'j', y.j, 'c', y.c)))))"""

#: Earliest deadline first over the windows g of one period: runs of n slots from slot `at`, for the blocks of a window from the one numbered `off` on.
_RUNS = """
aggregate(sequence(1, 3 * size(g)), named_struct('t', 0L, 'next', 0, 'ready', cast(array() as array<struct<d: bigint, w: bigint, j: bigint, r: bigint, off: bigint, left: bigint>>),
    'out', cast(array() as array<struct<w: bigint, j: bigint, r: bigint, d: bigint, off: bigint, at: bigint, n: bigint>>)),
  (s, _) -> if(s.next < size(g) and g[least(s.next, size(g) - 1)].r <= s.t,
    named_struct('t', s.t, 'next', s.next + 1, 'ready', array_append(s.ready, transform(array(g[least(s.next, size(g) - 1)]), x -> named_struct('d', x.d, 'w', x.w, 'j', x.j, 'r', x.r, 'off', 0L, 'left', x.c))[0]), 'out', s.out),
    if(size(s.ready) = 0, s, transform(array(array_min(s.ready)), f -> transform(array(if(s.next < size(g), least(f.left, g[least(s.next, size(g) - 1)].r - s.t), f.left)), n ->
      named_struct('t', s.t + n, 'next', s.next,
        'ready', filter(transform(s.ready, x -> if(x = f, named_struct('d', x.d, 'w', x.w, 'j', x.j, 'r', x.r, 'off', x.off + n, 'left', x.left - n), x)), x -> x.left > 0),
        'out', array_append(s.out, named_struct('w', f.w, 'j', f.j, 'r', f.r, 'd', f.d, 'off', f.off, 'at', s.t, 'n', n))))[0])[0])),
  s -> s.out)"""


def whole_weights(weights: dict[str, float], default_weight: float) -> tuple[dict[str, int], int]:
    """The weights in the same proportions as whole numbers; a float counts as the decimal number that it is written as."""
    w = {s: Fraction(str(x)) for s, x in weights.items()}
    every = [*w.values(), Fraction(str(default_weight))]
    unit = Fraction(math.gcd(*(x.numerator for x in every)), math.lcm(*(x.denominator for x in every)))
    if max(every) / unit >= 10**18:
        raise ValueError("as whole numbers, weights have 18 digits at most")
    return {s: int(x / unit) for s, x in w.items()}, int(every[-1] / unit)


def _digits(rows: int) -> int:
    """Hexadecimal digits that cut so many rows into ranges of about RANGE_ROWS."""
    return max(0, math.ceil(math.log(max(1, rows / RANGE_ROWS), 16)))


def _before(counts: DataFrame, keys: list[str]) -> DataFrame:
    """counts (keys, _range, n) -> keys, _range, _before: the rows of a key in earlier ranges. Sums over coarse ranges come first, so that a window holds no more than the square root of all ranges."""
    coarse = counts.withColumn("_coarse", F.expr("substring(_range, 1, (length(_range) + 1) div 2)"))
    far = coarse.groupBy(*keys, "_coarse").agg(F.sum("n").alias("m")).withColumn("_far", F.sum("m").over(Window.partitionBy(*keys).orderBy("_coarse")) - F.col("m")).drop("m")
    near = coarse.withColumn("_near", F.sum("n").over(Window.partitionBy(*keys, "_coarse").orderBy("_range")) - F.col("n"))
    return near.join(far, [*keys, "_coarse"]).select(*keys, "_range", (F.col("_near") + F.col("_far")).alias("_before"))


def block_slots(sizes: DataFrame, weights: dict[str, float], default_weight: float, block_rows: int, work: Work) -> DataFrame:
    """sizes (source, n) -> _s, _b (source and its block), slot, release and deadline, a row for each block."""
    given, default = whole_weights(weights, default_weight)
    w = F.lit(default).cast("long")
    if given:
        w = F.coalesce(F.try_element_at(F.create_map(*[x for s, n in given.items() for x in (F.lit(s), F.lit(n).cast("long"))]), F.col("source")), w)
    sizes = work.write(sizes)
    blocks = sizes.select(F.col("source").alias("_s"), w.alias("w"), F.md5(F.col("source").cast("binary")).alias("_md5"), F.expr(f"(n - 1) div {block_rows}").alias("_last"))
    # Numbered in two steps, as a source may have more blocks than one array should hold.
    blocks = blocks.withColumn("_many", F.explode(F.expr("sequence(0L, _last div 4096)"))).withColumn("_b", F.explode(F.expr("sequence(4096 * _many, least(_last, 4096 * _many + 4095))"))).drop("_last", "_many")
    # The place of a block among those of the same window: rows of earlier ranges, and its rank in its range.
    blocks = blocks.withColumn("_range", F.substring("_md5", 1, _digits(sizes.count())))
    ranges = blocks.groupBy("w", "_b", "_range").agg(F.count("*").alias("n"))
    blocks = blocks.withColumn("q", F.row_number().over(Window.partitionBy("w", "_b", "_range").orderBy("_md5", "_s")) - 1)
    blocks = blocks.join(_before(ranges, ["w", "_b"]), ["w", "_b", "_range"]).withColumn("q", F.col("q") + F.col("_before"))
    same = ranges.groupBy("w", "_b").agg(F.sum("n").alias("c")).select("w", F.expr("_b div w").alias("period"), F.expr("_b % w").alias("j"), "c")
    same = same.withColumn("before", F.sum("c").over(Window.partitionBy("period", "w").orderBy("j")) - F.col("c"))
    each = same.groupBy("period", "w").agg(F.sum("c").alias("total"), F.array_sort(F.collect_list(F.struct("j", "c", "before"))).alias("a"))
    periods = work.write(each.groupBy("period").agg(F.sum("total").alias("h"), F.array_sort(F.collect_list(F.struct("w", "total", "a"))).alias("k")))
    # First slots of periods: sums over ranges of periods, then within a range.
    h = periods.select("period", "h", F.expr("period div 1000").alias("range"))
    spans = h.groupBy("range").agg(F.sum("h").alias("n")).select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("first"))
    first = h.join(spans, "range").select("period", (F.col("first") + F.sum("h").over(Window.partitionBy("range").orderBy("period")) - F.col("h")).alias("first"))
    runs = periods.select("period", F.expr(_WINDOWS).alias("g")).select("period", F.explode(F.expr(_RUNS)).alias("x")).join(first, "period")
    runs = runs.select("first", F.col("x.w").alias("w"), F.expr("period * x.w + x.j").alias("_b"), "x.r", "x.d", "x.off", "x.at", "x.n")
    placed = blocks.join(runs, ["w", "_b"]).where("q >= off and q < off + n")
    return work.write(placed.select("_s", "_b", F.expr("first + at + q - off").alias("slot"), F.expr("first + r").alias("release"), F.expr("first + d").alias("deadline")))


def source_of(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, block_rows: int = 64, id_col: str = "doc_id", source_col: str = "source", keep_columns: bool = False) -> DataFrame:
    """id, source, block (of the source), slot, release, deadline and in_block, a row for each row of docs; with keep_columns all columns of docs and mix_slot, mix_in_block. Reading by (slot, in_block) gives the mixture."""
    if block_rows < 1 or default_weight <= 0 or any(w <= 0 for w in (weights or {}).values()):
        raise ValueError("block_rows and weights are positive")
    carried = [F.col(c) for c in docs.columns] if keep_columns else [F.col(id_col)]
    md5 = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    digits = _digits(docs.count())
    rows = docs.select(F.struct(*carried).alias("_row"), source_of(source_col).alias("_source"), md5.alias("_md5")).withColumn("_range", F.substring("_md5", 1, digits))
    ranges = docs.select(source_of(source_col).alias("_source"), F.substring(md5, 1, digits).alias("_range")).groupBy("_source", "_range").agg(F.count("*").alias("n"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_source", "_range").orderBy("_md5", f"_row.`{id_col}`")) - 1)
    placed = ranked.join(_before(ranges, ["_source"]), ["_source", "_range"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    placed, in_block = placed.withColumn("_block", F.expr(f"_rank div {block_rows}")), F.expr(f"_rank % {block_rows}")
    sizes = ranges.groupBy(F.col("_source").alias("source")).agg(F.sum("n").alias("n"))
    slots = block_slots(sizes, weights or {}, default_weight, block_rows, Work(docs.sparkSession))
    placed = placed.join(slots, (F.col("_source") == F.col("_s")) & (F.col("_block") == F.col("_b")))
    if keep_columns:
        return placed.select("_row.*", F.col("slot").alias("mix_slot"), in_block.alias("mix_in_block"))
    return placed.select(f"_row.`{id_col}`", F.col("_source").alias("source"), F.col("_block").alias("block"), "slot", "release", "deadline", in_block.alias("in_block"))
