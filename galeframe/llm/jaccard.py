"""Operator 6, n-gram Jaccard join: MinHash banding, verified on full n-gram sets, with DataFrame operations only.

1. Each document's words are hashed, and n of these hashes to an n-gram. The distinct n-grams are exploded; one partial
   aggregation takes all minima, and sums that tell equal sets. Bands are hashes of `rows` minima. Documents with equal
   sets form one class; all that follows works on classes.
2. Classes meet in the buckets of their band hashes. Buckets with one class go, and so do those with the same classes as
   a bucket of an earlier band.
3. In each bucket all pairs of classes are verified on their full n-gram sets. The members of a bucket stand in one row,
   a large bucket's in rows of two slots each, so that no row exceeds a bound and no pair is ever a row: a row returns
   its members' number of links and local roots. A pair counts in the first bucket that it shares, so in one only.
4. Components of the links are the near-duplicate groups.

Band and row counts follow from the threshold and the target recall. A bucket of m sets costs m x m comparisons, over as
many tasks as it has pairs of slots. Defined results: a document of fewer words than n has one n-gram, all its words; one
without words (null, empty) is never linked. Rows with equal id and equal text are one document and get equal results.
Equal sets count as similarity 1 but not as a link: n_links counts other sets. N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import row_key
from galeframe.llm.components import components
from galeframe.llm.store import Work

#: Classes and n-grams of one slot of a bucket, about; a row has two slots at most.
SLOT_CLASSES, SLOT_GRAMS = 256, 1 << 17
#: An aggregation of more columns than about 100 isn't compiled; more minima are taken in several rounds.
MOST_MINIMA = 80


def bands_for(threshold: float, recall: float, rows: int = 5) -> int:
    """The fewest bands of so many rows that find a pair at the threshold with the target recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def with_shingles(df: DataFrame, text: str, n: int) -> DataFrame:
    """df with the distinct n-gram hashes of a text as column s. The word hashes h are used more than once, so Spark computes them first, in a projection of their own."""
    words = rf"array_remove(split({text}, '[\\x20\\x09-\\x0D]+'), '')"
    gram = "xxhash64(" + ", ".join(f"h[i + {k}]" for k in range(n)) + ")"
    grams = f"if(size(h) >= {n}, transform(sequence(0, greatest(0, size(h) - {n})), i -> {gram}), if(size(h) > 0, array(xxhash64(size(h), h)), cast(array() as array<bigint>)))"
    hashed = df.select("*", F.expr(f"transform({words}, w -> xxhash64(w))").alias("h"))
    return hashed.select(*df.columns, F.array_distinct(F.expr(grams)).alias("s"))


def _signed(base: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """base (_id, _key, _text) -> _id, _key, s1, s2 (hashes of the set), n and bands, a row for each document. Bands of one without words (n = 0) mean nothing."""
    rounds = math.ceil(bands * rows / MOST_MINIMA)
    per = math.ceil(bands / rounds)
    # explode_outer, since explode would first be given a filter that computes the n-grams once more.
    each = with_shingles(base, "_text", n).select("_id", "_key", F.explode_outer("s").alias("g"))
    each = each.select("*", F.explode(F.array(*[F.lit(k) for k in range(rounds)])).alias("round")).withColumn("h", F.xxhash64("g", "round"))
    minima = [F.min(F.xxhash64(F.col("h").bitwiseXOR(F.lit(_spread(k))))).alias(f"m{k}") for k in range(per * rows)]
    least = each.groupBy("_id", "_key", "round").agg(F.count("g").alias("n"), F.bit_xor("h").alias("x"), *minima)
    band = [F.xxhash64(F.col("round") * per + b, *[F.col(f"m{b * rows + r}") for r in range(rows)]) for b in range(per)]
    parts = least.select("_id", "_key", "n", F.struct("round", "x", F.array(*band).alias("b")).alias("part"))
    whole = parts.groupBy("_id", "_key").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("part")).alias("parts"))
    # Equal sets have equal numbers, sums of hashes and bands; all bands together are far more than 128 bits.
    return whole.select("_id", "_key", F.xxhash64("n", "parts").alias("s1"), F.xxhash64(F.lit(1), "parts.x", "parts.b").alias("s2"), "n", F.slice(F.flatten("parts.b"), 1, bands).alias("bands"))


def _spread(k: int) -> int:
    """A 64-bit number for each k, as a signed one."""
    x = (k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    return x - (1 << 64) if x >> 63 else x


#: Verification of one row. m: members by class, with slot, number of n-grams n, bands of earlier buckets and n-grams s.
_LINKED = """i < j and (one or x.slot <> y.slot) and least(x.n, y.n) >= {t} * greatest(x.n, y.n) - 1e-9 and not arrays_overlap(x.before, y.before)
  and size(array_intersect(x.s, y.s)) * (1 + {t}) >= {t} * (x.n + y.n) - 1e-9"""
#: For each member, the members after it that it is linked with.
_LATER = "transform(m, (x, i) -> filter(transform(m, (y, j) -> if({linked}, j, -1)), j -> j >= 0))"
#: Number of links of each member: as the first and as the second of a pair.
_COUNTS = """aggregate(later, transform(m, x -> 0), (c, js) -> if(size(js) = 0, c, transform(c, (k, i) -> k + int(array_contains(js, i)))),
  c -> zip_with(c, later, (k, js) -> k + size(js)))"""
#: The smallest member that each member is connected with in this row.
_ROOTS = """aggregate(transform(later, (js, i) -> struct(i, js)), transform(m, (x, i) -> i), (r, z) -> if(size(z.js) = 0, r,
  transform(array(array_distinct(transform(concat(array(z.i), z.js), k -> r[k]))), old -> transform(array(array_min(old)), low -> transform(r, k -> if(array_contains(old, k), low, k)))[0])[0]))"""


def _verified(blocks: DataFrame, threshold: float) -> DataFrame:
    """blocks (one, m) -> node, low and links, a row for each member with links and each row of blocks."""
    later = blocks.select("m", F.expr(_LATER.format(linked=_LINKED.format(t=f"{threshold!r}D"))).alias("later"))
    rooted = later.select(F.col("m.cid").alias("cid"), F.expr(_COUNTS).alias("links"), F.expr(_ROOTS).alias("roots"))
    # As an outer generator, since another would first be given a filter that compares all pairs once more.
    each = rooted.select("cid", F.posexplode_outer("links").alias("i", "links"), "roots")
    return each.where("links > 0").select(F.expr("cid[i]").alias("node"), F.expr("cid[roots[i]]").alias("low"), F.col("links").cast("long").alias("links"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, rows: int = 5, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, _key, n_shingles, set_id (smallest id with the same n-gram set), class_id (smallest id of its near-duplicate group), keeper (the one document of the group that stays) and n_links (other sets at or above the threshold), a row for each row of docs."""
    work, bands = Work(docs.sparkSession), bands_for(threshold, recall, rows)
    base = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_key"), F.col(text_col).alias("_text"))
    signed = work.write(_signed(base, n, bands, rows)).where("n > 0")
    classes = signed.groupBy("s1", "s2").agg(F.min(F.struct("_id", "_key", "n", "bands")).alias("x"))
    sets = work.write(classes.select("s1", "s2", F.struct("x._id", "x._key").alias("first"), "x.n", "x.bands").withColumn("cid", F.monotonically_increasing_id()))

    banded = sets.select("cid", "n", F.posexplode("bands").alias("band", "bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("band").alias("band"), F.count("*").alias("m"), F.sum("n").alias("grams"), F.bit_xor(F.xxhash64("cid")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "cid")).alias("x2")).where("m > 1")
    buckets = buckets.groupBy("m", "grams", "x1", "x2").agg(F.min(F.struct("band", "bucket")).alias("b"))
    slots = F.greatest(F.ceil(F.col("m") / SLOT_CLASSES), F.ceil(F.col("grams") / SLOT_GRAMS)).cast("int")
    # What is aggregated by a key is written before it is joined by it, so that the join can split a hot key over tasks.
    buckets = work.write(buckets.select("b.bucket", "b.band", slots.alias("q")))
    members = work.write(banded.select("cid", "bucket").join(buckets, "bucket").withColumn("slot", F.pmod(F.xxhash64("cid"), F.col("q")).cast("int")))
    wanted = members.select("cid").distinct().join(sets.select("cid", "first", "n", "bands"), "cid")
    wanted = wanted.select("cid", "n", "bands", F.col("first._id").alias("_i"), F.col("first._key").alias("_k"))
    texts = base.join(wanted, (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_i"))).dropDuplicates(["cid"])
    full = with_shingles(texts.select("cid", "n", "bands", "_text"), "_text", n).drop("_text")
    placed = members.join(full, "cid").withColumn("other", F.explode(F.expr("sequence(0, q - 1)")))
    placed = placed.select("bucket", F.least("slot", "other").alias("lo"), F.greatest("slot", "other").alias("hi"), F.struct("cid", "slot", "n", F.slice("bands", 1, F.col("band")).alias("before"), "s").alias("x"))
    blocks = placed.groupBy("bucket", "lo", "hi").agg(F.array_sort(F.collect_list("x")).alias("m")).where("size(m) > 1")
    verified = work.write(_verified(blocks.select((F.col("lo") == F.col("hi")).alias("one"), "m"), threshold))

    found = components(verified.select(F.col("node").alias("a"), F.col("low").alias("b")), work).withColumnRenamed("node", "cid")
    degree = verified.groupBy(F.col("node").alias("cid")).agg(F.sum("links").alias("n_links"))
    grouped = sets.select("cid", "s1", "s2", "first").join(found, "cid", "left").join(degree, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = work.write(grouped.groupBy("root").agg(F.min("first").alias("least")))
    found_classes = grouped.join(least, "root").select("s1", "s2", "first", "least", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    work.drop(members, buckets)
    told = signed.select("_id", "_key", "n", "s1", "s2").join(found_classes, ["s1", "s2"])
    told = told.select(F.col("_id").alias("_i"), F.col("_key").alias("_k"), "n", "first", "least", "n_links")
    placed = base.select("_id", "_key").join(told, (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_i")), "left")
    # A text without words has no class: it stands alone.
    keeper = F.col("least").isNull() | (F.col("least._key") == F.col("_key")) & F.col("least._id").eqNullSafe(F.col("_id"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    own = lambda c: F.when(F.col("_k").isNull(), F.col("_id")).otherwise(F.col(c))
    return placed.select(F.col("_id").alias(id_col), "_key", count("n").alias("n_shingles"), own("first._id").alias("set_id"), own("least._id").alias("class_id"), keeper.alias("keeper"), count("n_links").alias("n_links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs without near duplicates: the smallest id of each group stays, once."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **settings)
    key = row_key(id_col, text_col)
    kept = found.where("keeper").groupBy("_key", id_col).agg(F.count("*").alias("_copies"))
    keep = kept.select(F.col("_key").alias("__kept_key"), F.col(id_col).alias("__kept_id"))
    left = docs.join(keep, (key == F.col("__kept_key")) & F.col(id_col).eqNullSafe(F.col("__kept_id")), "left_semi")
    if kept.where("_copies > 1").isEmpty():
        return left
    return left.withColumn("__kept_key", key).dropDuplicates(["__kept_key", id_col]).drop("__kept_key")
