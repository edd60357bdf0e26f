"""Operator 10, benchmark decontamination: suffix arrays of the training text, searched for every test suffix.

The documents are cut into shards of bounded size. For each shard a suffix array is built: the word positions at which
a match may begin (those whose first two words begin some test window), sorted by the words that follow. Test suffixes
that begin with the same `window` words are one window with a set of items; each window is binary-searched in the suffix
array, so a place of the training text is found once, however many items share its words. The hits are extended word by
word to the longest verbatim matches, places and test suffixes side by side.

Test items are cut into chunks of bounded size; one at a time is read, broadcast, searched for and let go. With more than
one chunk, a first scan of all documents keeps those that hold a test window by a bit table of fixed size, and the chunks
are searched for in these alone. So the documents are read once, and neither driver nor broadcast grows with the benchmark.

Defined results: null and empty texts have no words and are never hit or searched for; an item of fewer words than the
window is one window; repeated rows of documents get their result each; equal item ids count once in items.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import by_pieces, row_key
from galeframe.llm.kernel import ALNUM_WORDS, Texts, counts, grams, mix, valid_starts
from galeframe.llm.store import Work

WINDOW = 13
#: Bytes of benchmark text in one broadcast chunk, and bits of the table that tells which documents may hold a window.
CHUNK_BYTES, BITS = 8 << 20, 1 << 27
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _pairs(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * _STEP + h[1:])


def _spans_of(values: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal values in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, np.int64)


class TestSuffixes:
    """The suffixes of one chunk of items, grouped by their windows, and the items of each window."""

    def __init__(self, ids: list, texts: pa.Array, window: int = WINDOW):
        t = Texts(texts, ALNUM_WORDS)
        starts, ends, of = t.words()
        self.h, self.ids, self.window = t.hashes(starts, ends), [str(x) for x in ids], window
        n = counts(of, t.n)
        left = (np.cumsum(n))[of] - np.arange(len(of))
        need = np.minimum(n[of], window)
        at = np.flatnonzero(left >= need)
        one, two = window_hashes(self.h, at, need[at], 1), window_hashes(self.h, at, need[at], 2)
        order = np.lexsort((at, two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        #: Suffixes by window, the window of each, and where each window's suffixes begin; all by the order of window hashes.
        self.at, self.left, self.of = at[order], left[at][order], of[at][order]
        self.win = np.cumsum(new) - 1
        self.begin = np.append(np.flatnonzero(new), len(order))
        self.need = need[self.at[self.begin[:-1]]] if len(order) else np.zeros(0, np.int64)
        self.keys = one[order][new]
        self._sets()
        first = self.at[self.begin[:-1]]
        padded = np.append(self.h, np.uint64(0))
        long = self.need > 1
        self.first_two, self.first_one = np.unique(_pairs(padded)[first[long]]) if long.any() else np.zeros(0, np.uint64), np.unique(self.h[first[~long]])

    def _sets(self) -> None:
        """Windows of the same items share one set of items: set_of each window, and items of each set."""
        pair = np.unique(self.win * max(1, len(self.ids)) + self.of) if len(self.win) else np.zeros(0, np.int64)
        win, item = np.divmod(pair, max(1, len(self.ids)))
        cut = _spans_of(win)
        if len(pair):
            h = mix(item.astype(np.uint64) + np.uint64(1))
            sums = np.stack([np.add.reduceat(h, cut[:-1]), np.add.reduceat(mix(h), cut[:-1])], axis=1)
            _, one, self.set_of = np.unique(sums, axis=0, return_index=True, return_inverse=True)
            self.set_of = self.set_of.ravel()
            self.sets = [item[cut[i] : cut[i + 1]] for i in one]
        else:
            self.set_of, self.sets = np.zeros(0, np.int64), []

    @cached_property
    def words(self) -> np.ndarray:
        """The words of each window; built where it is searched for, not sent."""
        return _rows(self.h, self.at[self.begin[:-1]], self.need, self.window)


def window_hashes(h: np.ndarray, at: np.ndarray, need: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the `need` words at each place."""
    out = np.zeros(len(at), np.uint64)
    for k in np.unique(need):
        mine = need == k
        out[mine] = grams(h, int(k), seed=int(k) * 4 + seed)[at[mine]]
    return out


def _rows(h: np.ndarray, at: np.ndarray, need: np.ndarray, window: int) -> np.ndarray:
    """The first `window` words of each suffix; beyond need, 0."""
    k = np.arange(window)
    inside = k[None, :] < need[:, None]
    return np.where(inside, h[np.minimum(at[:, None] + k, max(len(h) - 1, 0))] if len(h) else np.uint64(0), np.uint64(0))


def _among(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    flag = np.zeros(1 << 16, bool)  # most words fail this cheap test
    flag[(sorted_values & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = flag[(x & np.uint64(0xFFFF)).astype(np.int64)]
    some = np.flatnonzero(out)
    i = np.minimum(np.searchsorted(sorted_values, x[some]), len(sorted_values) - 1)
    out[some] = sorted_values[i] == x[some]
    return out


class SuffixArray:
    """Suffixes of a shard's words, sorted by their first `window` words."""

    def __init__(self, h: np.ndarray, last: np.ndarray, at: np.ndarray, window: int):
        rows = _rows(h, at, np.minimum(last[at] - at, window), window)
        order = np.lexsort(rows.T[::-1]) if len(at) else np.zeros(0, np.int64)
        self.at, self.rows, self.left = at[order], rows[order], (last[at] - at)[order]

    def bound(self, rows: np.ndarray, need: np.ndarray, upper: bool) -> np.ndarray:
        """For each searched row, where the suffixes that begin with its first need words start, or end."""
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(self.at))
        k = np.arange(rows.shape[1])[None, :]
        while len(rows) and (active := lo < hi).any():
            mid = (lo + hi) // 2
            other = self.rows[np.minimum(mid, len(self.at) - 1)]
            differ = (other != rows) & (k < need[:, None])
            j = differ.argmax(axis=1)
            i = np.arange(len(rows))
            less = differ.any(axis=1) & (other[i, j] < rows[i, j])
            go = less | (upper & ~differ.any(axis=1))
            lo, hi = np.where(active & go, mid + 1, lo), np.where(active & ~go, mid, hi)
        return lo


@dataclass
class Hits:
    """Where test windows stand in a batch: the words of its texts, and place and window of each hit."""

    h: np.ndarray
    of: np.ndarray
    n: np.ndarray
    first: np.ndarray
    at: np.ndarray
    win: np.ndarray

    def covered(self, tests: TestSuffixes) -> np.ndarray:
        """Which words stand in a hit."""
        size = tests.need[self.win]
        d = np.bincount(self.at, minlength=len(self.of) + 1) - np.bincount(self.at + size, minlength=len(self.of) + 1)
        return np.cumsum(d[: len(self.of)]) > 0

    def longest(self, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
        """Words of the longest verbatim match from each hit on, and the item of a test suffix that has it. Places and suffixes that agree so far have the same key; in each step both go on by a word, and keys without a partner drop out."""
        size, whose = tests.need[self.win].copy(), tests.of[tests.begin[self.win]]
        d = np.flatnonzero(size == tests.window)
        key = self.win[d].astype(np.uint64)
        hit = np.unique(self.win[d])
        t = np.concatenate([np.arange(a, b) for a, b in zip(tests.begin[hit], tests.begin[hit + 1], strict=True)]) if len(hit) else hit
        tkey, length = tests.win[t].astype(np.uint64), tests.window
        end = (self.first + self.n)[self.of]
        while len(d) and len(t):
            goes, tgoes = self.at[d] + length < end[self.at[d]], tests.left[t] > length
            d, key, t, tkey = d[goes], key[goes], t[tgoes], tkey[tgoes]
            key, tkey = mix(key * _STEP + self.h[self.at[d] + length]), mix(tkey * _STEP + tests.h[tests.at[t] + length])
            common, one = np.unique(tkey, return_index=True)
            if not len(common):
                break
            i = np.minimum(np.searchsorted(common, key), len(common) - 1)
            same = common[i] == key
            length += 1
            d, key = d[same], key[same]
            size[d], whose[d] = length, tests.of[t[one[i[same]]]]
            stay = np.isin(tkey, key)
            t, tkey = t[stay], tkey[stay]
        return size, whose


def search(texts, tests: TestSuffixes) -> Hits:
    """All places of the texts where a test window stands."""
    t = Texts(texts, ALNUM_WORDS)
    starts, ends, of = t.words()
    h, n = t.hashes(starts, ends), counts(of, t.n)
    first = np.cumsum(n) - n
    none = np.zeros(0, np.int64)
    if not len(h) or not len(tests.at):
        return Hits(h, of, n, first, none, none)
    may = _among(h, tests.first_one)
    may[:-1] |= _among(_pairs(h), tests.first_two)
    sa = SuffixArray(h, (first + n)[of], np.flatnonzero(may), tests.window)
    lo, hi = sa.bound(tests.words, tests.need, False), sa.bound(tests.words, tests.need, True)
    m = hi - lo
    win = np.repeat(np.arange(len(m)), m)
    slot = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo, m)
    ok = sa.left[slot] >= tests.need[win]
    return Hits(h, of, n, first, sa.at[slot][ok], win[ok])


def _spans(flags: np.ndarray) -> np.ndarray:
    d = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(d == 1), np.flatnonzero(d == -1)], axis=1)


class Chunks:
    """The benchmark's items in chunks of bounded size, read one at a time."""

    def __init__(self, benchmark: DataFrame, item_col: str, text_col: str, chunk_bytes: int, window: int):
        # Equal rows are one item, so that a chunk's share by hash is bounded.
        self.items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).distinct()
        self.n, self.window = 1 + (self.items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // chunk_bytes, window

    def __iter__(self):
        for k in range(self.n):
            got = (self.items if self.n == 1 else self.items.where(F.pmod(F.xxhash64("i", "t"), F.lit(self.n)) == k)).toArrow()
            yield TestSuffixes(got.column("i").to_pylist(), got.column("t"), self.window)


def _bits(chunks: Chunks) -> tuple[np.ndarray, list[int]]:
    """A table of BITS bits with those of all windows' hashes set, and the windows' numbers of words."""
    bits, needs = np.zeros(BITS // 8, np.uint8), set()
    for tests in chunks:
        at = tests.keys & np.uint64(BITS - 1)
        np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))
        needs |= set(tests.need.tolist())
    return bits, sorted(needs)


def _may_hold(texts, bits: np.ndarray, needs: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text, and which texts have a window whose bit is set."""
    t = Texts(texts, ALNUM_WORDS)
    starts, ends, of = t.words()
    h, n, may = t.hashes(starts, ends), counts(of, t.n), np.zeros(t.n, bool)
    for k in needs:
        if len(h) >= k:
            at = np.flatnonzero(valid_starts(of, k))
            x = grams(h, k, seed=k * 4 + 1)[at] & np.uint64(BITS - 1)
            set_ = (bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1
            may[of[at[set_]]] = True
    return n, may


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """id, n_words, n_hit, hit_spans (of words), longest (words of the longest verbatim match), longest_at, longest_item, items and contaminated (n_hit > 0 and 20 * n_hit >= n_words), a row for each row of docs."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, _key long, n_words long, hit_spans array<array<int>>, longest long, longest_at long, longest_item string, items array<string>"
    base = docs.select(F.col(id_col), row_key(id_col, text_col).alias("_key"), F.col(text_col).alias("_text"))
    chunks = Chunks(benchmark, item_col, text_col, chunk_bytes, window)

    def against(texts: DataFrame, tests_of) -> DataFrame:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            tests = tests_of.value
            hits = search(batch.column(2), tests)
            m, whose = len(hits.n), hits.of[hits.at]
            covered, (size, item) = hits.covered(tests), hits.longest(tests)
            spans, items, best = [[] for _ in range(m)], [set() for _ in range(m)], [(0, None, None)] * m
            for i in np.unique(whose):
                spans[i] = _spans(covered[hits.first[i] : hits.first[i] + hits.n[i]]).tolist()
            for i, s in np.unique(np.stack([whose, tests.set_of[hits.win]], axis=1), axis=0).tolist():
                items[i].update(tests.ids[j] for j in tests.sets[s].tolist())
            order = np.lexsort([hits.at, -size, whose])
            for j in order[np.unique(whose[order], return_index=True)[1]]:
                best[whose[j]] = (int(size[j]), int(hits.at[j] - hits.first[whose[j]]), tests.ids[item[j]])
            cols = [batch.column(0), batch.column(1), pa.array(hits.n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), *(pa.array([b[k] for b in best], (pa.int64(), pa.int64(), pa.string())[k]) for k in range(3)), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(cols, names=[id_col, "_key", "n_words", "hit_spans", "longest", "longest_at", "longest_item", "items"])

        return texts.mapInArrow(by_pieces(run, "_text"), schema)

    if chunks.n == 1:
        found = against(base, spark.sparkContext.broadcast(next(iter(chunks))))
    else:
        work = Work(spark)
        bits_of = spark.sparkContext.broadcast(_bits(chunks))

        def sift(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, may = _may_hold(batch.column(2), *bits_of.value)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pc.if_else(pa.array(may), batch.column(2), pa.scalar(None, batch.column(2).type))], names=[id_col, "_key", "n_words", "_text"])

        every = work.write(base.mapInArrow(by_pieces(sift, "_text"), f"`{id_col}` {kind}, _key long, n_words long, _text string"))
        near, parts = every.where(F.col("_text").isNotNull()).select(id_col, "_key", "_text"), []
        for tests in chunks:
            tests_of = spark.sparkContext.broadcast(tests)
            parts.append(work.write(against(near, tests_of).where("size(items) > 0")))
            tests_of.destroy()
        # A document has a row for each chunk that hits it, and for each of its copies: sets of spans and of item lists.
        rows = reduce(DataFrame.unionAll, parts)
        best = F.max_by(F.struct("longest_at", "longest_item"), F.struct("longest", F.negate("longest_at")))
        merged = rows.groupBy(F.col(id_col).alias("_i"), F.col("_key").alias("_k")).agg(F.flatten(F.collect_set("hit_spans")).alias("hit_spans"), F.max("longest").alias("longest"), best.alias("_best"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        merged = work.write(merged.withColumn("hit_spans", F.expr(_MERGE)))
        joined = every.drop("_text").join(merged, (F.col("_key") == F.col("_k")) & F.col(id_col).eqNullSafe(F.col("_i")), "left")
        found = joined.select(id_col, "_key", "n_words", F.coalesce("hit_spans", F.array().cast("array<array<int>>")).alias("hit_spans"), F.coalesce("longest", F.lit(0)).cast("long").alias("longest"), F.col("_best.longest_at").alias("longest_at"), F.col("_best.longest_item").alias("longest_item"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    n_hit = F.expr("aggregate(hit_spans, 0L, (s, x) -> s + x[1] - x[0])")
    return found.drop("_key").withColumn("n_hit", n_hit).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


#: Overlapping spans made one.
_MERGE = """aggregate(array_sort(hit_spans), cast(array() as array<array<int>>), (s, x) ->
  if(size(s) > 0 and element_at(s, -1)[1] >= x[0], concat(slice(s, 1, size(s) - 1), array(array(element_at(s, -1)[0], greatest(element_at(s, -1)[1], x[1])))), concat(s, array(x))))"""


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the contract."""
    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns. One chunk of items needs no shuffle."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    chunks = Chunks(benchmark, item_col, text_col, chunk_bytes, window)
    if chunks.n == 1:
        tests_of = spark.sparkContext.broadcast(next(iter(chunks)))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            hits = search(batch.column(at), tests_of.value)
            hit = counts(hits.of[hits.covered(tests_of.value)], len(hits.n))
            return batch.filter(pa.array(~((hit > 0) & (20 * hit >= hits.n))))

        return docs.mapInArrow(by_pieces(run, text_col), docs.schema)
    tagged = docs.withColumn("__row", row_key(text_col, text_col))
    bad = contamination(docs.select(F.xxhash64(text_col, text_col).alias("__row"), text_col), benchmark, "__row", text_col, item_col, window, chunk_bytes).where("contaminated").select("__row").distinct()
    return tagged.join(bad, "__row", "left_anti").select(*docs.columns)


def items_sha256(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
