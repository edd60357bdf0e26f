"""Operator 8, LM scoring: stupid backoff, computed relationally.

score(word | context) = count(n-gram) / count(context) if the n-gram occurs in the corpus, else backoff times the score of
the word after a context that is a word shorter; without context it is count(word) / number of words. All n-grams of the
corpus are counted. Words near the start of a document have the context that there is.

`score` takes the documents themselves as the corpus. Each n-gram of a document has been counted then, so that the longest
decides and the logarithm of a document's score is a sum over its n-grams: times of the n-gram as one that scores a word,
less its times as a context, by the logarithm of its count. So n-grams are dealt by hash (a row holds those that a
piece of a batch has in one part of the hash space, each with its document), exploded there, counted, and their scores
summed per document; they cross the network once. N-grams that make up more than about
1 / MOST_HOT of all words would gather in one task. There are at most MOST_HOT of each order; they are found by what is
frequent in a task's own words, counted exactly, and their counts are broadcast as a table that the documents are scored
with before the rest of their n-grams is dealt.

`count_table` and `score_against` score documents by another corpus: its count tables are partitioned by hash and joined to
the exploded n-grams, order by order, the unseen ones backing off.

Defined results: a null text or one without words has 0 words and null scores; repeated rows each count in the corpus
and each get their result; extra columns are ignored; a word that another corpus lacks counts as one that it has once;
n-grams are told apart by 64-bit hashes, and so are the documents that parts of a score belong to.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galeframe.llm.common import by_pieces, pieces, row_key
from galeframe.llm.kernel import SPACE_WORDS, Texts, counts, grams, mix, valid_starts
from galeframe.llm.store import Work

U64 = np.uint64
#: At most so many n-grams of an order are broadcast, 16 bytes each.
MOST_HOT = 1 << 20
#: A task reports its frequent n-grams for each so many words, a partition of the exchange is for about so many, and so many bytes of text are counted or exploded at once.
HEAVY_WORDS, PARTITION_WORDS, EXPLODED_BYTES = 2_200_000, 2_250_000, 1 << 20


class _Grams:
    """The n-grams of a batch, a list for each order: where they start and their hashes."""

    def __init__(self, column, order: int):
        t = Texts(column, SPACE_WORDS)
        starts, ends, self.of = t.words()
        self.n = counts(self.of, t.n)
        self.first = np.cumsum(self.n) - self.n
        h = t.hashes(starts, ends)
        self.every = [grams(h, k, seed=k) for k in range(1, order + 1)]
        self.at = [np.flatnonzero(valid_starts(self.of, k)) if len(h) >= k else np.zeros(0, np.int64) for k in range(1, order + 1)]
        self.grams = [g[at] for g, at in zip(self.every, self.at, strict=True)]


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.view(np.int64))


def _counted(keys: np.ndarray, times: np.ndarray, words: int | None = None) -> pa.RecordBatch:
    """N-grams and their times, and the number of words in a row without n-gram."""
    if words is not None:
        keys, times = np.append(keys, U64(0)), np.append(times, words)
    no_gram = np.arange(len(keys)) == (len(keys) - 1 if words is not None else -1)
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64), mask=no_gram), pa.array(times, pa.int64())], names=["gram", "times"])


def _table(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A bounded table of n-grams and their times, by n-gram."""
    got = found.toArrow()
    keys, times = got.column("gram").to_numpy().astype(np.int64).view(U64), got.column("times").to_numpy().astype(np.int64)
    order = np.argsort(keys)
    return keys[order], times[order]


def hot_counts(texts: DataFrame, order: int, most: int, work: Work) -> tuple[np.ndarray, np.ndarray, int]:
    """N-grams and their exact counts, with all those among them that occur 2 / most times the number of words or more, at most `most` of each order; and the number of words."""
    text = texts.columns[0]

    def frequent(batches):
        held: list[list[np.ndarray]] = [[] for _ in range(order)]
        words = 0

        def report():
            for k in range(order):
                every = np.concatenate(held[k])
                held[k].clear()
                # What is frequent on the whole is so in a report at least.
                yield _counted(*_often(every, -(-words // most)), None if k else words)

        for batch in batches:
            for piece in pieces(batch, text, EXPLODED_BYTES):
                g = _Grams(piece.column(0), order)
                words += len(g.of)
                for k in range(order):
                    held[k].append(g.grams[k])
                if words >= HEAVY_WORDS:
                    yield from report()
                    words = 0
        if words:
            yield from report()

    seen = work.write(texts.mapInArrow(frequent, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times")))
    n = seen.where(F.col("gram").isNull()).agg(F.sum("times")).first()[0] or 0
    hot, _ = _table(seen.where(F.col("gram").isNotNull() & (F.col("times") * most >= n)))
    work.drop(seen)
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def exact(batches):
        keys, total = shared.value, None
        for batch in batches:
            for piece in pieces(batch, text, EXPLODED_BYTES):
                for got in _Grams(piece.column(0), order).grams:
                    gram, times = np.unique(got, return_counts=True)
                    at, known = _looked_up(keys, gram)
                    total = np.zeros(len(keys), np.int64) if total is None else total
                    total[at[known]] += times[known]
        if total is not None:
            some = np.flatnonzero(total)
            yield _counted(keys[some], total[some])

    keys, times = _table(texts.mapInArrow(exact, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times")))
    return keys, times, n


def _often(every: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The values that occur `least` times or more, and their times. Sorts in place, as `every` may be large."""
    every.sort()
    keys = np.unique(every[: max(0, len(every) - least + 1)][every[: max(0, len(every) - least + 1)] == every[least - 1 :]])
    return keys, np.searchsorted(every, keys, side="right") - np.searchsorted(every, keys)


def _same(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order in which equal keys are neighbours, where each run of them begins in it, and how many it has."""
    by = np.argsort(keys)
    s = keys[by]
    begins = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return by, begins, np.diff(np.append(begins, len(s)))


def _looked_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and which are found."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _checked(order: int) -> None:
    if order < 1:
        raise ValueError("the order is 1 at least")


def score(docs: DataFrame, order: int = 2, id_col: str = "doc_id", text_col: str = "text", most_hot: int = MOST_HOT, partition_words: int = PARTITION_WORDS) -> DataFrame:
    """Documents scored by themselves as the corpus: id, n_words, n_pair_hits (words scored by a pair or a longer n-gram that occurs twice or more), log_score (sum of natural logarithms) and mean_log_score, a row for each row of docs."""
    _checked(order)
    spark = docs.sparkSession
    keys, times, n = hot_counts(docs.select(text_col), order, most_hot, Work(spark))
    shared = spark.sparkContext.broadcast((keys, times))
    base = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_key"), F.col(text_col).alias("_text"))

    # A few parts for each core at least, where there are words enough.
    parts = 1 + max(n // partition_words, min(4 * spark.sparkContext.defaultParallelism, 10 * n // partition_words))

    def explode(batch: pa.RecordBatch) -> pa.RecordBatch:
        """A row for each part with the n-grams that aren't broadcast, and one for each document with its words and the score of the others."""
        hot, count = shared.value
        logs = np.log(np.maximum(count, 1))
        g, m = _Grams(batch.column(1), order), batch.num_rows
        done, hits = -np.log(max(n, 1)) * (g.n if order == 1 else np.minimum(g.n, 1)), np.zeros(m)
        cold = []
        for k, (at, x) in enumerate(zip(g.at, g.grams, strict=True), 1):
            of = g.of[at]
            opens, goes_on = at == g.first[of], at < (g.first + g.n)[of] - k
            scores = np.ones(len(at), bool) if k == order else opens
            context = goes_on if k == order - 1 else goes_on & opens if k < order else np.zeros(len(at), bool)
            by, begins, often = _same(x ^ mix(of.astype(U64)))
            gives, takes = (np.add.reduceat(z[by].astype(np.int64), begins) if len(by) else np.zeros(0, np.int64) for z in (scores, context))
            weight, hit = gives - takes, gives if k > 1 else 0 * gives
            gram, doc = x[by[begins]], of[by[begins]]
            i, known = _looked_up(hot, gram)
            done += np.bincount(doc[known], weight[known] * logs[i[known]], m)
            hits += np.bincount(doc[known], hit[known] * (count[i[known]] > 1), m)
            cold.append([z[~known] for z in (doc, gram, np.stack([often, weight, hit], axis=1))])
        doc, gram, uses = (np.concatenate(z) for z in zip(*cold, strict=True))
        part = (gram >> U64(16)).astype(np.int64) % parts
        order_ = np.argsort(part * m + doc)  # n-grams of a document stay together
        doc, gram, part, uses = doc[order_], gram[order_], part[order_], uses[order_]
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        ends = np.concatenate([cut, np.full(m + 1, len(part))])
        keys = batch.column(0).to_numpy(zero_copy_only=False)[doc]
        lists = [pa.ListArray.from_arrays(pa.array(k * ends, pa.int32()), x) for k, x in ((1, pa.array(keys)), (1, _signed(gram)), (3, pa.array(uses.ravel(), pa.int32())))]
        row = np.concatenate([np.zeros(len(cut), np.int64), np.arange(m)])
        packed = pa.array(np.arange(len(row)) < len(cut))
        own = pa.StructArray.from_arrays([batch.column(0).take(pa.array(row)), pa.array(done[row]), pa.array(g.n[row], pa.int64()), pa.array(hits[row].astype(np.int64))], ["key", "score", "words", "hits"], mask=packed)
        parts_ = pa.array(np.concatenate([part[cut], np.arange(m) % parts]), pa.int32())
        return pa.RecordBatch.from_arrays([parts_, own, *lists], names=["part", "own", "keys", "grams", "uses"])

    def exploded(batches):
        for batch in batches:
            for piece in pieces(batch, "_text", EXPLODED_BYTES):
                yield explode(piece)

    rows = base.select("_key", "_text").mapInArrow(exploded, "part int, own struct<key: bigint, score: double, words: bigint, hits: bigint>, keys array<long>, grams array<long>, uses array<int>")
    # uses has three numbers for each n-gram: times that it stands in the document, weight of its logarithm, and words
    # that it scores. The last two travel as one through the sort.
    dealt = rows.repartition(parts, "part").select("part", "own", "keys", "uses", F.posexplode_outer("grams").alias("i", "gram"))
    dealt = dealt.select(F.coalesce("own.key", F.expr("get(keys, i)")).alias("_key"), "part", "own", "gram", F.expr("get(uses, 3 * i)").alias("times"), F.expr("shiftleft(cast(get(uses, 3 * i + 1) as bigint), 32) + get(uses, 3 * i + 2)").alias("worth"))
    known = dealt.withColumn("c", F.sum("times").over(Window.partitionBy("gram", "part")))
    score = F.coalesce("own.score", F.shiftright("worth", 32) * F.log("c"))
    hit = F.coalesce("own.hits", F.when(F.col("c") > 1, F.col("worth").bitwiseAND(0xFFFFFFFF)))
    sums = known.groupBy("_key").agg(F.sum(score).alias("score"), F.sum(hit).alias("hits"), F.max("own.words").alias("n_words"), F.count("own").alias("copies"))
    sums = sums.select(F.col("_key"), "n_words", (F.col("hits") / F.col("copies")).cast("long").alias("n_pair_hits"), F.when(F.col("n_words") > 0, F.col("score") / F.col("copies")).alias("log_score"))
    out = base.select("_id", "_key").join(sums, "_key")
    return out.select(F.col("_id").alias(id_col), "n_words", "n_pair_hits", "log_score", (F.col("log_score") / F.col("n_words")).alias("mean_log_score"))


def count_table(corpus: DataFrame, order: int = 2, text_col: str = "text") -> DataFrame:
    """gram and c: the counts of all n-grams up to the order, partitioned by hash; the row without a gram has the number of words."""
    _checked(order)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        g = _Grams(batch.column(0), order)
        found = [np.unique(x, return_counts=True) for x in g.grams]
        return _counted(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]), len(g.of))

    return corpus.select(text_col).mapInArrow(by_pieces(run, text_col), "gram long, times long").groupBy("gram").agg(F.sum("times").alias("c"))


def score_against(docs: DataFrame, table: DataFrame, order: int = 2, backoff: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents scored by the counts of another corpus (its count_table of this order): id, n_words, n_backoffs (shortenings of contexts), log_score and mean_log_score, a row for each row of docs."""
    _checked(order)
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    work = Work(spark)
    base = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_key"), F.col(text_col).alias("_text"))

    def explode(batch: pa.RecordBatch) -> pa.RecordBatch:
        """A row for each document and longest n-gram: the n-grams that end with its word, longest first, and their contexts."""
        g = _Grams(batch.column(2), order)
        docs_, chains, contexts, times, sizes = [], [], [], [], []
        for k, (at, x) in enumerate(zip(g.at, g.grams, strict=True), 1):
            mine = np.flatnonzero((at == g.first[g.of[at]]) | (k == order))
            of = g.of[at[mine]]
            _, one, often = np.unique(x[mine] ^ mix(of.astype(U64)), return_index=True, return_counts=True)
            start = at[mine][one]
            docs_.append(of[one])
            times.append(often)
            sizes.append(np.full(len(one), k))
            chains.append(np.stack([g.every[k - j - 1][start + j] for j in range(k)], axis=1).ravel())
            contexts.append(np.stack([g.every[k - j - 2][start + j] if j < k - 1 else np.zeros(len(one), U64) for j in range(k)], axis=1).ravel())
        doc, size = np.concatenate(docs_), np.concatenate(sizes)
        ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, _signed(np.concatenate(z))) for z in (chains, contexts)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), pa.array(np.concatenate(times), pa.int64()), *lists], names=["_id", "_key", "times", "chain", "contexts"])

    def count_words(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = Texts(batch.column(2), SPACE_WORDS)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts(t.words()[2], t.n), pa.int64())], names=["_id", "_key", "n_words"])

    grams_ = table.where(F.col("gram").isNotNull())
    total = max(1, (table.where(F.col("gram").isNull()).agg(F.sum("c")).first()[0] or 0))
    # Repeated rows of docs would each bring their n-grams; one of them does for all.
    once = base.dropDuplicates(["_id", "_key"])
    waiting = once.mapInArrow(by_pieces(explode, "_text"), f"_id {kind}, _key long, times long, chain array<long>, contexts array<long>").withColumn("cut", F.lit(0))
    parts = []
    for _ in range(order):
        seen = work.write(waiting.withColumn("gram", F.element_at("chain", 1)).join(grams_, "gram", "left"))
        penalty = F.col("cut") * F.lit(float(np.log(backoff)))
        word, found = F.size("chain") == 1, F.col("c").isNotNull()
        parts.append(seen.where(word).select("_id", "_key", "times", "cut", (penalty + F.log(F.coalesce("c", F.lit(1)) / F.lit(total))).alias("s")))
        below = grams_.select(F.col("gram").alias("context"), F.col("c").alias("before"))
        parts.append(seen.where(~word & found).withColumn("context", F.element_at("contexts", 1)).join(below, "context").select("_id", "_key", "times", "cut", (penalty + F.log(F.col("c") / F.col("before"))).alias("s")))
        waiting = seen.where(~word & ~found).select("_id", "_key", "times", F.expr("slice(chain, 2, size(chain) - 1)").alias("chain"), F.expr("slice(contexts, 2, size(contexts) - 1)").alias("contexts"), (F.col("cut") + 1).alias("cut"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    sums = every.groupBy("_id", "_key").agg(F.sum(F.col("times") * F.col("s")).alias("log_score"), F.sum(F.col("times") * F.col("cut")).alias("n_backoffs"))
    sums = work.write(sums.withColumnsRenamed({"_id": "_i", "_key": "_k"}))
    words = base.mapInArrow(by_pieces(count_words, "_text"), f"_id {kind}, _key long, n_words long")
    out = words.join(sums, (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_i")), "left")
    return out.select(F.col("_id").alias(id_col), "n_words", F.coalesce("n_backoffs", F.lit(0)).cast("long").alias("n_backoffs"), "log_score", (F.col("log_score") / F.col("n_words")).alias("mean_log_score"))
