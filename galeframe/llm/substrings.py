"""Operator 9, substring dedup: word spans that repeat anywhere are removed, found with suffix automata of reference shards.

A window is `window` consecutive words of one document; words covered by a window that also starts elsewhere go.
To split the work without losing a match, each window is assigned to its smallest 8-word gram (its anchor): equal
windows have equal anchors at equal places. Neighbouring windows with one anchor form a segment, a row of (document,
anchor, hash of the content, first word, number of windows).

1. Anchors are counted; a segment whose anchor stands only once can't repeat, and goes.
2. The others are counted by content. A content that stands twice repeats in full.
3. Anchors with several contents need a closer look, as these may agree in part. One copy of each such content, with its
   weight, is the reference text. It is sharded by anchor; each shard builds suffix automata over bounded portions and
   streams the contents of weight one through them for matching statistics: a window repeats if the state reached by its
   last `window` words occurs twice. Anchors with very many contents (a passage that a large share of the corpus holds)
   aren't gathered in one shard: their windows are counted by their hash, with the same result.
4. The spans of repeated windows are joined to the documents and removed.

Broadcasting the automata of all shards to all documents, as the method is usually told, costs shards x corpus; dealing
by anchor brings each automaton only the segments that can match it.

Defined results: null and empty texts have no words; rows that are repeated (equal id and text) are two documents that
hold the same words, so their windows go in both; extra columns are ignored. Contents and windows are told apart by 128
bits (anchor and content, or two hashes).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import by_pieces, row_key
from galeframe.llm.kernel import SPACE_WORDS, Texts, counts, grams, mix, sliding_min, valid_starts
from galeframe.llm.store import Work

U64 = np.uint64
GRAM = 8
#: Contents of one anchor that are still compared in one shard, words of one automaton, and words of a shard, about.
HOT_CONTENTS, AUTOMATON_WORDS, SHARD_WORDS = 256, 50_000, 1 << 18


class SuffixAutomaton:
    """Of several texts; each text occurs weight times."""

    def __init__(self, texts: list[list[int]], weights: list[int]):
        self.next, self.link, self.length = [{}], [-1], [0]
        ends = []
        for text in texts:
            at, path = 0, []
            for c in text:
                at = self._extend(at, c)
                path.append(at)
            ends.append(path)
        self.count = [0] * len(self.next)
        for path, w in zip(ends, weights, strict=True):
            for s in path:
                self.count[s] += w
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def _new(self, length: int, link: int, after: dict) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], self.next[q].copy())
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        cur, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return cur

    def repeats(self, text: list[int], window: int) -> list[bool]:
        """For each window of text: does it occur twice or more? Streams the text; the match is held to the window."""
        nxt, link, length = self.next, self.link, self.length
        at, size, out = 0, 0, []
        for c in text:
            while at and c not in nxt[at]:
                at = link[at]
                size = length[at]
            at = nxt[at].get(c, 0)
            size = size + 1 if at else 0
            while at and length[link[at]] >= window:
                at = link[at]
            size = min(size, length[at])
            out.append(size >= window and self.count[at] >= 2)
        return out[window - 1 :]


class _Words:
    """Words of a batch and their hashes."""

    def __init__(self, texts):
        self.texts = t = Texts(texts, SPACE_WORDS)
        self.starts, self.ends, self.of = t.words()
        self.n = counts(self.of, t.n)
        self.first = np.cumsum(self.n) - self.n
        self.h = t.hashes(self.starts, self.ends)


def _segments(w: _Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows, anchor and content hash of each segment."""
    h = w.h
    ok = np.flatnonzero(valid_starts(w.of, window)) if len(h) >= window else np.zeros(0, np.int64)
    if not len(ok):
        return ok, ok, np.zeros(0, U64), np.zeros(0, U64)
    g = grams(h, GRAM)
    low = U64(0xFFFFFFFF)
    place = np.arange(len(g), dtype=U64)
    least = low - (sliding_min((g & ~low) | (low - place), window - GRAM + 1)[ok] & low)  # where the smallest gram stands, the last of equals
    cut = np.flatnonzero(np.concatenate([[True], (ok[1:] != ok[:-1] + 1) | (least[1:] != least[:-1])]))
    start, size = ok[cut], np.diff(np.append(cut, len(ok)))
    whole = grams(h, window, seed=1)
    content = grams(np.stack([whole[start], whole[start + size - 1], size.astype(U64)], axis=1).ravel(), 3)[::3]
    return start, size, mix(g[least[cut].astype(np.int64)]), content


def _match(table: pa.Table, window: int) -> tuple[np.ndarray, list]:
    """Runs the contents of a shard through automata over portions of whole anchors: rows, and their repeated windows."""
    anchor, weight = (table.column(c).to_numpy() for c in ("anchor", "weight"))
    words = [np.frombuffer(x.as_buffer(), U64) for x in table.column("words").combine_chunks()]
    order = np.lexsort((table.column("content").to_numpy(), anchor))
    cut = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1], [True]]))
    rows, found, held, load = [], [], [], 0

    def flush() -> None:
        texts = [words[i].tolist() for i in held]
        automaton = SuffixAutomaton(texts, [min(int(weight[i]), 2) for i in held])
        for i, text in zip(held, texts, strict=True):
            if weight[i] == 1 and (again := np.flatnonzero(automaton.repeats(text, window))).size:
                rows.append(i)
                found.append(again.tolist())
        held.clear()

    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        size = sum(len(words[i]) for i in order[lo:hi])
        if held and load + size > AUTOMATON_WORDS:
            flush()
            load = 0
        held += order[lo:hi].tolist()
        load += size
    if held:
        flush()
    return np.array(rows, np.int64), found


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, removed (spans of words, ends excluded) and kept (the other words, joined by one space), a row for each row of docs."""
    if window < GRAM:
        raise ValueError(f"a window has {GRAM} words at least")
    kind, work = docs.schema[id_col].dataType.simpleString(), Work(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_key"), F.col(text_col).alias("_text"))
    same_row = (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_i"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = _Words(batch.column(2))
        start, size, anchor, content = _segments(w, window)
        of = w.of[start]
        row = pa.array(of)
        return pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(start - w.first[of], pa.int32()), pa.array(size, pa.int32())], names=["_id", "_key", "anchor", "content", "start", "size"])

    segments = base.mapInArrow(by_pieces(cut, "_text"), f"_id {kind}, _key long, anchor long, content long, start int, size int")
    # What is aggregated by a key is written before it is joined by it, so that the join can split a hot key over tasks.
    shared = work.write(segments.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1").select("anchor"))
    near = work.write(segments.join(shared, "anchor", "left_semi"))
    contents = work.write(near.groupBy("anchor", "content", "size").agg(F.count("*").alias("weight"), F.min(F.struct("_id", "_key", "start")).alias("at")))
    several = work.write(contents.groupBy("anchor").agg(F.count("*").alias("m"), F.min("weight").alias("least")).where("m > 1 and least = 1").drop("least"))
    closer = contents.join(several, "anchor")

    # The words of one copy of each content that needs a closer look.
    asked = closer.select(F.col("at._id").alias("_i"), F.col("at._key").alias("_k"), F.struct("anchor", "content", "weight", "m", "at.start", "size").alias("s")).groupBy("_i", "_k").agg(F.collect_list("s").alias("s"))
    texts = base.join(asked, same_row).dropDuplicates(["_i", "_k"]).select("_text", "s")

    def words_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, s = _Words(batch.column(0)), batch.column(1)
        flat = s.flatten()
        of = np.repeat(np.arange(len(s)), pa.compute.list_value_length(s).to_numpy(zero_copy_only=False))
        begin, size = w.first[of] + flat.field("start").to_numpy(), flat.field("size").to_numpy()
        words = pa.array([w.h[a : a + k + window - 1].tobytes() for a, k in zip(begin.tolist(), size.tolist(), strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([*(flat.field(c) for c in ("anchor", "content", "weight", "m")), words], names=["anchor", "content", "weight", "m", "words"])

    words = work.write(texts.mapInArrow(by_pieces(words_of, "_text"), "anchor long, content long, weight long, m long, words binary"))
    total = words.where(F.col("m") <= HOT_CONTENTS).agg(F.sum(F.length("words"))).first()[0] or 0

    def match(table: pa.Table) -> pa.Table:
        rows, found = _match(table, window)
        return pa.table([table.column("anchor").take(pa.array(rows)), table.column("content").take(pa.array(rows)), pa.array(found, pa.list_(pa.int32()))], names=["anchor", "content", "windows"])

    sharded = words.where(F.col("m") <= HOT_CONTENTS).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(max(4 * docs.sparkSession.sparkContext.defaultParallelism, 1 + total // (8 * SHARD_WORDS)))))
    partly = sharded.groupBy("shard").applyInArrow(match, "anchor long, content long, windows array<int>")

    def windows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        size = pa.compute.binary_length(batch.column(3)).to_numpy(zero_copy_only=False) // 8
        h = np.frombuffer(b"".join(x.as_py() for x in batch.column(3)), U64)
        of = np.repeat(np.arange(len(size)), size)
        at = np.flatnonzero(valid_starts(of, window)) if len(h) >= window else np.zeros(0, np.int64)
        row = pa.array(of[at])
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in range(3)), pa.array(at - (np.cumsum(size) - size)[of[at]], pa.int32()), *(pa.array(grams(h, window, seed=k)[at].view(np.int64)) for k in (1, 2))], names=["anchor", "content", "weight", "i", "w1", "w2"])

    # Dealt evenly first: a hot anchor's contents may lie in few files.
    hot = words.where(F.col("m") > HOT_CONTENTS).select("anchor", "content", "weight", "words").repartition("anchor", "content")
    hot = hot.mapInArrow(by_pieces(windows_of, "words"), "anchor long, content long, weight long, i int, w1 long, w2 long")
    again = work.write(hot.groupBy("w1", "w2").agg(F.sum("weight").alias("n")).where("n > 1").drop("n"))
    counted = hot.where("weight = 1").join(again, ["w1", "w2"]).groupBy("anchor", "content").agg(F.collect_set("i").alias("windows"))
    whole = contents.where("weight > 1").select("anchor", "content", F.lit(None).cast("array<int>").alias("windows"))
    repeated = work.write(whole.unionByName(partly).unionByName(counted))

    # Sets, as equal rows bring equal spans.
    spans = near.join(repeated, ["anchor", "content"]).groupBy("_id", "_key").agg(F.collect_set(F.struct("start", "size", "windows")).alias("spans"))
    spans = work.write(spans.withColumnsRenamed({"_id": "_i", "_key": "_k"}))
    work.drop(shared, near, contents, several, words, again, repeated)

    def remove(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, spans_ = _Words(batch.column(1)), batch.column(2)
        d = np.zeros(len(w.h) + 1, np.int64)
        for i in np.flatnonzero(spans_.is_valid().to_numpy(zero_copy_only=False)):
            for s in spans_[i].as_py():
                begin = w.first[i] + s["start"] + (np.arange(s["size"]) if s["windows"] is None else np.array(s["windows"]))
                np.add.at(d, begin, 1)
                np.add.at(d, begin + window, -1)
        gone = np.cumsum(d)[:-1] > 0
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(w.n, pa.int64()), pa.array(counts(w.of[gone], w.texts.n), pa.int64()), _word_spans(gone, w), _join(w, ~gone)], names=[id_col, "n_words", "n_removed", "removed", "kept"])

    out = base.join(spans, same_row, "left").select("_id", "_text", "spans")
    return out.mapInArrow(by_pieces(remove, "_text"), f"`{id_col}` {kind}, n_words long, n_removed long, removed array<array<int>>, kept string")


def _word_spans(gone: np.ndarray, s: _Words) -> pa.Array:
    """Runs of removed words of each text."""
    first = np.cumsum(s.n) - s.n
    edge = np.ones(len(gone), bool)
    edge[1:] = gone[1:] != gone[:-1]
    edge[first[s.n > 0]] = True
    cut = np.flatnonzero(edge)
    end = np.append(cut[1:], len(gone)) if len(cut) else cut
    on = gone[cut] if len(cut) else np.zeros(0, bool)
    cut, end = cut[on], end[on]
    of = s.of[cut] if len(cut) else cut
    flat = np.stack([cut - first[of], end - first[of]], axis=1).astype(np.int32).ravel() if len(cut) else np.zeros(0, np.int32)
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2, dtype=np.int32)), pa.array(flat))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts(of, s.texts.n))]).astype(np.int32)), inner)


def _join(s: _Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    a, b, of = s.starts[keep], s.ends[keep], s.of[keep]
    size = b - a + 1  # with the space after
    total = np.cumsum(size)
    at = np.repeat(a - (total - size), size) + np.arange(total[-1] if len(total) else 0)
    data = s.texts.padded[at]
    if len(total):
        data[total - 1] = 32
    per = np.bincount(of, size, s.texts.n).astype(np.int64)
    stop = np.cumsum(per)
    mask = np.ones(len(data), bool)
    mask[stop[per > 0] - 1] = False  # no space after the last word
    ends = np.concatenate([[0], np.cumsum(np.maximum(per - 1, 0))])
    return pa.Array.from_buffers(pa.large_string(), s.texts.n, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data[mask].tobytes())]).cast(pa.string())
