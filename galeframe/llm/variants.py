"""Spelling variants by anagram hashing.

A letter has the fifth power of its code point as value and a word the sum of its letters' values as key (modulo 2^64),
so anagrams share a key, and words one edit apart have keys that differ by the value of a letter (one more or one less)
or by the difference of two (one exchanged). Both sides of such a pair meet at the key that is left without the letter
in question: a word is sent to its own key, and to its key less the value of each of its letters. That is a row for each
letter, not one for each letter of the alphabet.

Anagrams of a bag of letters can be many, so the letters' order is verified in two steps. The rest of the word once the
letter is gone is thought to be cut in PARTS parts; the edit lies in one of them and the others are alike on both sides,
so a hash of these others belongs to the join key and only words alike outside one part ever meet. What meets is then
compared letter by letter. A pair that meets at several parts counts in the first. Nothing holds a group: pairs stream
from a join into a partial aggregate that keeps, for each word, the number of near words and the best one. All joins are
by merging: both sides grow with the corpus, and none may be broadcast through the driver.

Defined cases: NULL and empty texts have no words; a NULL id is written as nothing where an id is part of a key; words
of any length are taken whole; equal counts are decided by code-point order; repeated rows count once each; an empty
table has no words. Further columns of the input aren't read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import pieces
from galeframe.llm.store import Work

#: Letters of a word; only A-Z are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
LOWER = {c: c + 32 for c in range(65, 91)}
#: Parts that a word is cut in to verify the order of its letters.
PARTS = 4
#: Distinct words, and letters of them, that a task counts before it hands them on.
MOST_WORDS, MOST_LETTERS = 200_000, 16 << 20


def typo(key: str, word: str, one_in: int = 97) -> str:
    """The word, or for one key in so many the word without one letter; which is decided by the CRC-32 of the key."""
    h = zlib.crc32(key.encode())
    if h % one_in:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, change: Callable[[str, str], str] | None = None) -> DataFrame:
    """(word, n): how often each run of letters with at least least_length of them occurs. change(id:run, run) may alter a run first, though not lengthen it."""
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        letters = 0

        def taken() -> pa.RecordBatch:
            words = sorted(found)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([found[w] for w in words], pa.int64())], ["word", "n"])

        for batch in batches:
            for piece in pieces(batch, "text"):
                for key, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    in_text: Counter = Counter()
                    for run, n in Counter(runs.findall(text or "")).items():
                        in_text[run.lower() if run.isascii() else run.translate(LOWER)] += n
                    for word, n in in_text.items():
                        if change:
                            word = change(f"{key}:{word}", word)
                        if len(word) >= least_length:
                            if word not in found:
                                letters += len(word)
                            found[word] += n
                    if len(found) > MOST_WORDS or letters > MOST_LETTERS:
                        yield taken()
                        found.clear()
                        letters = 0
        yield taken()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def value(letter: str) -> int:
    return ord(letter) ** 5


def signed(x: int) -> int:
    """x modulo 2^64 as a signed number."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def meeting_places(word: str, parts: int = PARTS) -> Iterator[tuple[int, int, int, str]]:
    """(key, place, tail, letter): the keys that a word is sent to, without a letter or (letter '') whole.

    place is a hash of the part's number and of what stands before and after that part; tail is the number of letters
    from the part's beginning to the end of what is left, -1 for the first part.
    """
    whole, n = sum(value(c) * k for c, k in Counter(word).items()), len(word)
    for gone in (0, 1):
        left = n - gone
        for j in range(parts):
            a, b = j * left // parts, (j + 1) * left // parts
            place = signed((zlib.crc32(word[:a].encode(), j) << 32) | zlib.crc32(word[b + gone :].encode(), left & 0xFFFFFFFF))
            if gone:
                for c in set(word[a : b + 1]):
                    yield signed(whole - value(c)), place, left - a if j else -1, c
            else:
                yield signed(whole), place, left - a if j else -1, ""


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for each ordered pair of words that differ by one inserted, deleted or replaced code point. words: (word, n), distinct."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                rows = [(*place, w, n) for w, n in zip(batch.column(0).slice(at, 5000).to_pylist(), batch.column(1).slice(at, 5000).to_pylist(), strict=True) for place in meeting_places(w)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names, kinds = ["key", "place", "tail", "letter", "word", "n"], [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64()]
    sent = words.select("word", "n").mapInArrow(send, "key long, place long, tail int, letter string, word string, n long")
    # A word is some twenty rows here, of which its file's size tells nothing: by that size they would be broadcast.
    met = sent.alias("a").join(sent.alias("b").hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.place") == F.col("b.place")) & (F.col("a.letter") != F.col("b.letter")) & (F.col("a.tail") == F.col("b.tail")))
    # Alike from the part's beginning too: then the pair met at the part before.
    first = (F.col("a.tail") < 0) | (F.right(F.col("a.word"), F.col("a.tail")) != F.right(F.col("b.word"), F.col("b.tail")))
    found = met.where(first & (F.levenshtein("a.word", "b.word", 1) == 1))
    return found.select(F.col("a.word").alias("word"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))


def roots(forms: DataFrame, work: Work) -> DataFrame:
    """(word, root): where following the forms from word to word ends. forms: (word, form), without circles. The steps double each time."""
    now = work.write(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        new = work.write(now.join(on.hint("merge"), F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        work.drop(now)
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, ratio: int = 2, work: Work | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of the distinct words (word, n).

    near words differ by exactly one code point; a word's form is the near word that occurs most, if at least ratio
    times as often as the word; its root is where forms lead to.
    """
    work = work or Work(words.sparkSession)
    words = work.write(words.select("word", "n"))
    best = near_pairs(words).groupBy(F.col("word").alias("_word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    told = words.join(best.hint("merge"), F.col("word") == F.col("_word"), "left")
    is_form = -F.col("b.m") >= ratio * F.col("n")
    told = work.write(told.select("word", F.when(is_form, F.col("b.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("b.m")).alias("form_n")))
    ends = roots(told.where("form is not null").select("word", "form"), work)
    return told.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
