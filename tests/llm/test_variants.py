"""Anagram hashing against all pairs of words."""

import collections
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from galeframe.llm import variants
from tests.llm import brute


def one_edit(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    if len(u) > len(v):
        u, v = v, u
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def plain(words, ratio=2):
    """{word: (form, root, n, near words, n of the form)}"""
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def counted(rows, least=5, typo=True):
    c = collections.Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{w}".encode())
            if typo and h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                c[w] += 1
    return c


def found(spark, words):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants.spelling_variants(df).collect()}


@settings(max_examples=300, deadline=None)
@given(st.text("abcé", min_size=1, max_size=9), st.integers(0, 8), st.sampled_from("abcé"), st.sampled_from(["insert", "delete", "replace"]))
def test_words_an_edit_apart_meet(word, at, letter, how):
    at %= len(word)
    other = {"insert": word[:at] + letter + word[at:], "delete": word[:at] + word[at + 1 :], "replace": word[:at] + letter + word[at + 1 :]}[how]
    if other and other != word:
        a, b = ({(k, p, t): c for k, p, t, c in [*variants.meeting_places(w)]} for w in (word, other))
        assert any(a[x] != b[x] for x in a.keys() & b.keys())


def test_counts_are_the_plain_ones(spark):
    rows = brute.corpus(3, 200) + [(9000 + i, f"Straße ÉTUDE étude x{i}y abcdé Wörter_wörter {'m' * 3000}", "en", "s", 1) for i in range(150)]
    want = counted(rows)
    df = brute.clashing(brute.frame(spark, rows).repartition(3))
    got = variants.word_counts(df, change=variants.typo).collect()
    assert {r["word"]: r["n"] for r in got} == want and len(got) == len(want)
    assert {r["word"]: r["n"] for r in variants.word_counts(df, least_length=3).collect()} == counted(rows, 3, typo=False)
    assert variants.word_counts(df.where("false")).count() == 0


def test_variants_are_the_plain_ones(spark):
    r = random.Random(1)
    words = {"".join(r.choice("abcé") for _ in range(r.randint(1, 7))): r.choice([3, 5, 6, 10, 12, 40, 100, 1000]) for _ in range(900)}
    words |= {"aabbaab": 9, "aabaab": 20, "aabbaa": 20, "thier": 3, "their": 500, "theirs": 40, "z" * 4000: 3, "z" * 4001: 8, "z" * 2000 + "y" + "z" * 2000: 16}
    assert found(spark, words) == plain(words)


def test_forms_are_followed_to_the_end(spark):
    words = {"a" * k: 3 * 2**k for k in range(1, 30)} | {"lonely": 4}
    got = found(spark, words)
    assert got == plain(words)
    assert {v[1] for w, v in got.items() if w != "lonely"} == {"a" * 29}
    assert found(spark, {"alone": 3}) == {"alone": (None, "alone", 3, 0, None)}
    assert variants.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_no_join_goes_through_the_driver(spark, tmp_path):
    """A small file of words is many more rows where words meet; and a larger corpus has larger tables at every join."""
    spark.createDataFrame([("their", 500), ("thier", 3), ("there", 40)], "word string, n long").write.parquet(str(tmp_path / "words"))
    words = spark.read.parquet(str(tmp_path / "words"))
    for df in (variants.near_pairs(words), variants.spelling_variants(words)):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
