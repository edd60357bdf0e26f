"""The Merkle manifest against trees built in plain Python."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from galeframe.llm import manifest
from tests.llm import brute


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    d = dict(zip(("doc_id", "text", "lang", "source", "n_chars"), row, strict=True))
    return h(*["-" if d[c] is None else f"{len(str(d[c]).encode())}:{d[c]}" for c in manifest.FIELDS])


def tree(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def path(levels, i, arity):
    out = []
    for nodes in levels[:-1]:
        first = i // arity * arity
        run = nodes[first : first + arity]
        out.append((run[: i - first], run[i - first + 1 :]))
        i //= arity
    return out


def plain(rows, arity, wrong=lambda row: row):
    """A bag of (id, leaf, subroot, root, digest of the proof, folded root)."""
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append(tree([leaf(r) for r in groups[g]], arity))
    top = tree([t[-1][0] for t in trees], arity)
    out = collections.Counter()
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps, at = path(trees[k], i, arity) + path(top, k, arity), leaf(wrong(r))
            for before, after in steps:
                at = h(*before, at, *after)
            out[(r[0], leaf(r), trees[k][-1][0], top[-1][0], h(*[x for b, a in steps for x in b + a]), at)] += 1
    return out


def found(df, **settings):
    got = manifest.verify(manifest.manifest(df, **settings)).withColumn("p", manifest.proof_digest(F.col("proof"))).collect()
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got)
    return collections.Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["p"], r["folded_root"]) for r in got)


ROWS = [(*r[:2], lang, *r[3:]) for r, lang in zip(brute.corpus(), ["en", "en", "fr", None, "é", "", "en"] * 20, strict=False)]


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest_is_the_plain_one(spark, arity):
    df = brute.clashing(brute.frame(spark, ROWS))
    got = found(df, arity=arity)
    assert got == plain(ROWS, arity)
    assert {root for _, _, _, root, _, _ in got} == {root for _, _, _, _, _, root in got}


def test_a_claim_that_differs_is_not_verified(spark):
    df = brute.frame(spark, ROWS)
    more = manifest.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")), F.col("text"))
    wrong = lambda r: (*r[:4], r[4] + 1) if r[0] is not None and r[0] % 5 == 0 else r
    got = found(df, claimed=more)
    assert got == plain(ROWS, 2, wrong)
    assert {i for i, _, _, root, _, folded in got if root != folded} == {r[0] for r in ROWS if r[0] is not None and r[0] % 5 == 0}


def test_every_number_of_leaves(spark):
    for n in (1, 2, 3, 5, 8, 9):
        rows = [(i, f"t{i}", "en", None, None) for i in range(n)]
        assert found(brute.frame(spark, rows)) == plain(rows, 2)
    rows = [(7, "same", "en", "s", 4)] * 6 + [(None, None, None, None, None)] * 3
    assert found(brute.frame(spark, rows)) == plain(rows, 2)
    assert manifest.verify(manifest.manifest(brute.frame(spark, []))).count() == 0
