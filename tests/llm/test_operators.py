"""Each operator against its plain version, on documents that are hard on it."""

import collections
import hashlib
import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galeframe.llm import chat, components, decontaminate, extract, html_tree, jaccard, kernel, lines, lm, mixing, page_samples, quality, queries, substrings, urls
from galeframe.llm.store import Work
from tests.duck import assert_same, connect
from tests.llm import brute

SF = "/root/testdata/sf0.001"
ROWS = brute.corpus()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def docs(spark):
    return brute.frame(spark, ROWS)


def bag(df):
    return collections.Counter(map(str, map(tuple, df.collect())))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_are_their_sql(spark, con, name):
    assert_same(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_other_queries_have_a_row_for_each_row(spark, con, name):
    table = "pages" if name[:4] in ("op5_", "op7_") else "documents"
    assert queries.QUERIES[name](spark, SF).count() == con.execute(f"select count(*) from {table}").fetchone()[0]


# kernel


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \n\tabA#é0", max_size=40)), max_size=6))
def test_words_and_hashes(texts):
    for kind, plain in ((kernel.SPACE_WORDS, brute.words), (kernel.ALNUM_WORDS, brute.alnum)):
        t = kernel.Texts(pa.array(texts, pa.string()), kind)
        s, e, of = t.words()
        want = [(i, w) for i, x in enumerate(texts) for w in plain(x)]
        assert of.tolist() == [i for i, _ in want]
        h = t.hashes(s, e).tolist()
        assert len(set(h)) == len({w for _, w in want}) and all((a == b) == (x[1] == y[1]) for a, x in zip(h, want, strict=True) for b, y in zip(h, want, strict=True))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 9))
def test_grams_and_minima(xs, k):
    h = np.array(xs, dtype=np.uint64)
    g = kernel.grams(h, k).tolist()
    runs = [tuple(xs[i : i + k]) for i in range(len(xs) - k + 1)]
    assert len(g) == len(runs) and all((a == b) == (p == q) for a, p in zip(g, runs, strict=True) for b, q in zip(g, runs, strict=True))
    if runs:
        assert kernel.sliding_min(h, k).tolist() == [min(r) for r in runs]


def test_slices_and_chunks():
    a = pa.chunked_array([pa.array(["x y", "z"]), pa.array(["x"])])
    t = kernel.Texts(a)
    assert t.words()[2].tolist() == [0, 0, 1, 2]
    assert kernel.Texts(pa.array(["skip", "a b"]).slice(1)).words()[2].tolist() == [0, 0]


# 1


def test_mixing_edges(spark, docs):
    assert mixing.mix(docs.limit(0)).count() == 0
    kept = mixing.mix(brute.clashing(docs), keep_columns=True)
    assert kept.columns == [*brute.clashing(docs).columns, "mix_slot", "mix_in_block"] and kept.count() == len(ROWS)
    assert mixing.mix(docs).count() == len(ROWS)
    with pytest.raises(ValueError, match="positive"):
        mixing.mix(docs, {"a": 0})
    with pytest.raises(ValueError, match="digits"):
        mixing.mix(docs, {"src0": 1e-9, "src1": 1e9})


def fluid(sizes, weights):
    """{(source, block): (when its fluid share begins, when it ends)}, from one source's end to the next."""
    left, now, served, out = dict(sizes), Fraction(0), {s: Fraction(0) for s in sizes}, {}
    while left:
        total = sum(weights[s] for s in left)
        step = min((sizes[s] - served[s]) * total / weights[s] for s in left)
        for s in left:
            rate = weights[s] / total
            for j in range(math.floor(served[s]), math.ceil(served[s] + step * rate)):
                begin, end = out.get((s, j), (now + (j - served[s]) / rate, None))
                out[s, j] = (begin, now + (j + 1 - served[s]) / rate)
            served[s] += step * rate
        now += step
        left = {s: 0 for s in left if served[s] < sizes[s]}
    return out


@pytest.mark.parametrize("weights", [{"src0": 3.0, "src1": 2.0}, {"src0": 0.75, "src1": 0.1, "src2": 2.5}, {}])
def test_mixing_keeps_the_given_weights(spark, weights):
    sizes = {"src0": 90, "src1": 41, "src2": 13, "src3": 30, "src4": 1, "": 8}
    rows = [(i, "t", "en", s or None, 0) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mixing.mix(brute.frame(spark, rows), weights, block_rows=1).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(rows))) and sorted(r["slot"] for r in got) == list(range(len(rows)))
    want = {k: (math.floor(a), math.ceil(b)) for k, (a, b) in fluid(sizes, {s: Fraction(str(weights.get(s, 1))) for s in sizes}).items()}
    assert {(r["source"], r["block"]): (r["release"], r["deadline"]) for r in got} == want
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)


def test_mixing_is_the_slot_by_slot_schedule(spark):
    sizes, weights = {"a": 35, "b": 12, "": 5, "c": 1, "d": 12}, {"a": 9, "b": 6}
    rows = [(i, "t", "en", s or None, 0) for i, s in enumerate(s for s, n in sizes.items() for _ in range(2 * n))]
    got = {(r["source"], r["block"]): r["slot"] for r in mixing.mix(brute.frame(spark, rows), {"a": 4.5, "b": 3.0}, default_weight=0.5, block_rows=2).collect()}
    w = {s: weights.get(s, 1) for s in sizes}
    windows = fluid(sizes, {s: Fraction(x) for s, x in w.items()})
    waiting = {k: (math.ceil(b), w[k[0]], k[1], hashlib.md5(k[0].encode()).hexdigest(), math.floor(a)) for k, (a, b) in windows.items()}
    want = {}
    for slot in range(sum(sizes.values())):
        pick = min((v, k) for k, v in waiting.items() if v[-1] <= slot)[1]
        want[pick] = slot
        del waiting[pick]
    assert got == want


@pytest.mark.parametrize("n", [1, 20, 2000])
def test_mixing_is_less_than_a_block_off_the_target_weights(spark, n):
    # So many documents that no source runs out before its share of 12 n blocks.
    w = {f"src{i}": {0: 3, 1: 2}.get(i, 1) for i in range(n)}
    total = sum(w.values())
    rows = spark.range(36 * n if n < 100 else 4 * n).select(F.col("id").alias("doc_id"), F.concat(F.lit("src"), F.col("id") % n).alias("source"))
    order = [r["source"] for r in mixing.mix(rows, {"src0": 3.0, "src1": 2.0}, block_rows=1).orderBy("slot").collect()]
    seen, until = collections.Counter(), (12 if n < 100 else 1) * total
    for t, s in enumerate(order[:until], 1):
        seen[s] += 1
        if n < 100 or t % 97 == 0:
            assert all(abs(seen[x] * total - t * k) < total for x, k in w.items())


def test_mixing_keeps_a_large_share_among_many_sources(spark):
    """0.9 against 500 sources that share 0.1."""
    rows = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 8000, F.lit("big")).otherwise(F.concat(F.lit("s"), F.col("id") % 500)).alias("source"))
    got = mixing.mix(rows, {"big": 4500.0}, block_rows=1).where("slot < 8000").groupBy().agg(F.avg((F.col("source") == "big").cast("int"))).first()[0]
    assert abs(got - 0.9) < 0.001


def test_mixing_takes_any_number_of_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 5)
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, F.concat(F.lit("src"), F.col("id") % 2)).otherwise(F.concat(F.lit("site"), F.col("id") % 2500)).alias("source"))
    got = mixing.mix(rows, {"src0": 3.0, "src1": 2.0}, block_rows=1).collect()
    assert sorted(r["slot"] for r in got) == list(range(6000)) and all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    seen = collections.Counter(r["source"] for r in got if r["slot"] < 2505)
    assert (seen["src0"], seen["src1"], len(seen)) == (3, 2, 2502)


# 2


def test_statistics_and_base_rules(docs):
    got = quality.judge(docs, None).collect()
    assert len(got) == len(ROWS)
    want = collections.Counter((r[0], *brute.stats(r[1]).values()) for r in ROWS)
    assert collections.Counter((r["doc_id"], *(r[k] for k in brute.stats(""))) for r in got) == want
    assert all(r["kept"] == (not r["base_failed"]) and r["quality"] is None for r in got)


def test_trees_are_monotone_and_flat(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, 2))
    y = (x[:, 0] + rng.normal(0, 0.2, 600) < 0.5).astype(float)
    m = quality.fit_trees(x, y, [-1, 0], trees=30)
    line = np.stack([np.linspace(0, 1, 100), np.full(100, 0.5)], axis=1)
    assert (np.diff(m.margin(line)) <= 1e-12).all()

    def walk(node, row):
        while m.left[node] != node:
            node = m.left[node] if row[m.feature[node]] <= m.threshold[node] else m.right[node]
        return m.value[node]

    assert m.margin(x[:50]) == pytest.approx([m.base + sum(walk(r, row) for r in m.roots) for row in x[:50]])
    assert quality.fit_trees(x, np.ones(600), [0, 0]) is None


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    d, y = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(d, y.where("doc_id % 2 = 0"))
    got = quality.judge(d, model).withColumnRenamed("quality", "p").join(y.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").select("kept", "quality").toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.95
    assert got[got.quality == 1].kept.mean() > 0.97


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels) is None and quality.train(docs.limit(0), labels) is None
    kept = quality.keep(brute.clashing(docs), None)
    assert kept.columns == brute.clashing(docs).columns
    assert bag(kept.select("doc_id", "text")) == collections.Counter(str((r[0], r[1])) for r in ROWS if not brute.stats(r[1])["base_failed"])
    assert quality.judge(docs.limit(0), None).count() == 0


def test_quality_takes_one_text_of_an_id(spark):
    rows = [(i % 40, brute.prose(random.Random(i), 40) + (" ###" * 9 if i % 2 else ""), "en", "s", 0) for i in range(80)]
    labels = spark.createDataFrame([(i % 40, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    docs = brute.frame(spark, rows)
    a, b = quality.train(docs, labels), quality.train(docs.unionAll(docs).unionAll(docs), labels)
    assert a is not None and np.array_equal(a.value, b.value)


# 3


def test_chat_takes_a_long_conversation_and_null_turns(spark):
    rows = [(k, i, "user" if i % 2 else "assistant", None if i == 3 else f"t{i}" * 50 + ("x" if k and i == 3999 else "")) for k in (0, 1) for i in range(4000)] + [(0, None, "user", "first")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = chat.preference_pairs(t, F.lit(0), F.col("conv_id") == 0).first()
    assert (r["n_common"], r["rejected_id"]) == (0, 1) and r["chosen"].startswith("<|im_start|>user\nfirst<") and len(r["rejected_mask"]) == 2000


def test_chat_pairs(spark):
    rows = [(0, 0, "system", "s"), (0, 1, "user", "q"), (0, 2, "assistant", "good"), (1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "bad"), (1, 3, "user", "é"), (1, 3, "user", "é"), (2, 0, None, None), (4, 0, "user", "x"), (5, 0, "user", "x"), (None, 0, "user", "z")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit("clash"))
    conv = F.col("conv_id")
    got = {r["pair_id"]: r for r in chat.preference_pairs(t, F.floor(conv / 2), conv % 2 == 0).collect()}
    a = got[0]
    assert (a["n_common"], a["prompt"]) == (2, "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n")
    assert a["rejected"] == "<|im_start|>assistant\nbad<|im_end|>\n<|im_start|>user\né<|im_end|>\n"
    assert [a["chosen"][m["start"] : m["end"]] for m in a["chosen_mask"]] == ["good<|im_end|>\n"]
    assert [a["rejected"][m["start"] : m["end"]] for m in a["rejected_mask"]] == ["bad<|im_end|>\n"]
    assert (got[1]["rejected_id"], got[1]["rejected"], got[1]["chosen"]) == (None, None, "<|im_start|>user\n<|im_end|>\n")
    assert (got[2]["n_common"], got[2]["chosen"], got[2]["rejected"]) == (1, "", "")
    assert len(got) == 3 and chat.preference_pairs(t.limit(0), F.floor(conv / 2), conv % 2 == 0).count() == 0


# 4


@pytest.mark.parametrize("window", [1, 2, 3])
def test_line_dedup(spark, docs, window):
    want = brute.dedup_lines(ROWS, window)
    got = lines.dedup_lines(brute.clashing(docs), window).collect()
    expected = collections.Counter((r[0], *(want[r[0], r[1]] if r[1] is not None else (None, 0))) for r in ROWS)
    assert collections.Counter((r["doc_id"], r["text"], r["n_deleted"]) for r in got) == expected
    assert sum(r["n_deleted"] for r in got) > 0


def test_line_dedup_edges(spark, docs):
    assert lines.dedup_lines(docs.limit(0)).count() == 0
    two = brute.frame(spark, [(1, "a b\nc d", "en", "s", 0), (2, "a b\nc d", "en", "s", 0), (3, "a b\n\nc d\n", "en", "s", 0), (4, "x", "en", "s", 0), (5, "", "en", "s", 0)])
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(two).collect()} == {1: "a b\nc d", 2: "", 3: "\n", 4: "x", 5: ""}
    assert sorted(r["doc_id"] for r in lines.dedup_lines(two, drop_emptied=True).collect()) == [1, 4, 5]
    with pytest.raises(ValueError, match="window"):
        lines.dedup_lines(docs, 0)


def test_single_lines_leaves_no_repeated_line(spark, tmp_path):
    passage = "a passage " * 30
    rows = [(1, "x\nlicence\ny", "en", "s", 0), (2, "z\nlicence\n\nv", "en", "s", 0), (3, passage, "en", "s", 0), (4, passage, "en", "s", 0), (5, f"w\n{passage}\nw", "en", "s", 0)]
    brute.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["n_deleted"] for r in queries.QUERIES["op4_line_dedup"](spark, str(tmp_path)).collect()} == dict.fromkeys(range(1, 6), 0)
    want = brute.dedup_lines(rows, 1)
    got = {r["doc_id"]: (r["n_deleted"], r["kept_sha256"]) for r in queries.QUERIES["op4_single_lines"](spark, str(tmp_path)).collect()}
    assert got == {r[0]: (want[r[0], r[1]][1], hashlib.sha256(want[r[0], r[1]][0].encode()).hexdigest()) for r in rows}
    assert [got[k][0] for k in range(1, 6)] == [0, 1, 0, 1, 2]


# 5


def test_urls(spark):
    want = {
        "http://A.Example.ORG/es/1": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "http://example.org/en/12?x": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org/en/2#x": ("example.org", "/en/2", "org/", "allow"),
        "http://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"),
        "http://example.org": ("example.org", "", None, "allow"),
        "http://x.com/fr/1": ("x.com", "/fr/1", "com/fr/", "allow"),
        "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
        "http://x.com?u=http://y.org/": ("x.com", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    p = spark.createDataFrame(list(enumerate(want)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    mined = urls.mine(p, spark.createDataFrame([], "doc_id long, quality int, toxic int"), F.col("page_id"))
    got = urls.judge(p, mined).collect()
    assert [tuple(r)[1:5] for r in sorted(got, key=lambda r: r["page_id"])] == list(want.values())
    assert urls.judge(p.limit(0), mined).count() == 0
    twice = urls.judge(p.unionAll(p), mined).collect()
    assert collections.Counter(map(tuple, twice)) == collections.Counter([*map(tuple, got)] * 2)


LABELS = "doc_id long, quality int, toxic int"


def test_rules_are_mined_pruned_and_matched(spark):
    pages = [(i, f"http://{'pills' if i < 20 else 'news'}.net/{'buy' if i % 2 else 'read'}/{i}") for i in range(60)]
    labels = [(i, 0 if i < 18 else 1, 0) for i in range(50)] + [(None, 0, 0)]
    p, y = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, LABELS)
    mined = urls.mine(p, y, F.col("page_id"), min_confidence=0.8)
    rules = {tuple(r["rule"]): r for r in mined.rules.collect()}
    # host=pills.net and name=pills stand on the same pages and are one token.
    assert rules[("host=pills.net",)]["confidence"] == pytest.approx(0.9) and rules[("host=pills.net",)]["n"] == 18
    assert {r["item"] for r in mined.tokens.collect() if r["token"] == "host=pills.net"} == {"host=pills.net", "name=pills"}
    assert all(r["confidence"] >= 0.8 and r["n"] >= 5 for r in rules.values())
    assert all(len(k) == 1 or r["confidence"] > 0.9 for k, r in rules.items())
    more = spark.createDataFrame([(99, "http://www.pills.org.uk/"), (98, None)], "page_id long, url string")
    assert {r["page_id"] for r in urls.judge(p.unionAll(more), mined).where("verdict = 'block'").collect()} == {*range(20), 99}


def every_rule(rows, confidence, least):
    """All valid combinations of items of the bad rows that are surer than their valid parts: by brute force."""
    sets = {c for items, bad in rows if bad for k in range(1, len(items) + 1) for c in itertools.combinations(sorted(items), k)}
    sure = {}
    for c in sets:
        held = [bad for items, bad in rows if set(c) <= set(items)]
        if sum(held) >= least and sum(held) / len(held) >= confidence:
            sure[c] = sum(held) / len(held)
    return {c for c, x in sure.items() if all(sure.get(d, 0) < x for k in range(1, len(c)) for d in itertools.combinations(c, k))}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rules_fit_what_all_combinations_fit(spark, seed):
    r = np.random.default_rng(seed)
    hosts, words = ["a.x", "b.x", "c.y"], ["red", "blue", "old", "new", "free"]
    pages = [(i, f"http://{hosts[r.integers(3)]}/" + "/".join(w for w in words if r.random() < 0.4)) for i in range(90)]
    bad = [int("/red" in u and "/old" in u or "c.y/" in u and "blue" in u or r.random() < 0.15) for _, u in pages]
    p = spark.createDataFrame(pages, "page_id long, url string")
    y = spark.createDataFrame([(i, 1 - b, 0) for i, b in enumerate(bad)][:70], LABELS)
    items = {x["page_id"]: x["i"] for x in p.select("page_id", urls.items_of(urls.host_of(F.col("url")), urls.path_of(F.col("url"))).alias("i")).collect()}
    rules = every_rule([(items[i], bad[i]) for i in range(70)], 0.6, 4)
    assert rules and max(map(len, rules)) > 1
    mined = urls.mine(p, y, F.col("page_id"), min_confidence=0.6, min_support=0, least=4, alpha=None)
    blocked = {x["page_id"] for x in urls.judge(p, mined, rules=[]).where("verdict = 'block'").collect()}
    assert blocked == {i for i, x in items.items() if any(set(c) <= set(x) for c in rules)}


def test_common_words_of_few_urls_are_no_burden(spark):
    common = "/".join(f"w{k:c>2}" for k in range(25))
    pages = [(i, f"http://h{i}.net/{common}") for i in range(6)] + [(i, f"http://h{i}.net/other{i % 9}") for i in range(6, 90)] + [(90, f"http://h90.net/{common}")]
    p = spark.createDataFrame(pages, "page_id long, url string")
    for labelled in (90, 91):  # with 91, a good page has the words too
        y = spark.createDataFrame([(i, int(i > 5), 0) for i in range(labelled)], LABELS)
        mined = urls.mine(p, y, F.col("page_id"))
        assert [r["rule"] for r in mined.rules.collect()] == [["path=w10"]] and mined.tokens.count() == 25


def test_labels_by_chance_give_no_rule(spark):
    r = np.random.default_rng(5)
    p = spark.createDataFrame([(i, f"http://h{r.integers(40)}.net/{'/'.join(f'w{k}' for k in r.integers(0, 30, 3))}") for i in range(1500)], "page_id long, url string")
    y = spark.createDataFrame([(i, int(r.random() < 0.6), 0) for i in range(1500)], LABELS)
    assert urls.mine(p, y, F.col("page_id")).rules.count() == 0
    assert urls.mine(p, y, F.col("page_id"), alpha=None).rules.count() > 0


def test_the_number_of_the_document_that_a_url_shows(spark):
    want = {"http://a.b/en/7817?x=1": 7817, "http://a.b/fr/7424.html": 7424, "http://a.b/de/12/": 12, "http://a.b/en/1#top": 1, "http://a.b/en/1x": 1, "http://a.b/12": None, None: None, "": None, "http://a.b/en/" + "9" * 30: None}
    u = spark.createDataFrame([(x,) for x in want], "url string")
    assert [r[0] for r in u.select(urls.document_of(F.col("url"))).collect()] == list(want.values())


# 6


@pytest.mark.parametrize("slot", [1024, 4])
def test_jaccard_join_finds_all_links(spark, monkeypatch, slot):
    monkeypatch.setattr(jaccard, "SLOT_CLASSES", slot)
    rows = [r for r in brute.corpus(3, 120) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(brute.clashing(brute.frame(spark, rows))).collect()}
    assert got == brute.jaccard_groups(rows)
    assert max(n for _, n in got.values()) >= 3


def test_one_document_of_each_group_stays(spark, docs):
    kept = jaccard.one_of_each(brute.clashing(docs))
    assert kept.columns == brute.clashing(docs).columns
    rows = kept.select("doc_id", "text").collect()
    wordless = sum(not brute.words(r[1]) for r in ROWS) - 1  # row 0 is there twice
    assert sum(not brute.words(r["text"]) for r in rows) == wordless
    left = [(i, r["text"], "", "", 0) for i, r in enumerate(rows) if brute.words(r["text"])]
    assert all(n == 0 for _, n in brute.jaccard_groups(left).values())
    assert len({brute.shingles(r[1]) for r in left}) == len(left)
    assert jaccard.one_of_each(docs.limit(0)).count() == 0


def test_bands_follow_from_the_recall():
    b = jaccard.bands_for(0.8, 0.9999, 5)
    assert 1 - (1 - 0.8**5) ** b >= 0.9999 > 1 - (1 - 0.8**5) ** (b - 1)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 9), (50, 50), (200, 150), (150, 300), (300, 200)]
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(edges, "a long, b long"), Work(spark)).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 3: 3, 7: 3, 9: 3, 150: 150, 200: 150, 300: 150}
    assert components.components(spark.createDataFrame([], "a long, b long"), Work(spark)).count() == 0


# 7


@pytest.fixture(scope="module")
def model():
    return extract.train_model()


def test_extraction_on_held_out_pages(model):
    right = 0
    for html in page_samples.labelled(150, seed=31):
        gold = " ".join(t.replace(page_samples.MAIN, "").strip() for _, t, _ in html_tree.Page(html).blocks if page_samples.MAIN in t)
        right += extract.main_texts(model, [html.replace(page_samples.MAIN, "").replace(page_samples.REST, "")])[0] == gold
    assert right >= 143


def test_extraction_of_the_pages_table(spark, model):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        a = r["html"].find("<article>")
        b = r["html"].find("</article>")
        gold = " ".join(t for _, t, _ in html_tree.Page(r["html"][a : b if b > 0 else None]).blocks)
        assert extract.main_texts(model, [r["html"]])[0] == gold


def test_messages_are_exact_marginals(model):
    pages = [html_tree.Page("<body><nav><a href=x>a</a></nav><article><p>Some text here.</p><p>More.</p></article></body>")]
    f, _ = extract.forest(pages)
    n = len(f.parent)
    score = f.features @ model.weights
    total = np.zeros((n, 2))
    for code in range(2**n):
        y = [(code >> i) & 1 for i in range(n)]
        w = math.exp(sum(score[i] * y[i] for i in range(n)) + sum(model.pairs[f.edge[i], y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0))
        for i in range(n):
            total[i, y[i]] += w
    assert model.marginals(f)[0] == pytest.approx(total / total.sum(axis=1, keepdims=True), abs=1e-9)


def test_html_reader():
    blocks = lambda h: [t for _, t, _ in html_tree.Page(h).blocks]
    assert blocks("<p>a <b>b</b>c<br>d&amp;amp; &eacute;\n x<p>y</p>z<script>no</script><!-- no --> <li>1<li>2") == ["a bc", "d&amp; é x", "y", "z", "1", "2"]
    assert blocks("<title>t</title><p>a<arti") == ["a"] and blocks("<!-- x") == [] and blocks("") == []
    assert blocks("<div>" * 1000 + "deep") == ["deep"] and blocks("a < b > c") == ["a < b > c"]


@pytest.mark.parametrize("tag", ["svg", "math", "object", "noscript", "template", "canvas", "audio", "video"])
def test_html_reader_keeps_what_follows_an_unclosed_element(tag):
    blocks = lambda h: [t for _, t, _ in html_tree.Page(h).blocks]
    assert blocks(f"<div><{tag}></div><p>article</p>") == ["article"]
    assert blocks(f"<p>a <{tag}>inside</{tag}> b</p>") == ["a inside b"]
    assert blocks("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds<script>no</script></p>") == ["so x=2 holds"]


@pytest.mark.parametrize("tag", ["select", "datalist", "button", "output"])
def test_form_controls_are_not_the_text_around(tag):
    nodes = lambda h: [(p.tag[n], t) for p in [html_tree.Page(h)] for n, t, _ in p.blocks]
    assert nodes(f"<p>a <{tag}><option>one</option><option>two</option></{tag}> b</p>") == [("form", "one two"), ("p", "a b")]
    assert nodes(f"<div><{tag}></div><p>article</p>") == [("p", "article")]
    assert nodes(f"<div>x <{tag}>one<option>two</div><p>article</p>") == [("form", "one two"), ("div", "x"), ("p", "article")]
    assert nodes(f"<p>a<{tag}>end") == [("form", "end"), ("p", "a")] and nodes(f"<p>a<{tag}/>b") == [("p", "ab")]


def test_broken_markup():
    blocks = lambda h: [t for _, t, _ in html_tree.Page(h).blocks]
    assert blocks("<head><title>x</title>Text with no body tag at all.") == ["Text with no body tag at all."]
    assert blocks("<head><meta a=b>\n<title>x</title></head>\n<p>y") == ["y"]
    assert blocks('<p class="a>Long text') == ["Long text"] and blocks("<p title='it>Long <b>text</b></p><p>more") == ["Long text", "more"]
    assert blocks('<p title="a > b" class=c>x</p>') == ["x"]


@pytest.mark.parametrize("page", ["<a " * 350_000 + '" >', '<p class="' * 100_000, "<p a='" * 100_000 + ">", "<" * 10**6, "<a" * 500_000, "</" * 500_000, "<!--" * 250_000, "<select>" * 125_000, "<p>a<b>" * 140_000, '<a b="' + "x" * 10**6, "<textarea>" * 100_000, "&" * 10**6], ids=range(12))
def test_a_megabyte_of_broken_tags_is_read_at_once(page):
    import time

    began = time.process_time()
    html_tree.Page(page)
    assert time.process_time() - began < 4


NAV = '<nav><ul><li><a href="/">Home page</a></li><li><a href="/a">About us</a></li></ul></nav>'
SIDE = '<aside class="sidebar"><h3>Related</h3><ul><li><a href="/r">Read more of it</a></li></ul></aside>'


@pytest.mark.parametrize("depth", [0, 390, 400, 5000, 100_000])
def test_extraction_at_any_depth(model, depth):
    page = f"<html><body>{'<div>' * depth}{NAV}<article><h1>The title</h1><p>A first sentence of the text. It goes on.</p><p>Let <math><mi>x</mi>=5</math> be given.</p></article>{SIDE}{'</div>' * depth}</body></html>"
    assert extract.main_texts(model, [page])[0] == "The title A first sentence of the text. It goes on. Let x=5 be given."
    read = html_tree.Page(page)
    assert max(read.depth) >= depth and all(read.depth[i] == read.depth[p] + 1 for i, p in enumerate(read.parent) if p >= 0)


def test_extraction_of_pages_written_by_hand(model):
    """Layouts without class names that would help."""
    prose = "<p>The river rose in the night and took the bridge with it. Nobody was hurt, said the mayor.</p><p>Work on a new one begins in spring, when the water is low.</p>"
    text = "The river rose in the night and took the bridge with it. Nobody was hurt, said the mayor. Work on a new one begins in spring, when the water is low."
    links = '<ul><li><a href="/1">News</a></li><li><a href="/2">Sport</a></li><li><a href="/3">Weather</a></li></ul>'
    pages = [
        f"<body><nav>{links}</nav><main>{prose}</main><footer>Some company, all rights reserved</footer></body>",
        f"<body><header>{links}</header><div><article>{prose}</article></div><aside>{links}</aside></body>",
        f"<body><div id=a1><div>{links}</div></div><div id=a2><article>{prose}<script>var a = 1;</script></article></div><footer><p>Imprint</p></footer></body>",
        f"<body><table><tr><td>{links}</td><td><article>{prose}</article></td></tr></table></body>",
        f"<body><article>{prose}<form><label>Your name</label><input><textarea>Write to us</textarea></form></article><footer>{links}</footer></body>",
    ]
    right = [extract.main_texts(model, [p])[0] == text for p in pages]
    assert sum(right) >= 4, right


def test_extraction_edges(spark, model):
    p = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>" + "word " * 20000), (3, "u", "<p>" + "word " * 20000), (None, "u", "plain")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = extract.extract(p, model).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] in (1, 2)] == ["", ""]
    assert extract.extract(p.limit(0), model).count() == 0


# 8


@pytest.mark.parametrize(("most_hot", "order"), [(1 << 20, 2), (50, 2), (1, 2), (20, 1), (1, 4)])
def test_lm_scores(docs, most_hot, order):
    got = lm.score(brute.clashing(docs), order, most_hot=most_hot, partition_words=500).collect()
    texts = [r[1] for r in ROWS]
    want = collections.Counter((r[0], n, h, None if s is None else round(s, 6)) for r, (n, h, _, s) in zip(ROWS, brute.lm_scores(texts, texts, order), strict=True))
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_pair_hits"], None if r["log_score"] is None else round(r["log_score"], 6)) for r in got) == want


def test_lm_broadcasts_a_bounded_table(spark, docs):
    texts = docs.select("text")
    words = [tuple(brute.words(r[1])) for r in ROWS]
    count = collections.Counter(w[i : i + k] for w in words for k in (1, 2) for i in range(len(w) - k + 1))
    n = sum(map(len, words))
    for most in (1, 7, 100):
        keys, times, total = lm.hot_counts(texts, 2, most, Work(spark))
        assert total == n and len(keys) <= 2 * most and not set(times.tolist()) - set(count.values())
        assert sorted(times.tolist(), reverse=True)[: sum(c * most >= 2 * n for c in count.values())] == sorted((c for c in count.values() if c * most >= 2 * n), reverse=True)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores_by_another_corpus(docs, order):
    table = lm.count_table(docs.where("doc_id % 2 = 0"), order)
    half = [r[1] for r in ROWS if r[0] is not None and r[0] % 2 == 0]
    want = collections.Counter((r[0], n, b, None if s is None else round(s, 6)) for r, (n, _, b, s) in zip(ROWS, brute.lm_scores([r[1] for r in ROWS], half, order), strict=True))
    got = lm.score_against(brute.clashing(docs), table, order).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_backoffs"], None if r["log_score"] is None else round(r["log_score"], 6)) for r in got) == want
    assert order == 1 or sum(r["n_backoffs"] for r in got) > 0


def test_lm_edges(docs):
    assert lm.score(docs.limit(0)).count() == 0
    assert lm.score_against(docs.limit(0), lm.count_table(docs.limit(0))).count() == 0
    with pytest.raises(ValueError, match="order"):
        lm.score(docs, order=0)
    assert lm.score(docs.where("doc_id < 3")).where("log_score is not null").isEmpty()


def test_lm_takes_many_equal_rows(spark):
    rows = [(1, "a b c", "en", "s", 0)] * 500 + [(2, "a b d", "en", "s", 0)]
    got = {tuple(r) for r in lm.score(brute.frame(spark, rows), most_hot=1).select("doc_id", "n_words", "n_pair_hits", F.round("log_score", 9)).collect()}
    assert got == {(1, 3, 2, round(math.log(501 / 1503 * 500 / 501), 9)), (2, 3, 1, round(math.log(501 / 1503 / 501), 9))}


# 9


@pytest.mark.parametrize(("window", "shard", "hot"), [(35, 1 << 18, 256), (10, 100, 256), (10, 100, 1), (35, 100, 0)])
def test_substring_dedup(docs, monkeypatch, window, shard, hot):
    monkeypatch.setattr(substrings, "HOT_CONTENTS", hot)
    monkeypatch.setattr(substrings, "SHARD_WORDS", shard)
    got = substrings.remove_repeats(brute.clashing(docs), window).withColumn("sha", F.sha2(F.col("kept").cast("binary"), 256)).collect()
    want = collections.Counter((r[0], *x) for r, x in zip(ROWS, brute.remove_repeats([r[1] for r in ROWS], window), strict=True))
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["sha"]) for r in got) == want
    assert all(sum(b - a for a, b in r["removed"]) == r["n_removed"] for r in got)


def test_substring_takes_many_equal_rows(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(1, f"x {passage} y", "en", "s", 0)] * 300 + [(2, f"z {passage} z", "en", "s", 0), (3, "z " * 20, "en", "s", 0)]
    got = collections.Counter((r["doc_id"], r["kept"]) for r in substrings.remove_repeats(brute.frame(spark, rows)).collect())
    assert got == {(1, ""): 300, (2, "z z"): 1, (3, ("z " * 20).strip()): 1}


def test_substring_edges(docs):
    assert substrings.remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="window"):
        substrings.remove_repeats(docs, 5)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=20), st.integers(1, 2)), min_size=1, max_size=5), st.integers(1, 6))
def test_suffix_automaton_counts_windows(texts, window):
    a = substrings.SuffixAutomaton([t for t, _ in texts], [w for _, w in texts])
    count = collections.Counter()
    for t, w in texts:
        for i in range(len(t) - window + 1):
            count[tuple(t[i : i + window])] += w
    for t, _ in texts:
        assert a.repeats(t, window) == [count[tuple(t[i : i + window])] >= 2 for i in range(len(t) - window + 1)]


# 10

ITEMS = [(1, brute.prose(np.random.default_rng(4), 0)), (2, "Short Item words"), (3, None), (4, "..."), (7, ROWS[14][1]), (7, " ".join((ROWS[15][1] or "").split()[:20])), (9, ROWS[20][1].upper()), (11, "one"), (12, ROWS[40][1])]


@pytest.mark.parametrize("chunk", [8 << 20, 300])
def test_contamination(spark, docs, chunk):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("items", F.lit("clash"))
    got = decontaminate.contamination(brute.clashing(docs), bench, chunk_bytes=chunk).collect()
    want = brute.contamination([r[1] for r in ROWS], ITEMS)
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in got) == collections.Counter((r[0], n, h, ",".join(i), c) for r, (n, h, i, c) in zip(ROWS, want, strict=True))
    left = decontaminate.drop_contaminated(brute.clashing(docs), bench, chunk_bytes=chunk)
    assert left.columns == brute.clashing(docs).columns
    assert bag(left.select("doc_id", "text")) == collections.Counter(str((r[0], r[1])) for r, w in zip(ROWS, want, strict=True) if not w[3])
    assert any(w[3] for w in want) and max(r["longest"] for r in got) > 13


def test_many_chunks_of_repeated_items_and_documents(spark):
    rows = [(i % 50, " ".join(f"w{(i % 50) * 7 + k}" for k in range(60)), "en", "s", 0) for i in range(200)]
    items = [(j, " ".join(f"w{j * 5 + k}" for k in range(20))) for j in range(60)] * 3
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = [decontaminate.contamination(brute.frame(spark, rows), bench, chunk_bytes=size) for size in (1 << 20, 600)]
    a, b = (collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["longest"], r["contaminated"]) for r in x.collect()) for x in found)
    assert a == b and len(a) == 50 and set(a.values()) == {4}
    left = decontaminate.drop_contaminated(brute.frame(spark, rows), bench, chunk_bytes=600)
    assert left.count() == 4 * sum(not k[-1] for k in a)


def test_a_text_longer_than_a_batch(spark):
    """Seven MB in one row, beside short ones."""
    long = " ".join(f"w{k}" for k in range(900_000))
    docs = brute.frame(spark, [(1, long, "en", "s", 0), (2, "w5 w6 w7", "en", "s", 0), (3, " ".join(long.split()[:100]), "en", "s", 0)])
    assert {r["doc_id"]: r["n_words"] for r in quality.judge(docs, None).collect()} == {1: 900_000, 2: 3, 3: 100}
    bench = spark.createDataFrame([(7, " ".join(f"w{k}" for k in range(899_000, 899_020)))], "item_id long, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.contamination(docs, bench).collect()} == {1: 20, 2: 0, 3: 0}
    assert {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(docs).collect()} == {1: 100, 2: 0, 3: 100}
    assert {r["doc_id"]: r["n_words"] for r in lm.score(docs).collect()} == {1: 900_000, 2: 3, 3: 100}


def test_contamination_edges(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).where("contaminated or n_hit > 0").isEmpty()
    assert decontaminate.contamination(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    digest = decontaminate.digest(decontaminate.contamination(docs, none)).first()
    assert digest["items_sha256"] == decontaminate.items_sha256([])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=40), min_size=1, max_size=4), st.lists(st.text(alphabet="ab ", max_size=20), min_size=1, max_size=4), st.integers(1, 4))
def test_suffix_array_search(texts, items, window):
    tests = decontaminate.TestSuffixes(list(range(len(items))), pa.array(items), window)
    hits = decontaminate.search(pa.array(texts), tests)
    want = brute.contamination(texts, list(enumerate(items)), window)
    covered, (size, item) = hits.covered(tests), hits.longest(tests)
    assert hits.n.tolist() == [w[0] for w in want]
    assert len({*zip(hits.at.tolist(), tests.need[hits.win].tolist(), strict=True)}) == len(hits.at)
    for i, w in enumerate(want):
        mine = hits.of[hits.at] == i
        assert sorted({tests.ids[j] for s in tests.set_of[hits.win[mine]] for j in tests.sets[s]}) == w[2]
        assert covered[hits.first[i] : hits.first[i] + hits.n[i]].sum() == w[1]
        mine_words, item_words = brute.alnum(texts[i]), [brute.alnum(x) for x in items]
        for a, k, j in zip((hits.at[mine] - hits.first[i]).tolist(), size[mine].tolist(), item[mine].tolist(), strict=True):
            there = lambda n, x: any(x[q : q + n] == mine_words[a : a + n] for q in range(len(x) - n + 1))  # noqa: B023, E731
            assert there(k, item_words[j])
            assert k <= window or a + k == len(mine_words) or not any(there(k + 1, x) for x in item_words if len(x) > window)
    may = decontaminate._may_hold(pa.array(texts), *decontaminate._bits([tests]))
    assert may[0].tolist() == hits.n.tolist() and all(m or not w[1] for m, w in zip(may[1], want, strict=True))


def test_items_with_one_opening_cost_no_pairs():
    opening = " ".join(f"o{k}" for k in range(13))
    tests = decontaminate.TestSuffixes(list(range(4000)), pa.array([f"{opening} item {k} goes on" for k in range(4000)]))
    text = " x ".join([opening] * 1000) + f" x {opening} item 77 goes on"
    hits = decontaminate.search(pa.array([text]), tests)
    assert len(hits.at) <= len(hits.of)
    size, item = hits.longest(tests)
    assert size.max() == 17 and item[size.argmax()] == 77 and max(len(tests.sets[k]) for k in tests.set_of[hits.win]) == 4000
