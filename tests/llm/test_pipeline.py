"""The pipeline, stage by stage, against plain versions of the stages."""

import pytest

import corpus_pipeline
from galeframe.llm import quality
from tests.llm import brute


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [r for r in brute.corpus(8, 90) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    brute.frame(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, rows[30][1]), (2, "short one")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(r[0], int("###" not in (r[1] or "")), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows


def test_stages_against_plain_versions(spark, tables):
    d, rows = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    fine = {r["doc_id"] for r in quality.judge(docs, model).where("kept").collect()}
    rows = [r for r in rows if not brute.stats(r[1])["base_failed"] and r[0] in fine]
    want = [{r[0]: r[1] for r in rows}]
    cut = brute.dedup_lines(rows)
    rows = [(r[0], cut[r[0], r[1]][0], *r[2:]) for r in rows if brute.words(cut[r[0], r[1]][0])]
    want.append({r[0]: r[1] for r in rows})
    groups = brute.jaccard_groups(rows)
    rows = [r for r in rows if groups[r[0]][0] == r[0]]
    want.append({r[0]: r[1] for r in rows})
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    rows = [r for r, c in zip(rows, brute.contamination([r[1] for r in rows], bench), strict=True) if not c[3]]
    want += [{r[0]: r[1] for r in rows}] * 2
    assert len({len(w) for w in want[:4]}) >= 3
    at = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, d)
        assert {r["doc_id"]: r["text"] for r in out.collect()} == want[k], name
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{d}/stage{k}.parquet")
            at = spark.read.parquet(f"{d}/stage{k}.parquet")
    got = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want[4]
    assert len({(r["mix_slot"], r["mix_in_block"]) for r in got}) == len(got)


def test_stages_take_an_empty_table(spark, tables):
    d, _ = tables
    none = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, d).count() == 0
