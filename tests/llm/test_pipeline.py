from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tessera.llm import decontamination, jaccard, secrets, toxicity

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables aren't here")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_each_stage_takes_effect(spark, docs):
    model = toxicity.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    kept = C.drop_toxic(spark, docs, DIR)
    assert ids(kept) == ids(toxicity.scores(docs, model).where("predicted = 0")) and tuple(kept.columns) == C.COLUMNS
    kept = C.drop_near_copies(spark, docs, DIR)
    parts = jaccard.joined(docs).collect()
    assert ids(kept) == sorted({r.component_id for r in parts})
    kept = C.drop_contaminated(spark, docs, DIR)
    gone = {r.doc_id for r in decontamination.contaminated(docs, spark.read.parquet(f"{DIR}/benchmark.parquet")).collect()}
    assert ids(kept) == [i for i in ids(docs) if i not in gone] and gone
    kept = {r.doc_id: r for r in C.mask_secrets(spark, docs, DIR).collect()}
    for r in docs.collect():
        spans = secrets.find(r.text)[1]
        assert kept[r.doc_id].text == secrets.redact(r.text, spans) and kept[r.doc_id].n_chars == (len(kept[r.doc_id].text) if spans else r.n_chars)
    assert ids(C.encode(spark, docs, DIR)) == ids(docs)


def test_stages_get_through_odd_rows(spark, odd, none):
    rows = odd.select(*C.COLUMNS)
    for name, stage in C.STAGES:
        out = stage(spark, rows, DIR)
        assert out.count() <= rows.count()
        assert stage(spark, none.select(*C.COLUMNS), DIR).count() == 0
        if name in ("secrets", "bpe"):
            assert out.count() == rows.count()


def test_run_is_all_stages(spark, docs):
    out = C.run(spark, DIR)
    want = docs
    for _, stage in C.STAGES:
        want = stage(spark, want, DIR)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, want.collect()))
    assert 0 < out.count() < docs.count() and out.where(F.size("token_ids") != F.col("n_tokens")).count() == 0
