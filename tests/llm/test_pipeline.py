"""The pipeline over the smallest tables, stage by stage."""

import hashlib

import corpus_pipeline
from sparkcol.llm import common

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect(spark, data_dir, tmp_path):
    docs = common.table(spark, data_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, data_dir).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == COLUMNS and 0 < after.count() <= docs.count()
        assert all(r.n_chars == len(r.text) for r in after.select("n_chars", "text").collect())
        docs = after
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, data_dir).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert last.keys() == texts.keys()
    assert all(last[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items())
    assert sorted(map(tuple, corpus_pipeline.run(spark, data_dir).collect())) == sorted(map(tuple, last.values()))


def test_good_documents_are_kept(spark, duck, data_dir):
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, common.table(spark, data_dir, "documents"), data_dir).collect()}
    labels = duck.execute("SELECT doc_id, quality, text FROM labels JOIN documents USING (doc_id)").fetchall()
    good = [i in kept for i, q, t in labels if q == 1 and len(t.split()) >= 10]
    bad = [i in kept for i, q, _ in labels if q == 0]
    assert sum(good) / len(good) >= 0.97 and sum(bad) / len(bad) <= 0.05


def test_empty_documents(spark, data_dir):
    docs = common.table(spark, data_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data_dir).count() == 0
