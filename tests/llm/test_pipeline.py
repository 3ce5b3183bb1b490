"""The pipeline against brute force, stage by stage, each on what the one before kept."""

from __future__ import annotations

import corpus_pipeline
import pytest
import tiktoken

from chronofold.llm import byte_bpe, quality_classifier
from tests.llm.test_operators import DOCS, EDGE, brute_components, brute_rules, words


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame(EDGE, DOCS))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf))
        out.append(docs)
    return [(d.columns, d.collect()) for d in out]


def test_stages_are_named_and_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    assert all(c == stages[0][0] for c, _ in stages[1:5])


def test_classifier_rejects(spark, sf, stages):
    docs = spark.createDataFrame(stages[0][1], DOCS)
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    enc = quality_classifier.Encoder()
    want = [r for r in stages[0][1] if model.scores([enc(r.text)])[0] >= 0.5]
    assert sorted(map(str, want)) == sorted(map(str, stages[1][1]))
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1][1]}
    good = [i for i, q in quality.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)


def test_rules_reject(stages):
    def ok(r):
        n, _, _, _, again = brute_rules(r.text)
        return n >= 50 and 100 * again <= 50 * n

    assert sorted(str(r) for r in stages[1][1] if ok(r)) == sorted(map(str, stages[2][1]))


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[2][1] if r.doc_id is not None]
    assert len({i for i, _ in rows}) == len(rows)
    want = {c for _, _, c in brute_components(rows)}
    assert {r.doc_id for r in stages[3][1] if r.doc_id is not None} == want


def test_documents_with_items_go(spark, sf, stages):
    items = [" ".join(words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {r.doc_id for r in stages[3][1] if any(f" {i} " in f" {' '.join(words(r.text))} " for i in items)}
    kept = {r.doc_id for r in stages[4][1]}
    assert not dirty & kept and {r.doc_id for r in stages[3][1]} - dirty == kept


def test_tokens_are_those_of_the_library(stages):
    path, pattern = byte_bpe.vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.codec(path, pattern).ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in stages[4][1]}
    assert {r.doc_id for r in stages[5][1]} == set(texts)
    for r in stages[5][1]:
        assert list(r.ids) == own.encode_ordinary(texts[r.doc_id]) and r.text == texts[r.doc_id] and r.n_tokens == len(r.ids)


def test_run_and_empty_table(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() <= len(stages[0][1])
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf))
        assert docs.count() == 0
