import pytest

import corpus_pipeline
from doorlens.llm import chosen_path, toxicity
from doorlens.llm.shared import fold
from pyspark.sql import functions as F
from tests.llm.helpers import words
from tests.llm.test_chosen_path import brute
from tests.llm.test_secrets import base

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.stored(stage(spark, out[-1], FOLDER), "test"))
    return out


def test_each_stage_does_its_work(spark, stages):
    docs, clean, single, masked, mixed, packed = stages
    assert all(s.columns == docs.columns for s in stages[1:-1])
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scores = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels.filter(fold(F.col("doc_id"), 5) != 0)))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in scores.filter("score < 0.5").collect()}
    rows = [tuple(r) for r in clean.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, (c, _) in brute(rows).items() if i == c)
    before = {r.doc_id: r for r in single.collect()}
    for r in masked.collect():
        assert not base(r.text)[0] and r.n_chars == len(r.text)
        if not base(before[r.doc_id].text)[0]:
            assert r == before[r.doc_id]
    count = {}
    for r in mixed.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert set(count) <= set(before) and max(count.values()) <= 3
    pieces = packed.collect()
    assert {r.doc_id for r in pieces} == set(count)
    for doc, n in count.items():
        assert sum(r.piece == 0 for r in pieces if r.doc_id == doc) == n


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == stages[-1].columns and got.count() == stages[-1].count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert chosen_path and words("a b") == ["a", "b"]
