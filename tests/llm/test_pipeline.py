"""The pipeline: each stage's decisions, against plain rules over its own input."""

import itertools

import pytest

import corpus_pipeline
from tessera.llm import common, decontam
from tests.llm.test_llm_operators import brute_components
from tests.llm.conftest import prose

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.documents(spark, DATA)
    columns = docs.columns
    bench = [decontam.normal(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = common.saved(stage(spark, docs, DATA), f"test-{name}")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        gone = set(before) - set(after)
        if name == "language":
            assert len(gone) < 0.02 * len(before)
        if name == "lines":
            seen = set()
            for i in sorted(before):
                own = [x.strip() for x in (after.get(i) or "").split("\n") if len(x.split()) >= 10]
                assert set(own) <= {x.strip() for x in (before[i] or "").split("\n")}
                seen.update(own)
            assert {x.strip() for t in before.values() for x in (t or "").split("\n") if len(x.split()) >= 10} == seen
        if name == "near":
            want = brute_components(before.items())
            assert set(after) == {i for i, (_, c) in want.items() if c == i}
        if name == "benchmark":
            assert not any(x and x in decontam.normal(t) for x, t in itertools.product(bench, after.values()))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == set(after)


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_stages_with_clashing_columns(spark, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.saved(stage(spark, docs, DATA), "test")
        assert docs.columns == odd_docs.columns
        assert {r.score for r in docs.collect()} == {"x"} == {r.n_deleted for r in docs.collect()}


def test_a_run_deletes_its_own_folders_alone(spark):
    from tessera.llm import ogg

    before = ogg.op5_ogg(spark, DATA)
    n = before.count()
    corpus_pipeline.run(spark, DATA).count()
    assert before.count() == n


def test_near_keeps_unique_rows_of_a_repeated_id(spark, make_docs):
    a, u = prose(300, 1), prose(300, 2)
    docs = make_docs([(1, a), (2, a), (2, u), (3, f"{u} {prose(300, 3)}"), (4, a), (1, a)])
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near(spark, docs, DATA).collect()) == [(1, a), (2, u), (3, f"{u} {prose(300, 3)}")]


def test_stages_of_no_rows(spark, make_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, make_docs([]), DATA).collect() == []


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "local-cluster[2,1,1024]"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError):
        common.folder(Session, "x")
