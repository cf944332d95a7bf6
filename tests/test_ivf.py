"""The inverted file against the exact search: recall, pruned lists, odd vectors, the audit."""

import re

import numpy as np
import pytest

from lodestone.operators import ivf, vectors
from lodestone.sources import tables


@pytest.fixture(autouse=True)
def few_rounds(monkeypatch):
    monkeypatch.setattr(ivf, "ROUNDS", 4)


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16)) * 3
    x = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [1.0, 2.0]), (5003, x[3].tolist()), (5004, [float("nan")] * 16), (5005, [])]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(4)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 3000, 60)], "query_id long, query_vec array<double>")
    return v, q


def test_recall_and_pruned_lists(spark, clustered, tmp_path):
    v, q = clustered
    index = ivf.build(v, str(tmp_path), lists=32, sub_vectors=4)
    exact = vectors.top_k(v, q, 10)
    got = ivf.search(index, q, 10, probes=6, candidates=8)
    assert ivf.shared(got, exact) >= 0.95 and ivf.recall(got, exact) >= 0.95
    score = {(r["query_id"], r["chunk_id"]): r["score"] for r in exact.collect()}
    both = [(r["score"], score[r["query_id"], r["chunk_id"]]) for r in got.collect() if (r["query_id"], r["chunk_id"]) in score]
    assert all(a == b for a, b in both) and len(both) >= 450  # estimates choose, exact cosines score
    few = q.where("query_id = 0")
    plan = ivf.search(index, few, 10, probes=2, candidates=8)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[list#\d+ IN \(\d+,\d+\)\]", plan)  # the scans of codes and vectors list the two probed ones
    assert index.vectors.count() == v.where("embedding IS NOT NULL").count()


@pytest.mark.parametrize("candidates", [1, 1000])
def test_probing_blocks_are_never_broadcast(spark, clustered, tmp_path, candidates):
    """All lists repeat each query 256 times and more; the estimate of the blocks is that of the queries alone."""
    v, q = clustered
    index = ivf.build(v, str(tmp_path), lists=32, sub_vectors=4)
    for probes in (6, 32):
        plan = ivf.search(index, q, 10, probes=probes, candidates=candidates)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [list" in plan and "BroadcastHashJoin [list" not in plan


def test_all_lists_and_candidates_are_exact(spark, clustered, tmp_path):
    v, q = clustered
    index = ivf.build(v.where("chunk_id % 4 = 0 OR chunk_id >= 5000"), str(tmp_path), lists=5, sub_vectors=3)
    odd = q.limit(3).unionByName(spark.createDataFrame([(9001, [1.0, 0.5]), (9002, [0.0] * 16), (9003, None)], q.schema))
    want = vectors.top_k(index.vectors, odd, 4)
    got = ivf.search(index, odd, 4, probes=5, candidates=1000)
    assert sorted(map(tuple, got.select("query_id", "chunk_id", "score", "pos").collect())) == sorted(map(tuple, want.select("query_id", "chunk_id", "score", "pos").collect()))


def test_audit_widens_until_the_recall_is_met(spark, tmp_path):
    rng = np.random.default_rng(9)  # without clusters, so few probes find little
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(rng.normal(size=(800, 12)))], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(rng.normal(size=(20, 12)))], "query_id long, query_vec array<double>")
    index = ivf.build(v, str(tmp_path), lists=20, sub_vectors=3)
    index = index._replace(config=index.config | {"probes": 1, "candidates": 1})
    assert ivf.shared(ivf.search(index, q, 10), vectors.top_k(v, q, 10)) < 0.9
    config = ivf.audit(index, q, str(tmp_path), 10, 0.95)
    assert config["recall"] >= 0.95 and config["probes"] > 1
    again = ivf.read(spark, str(tmp_path))
    assert again.config == config and ivf.shared(ivf.search(again, q, 10), vectors.top_k(v, q, 10)) == config["recall"]


def test_empty_and_single(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query_vec array<double>")
    assert ivf.search(ivf.build(none, str(tmp_path / "a")), q).count() == 0
    one = ivf.build(spark.createDataFrame([(7, [2.0, 0.0])], none.schema), str(tmp_path / "b"))
    assert [tuple(r) for r in ivf.search(one, q).select("query_id", "chunk_id", "score", "pos").collect()] == [(1, 7, 1.0, 1)]


def test_the_sink_builds_the_index_that_the_policy_names(spark, tmp_path, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i), 2.0]) for i in range(60)], "chunk_id long, embedding array<double>")
    assert tables.write_vectors(v, str(tmp_path / "few")) == {"kind": "none", "rows": 60} and not tables.exists(spark, str(tmp_path / "few-index"))
    monkeypatch.setattr(vectors, "index_policy", lambda n, dim: {"kind": "inverted-file", "partitions": 4, "sub_vectors": 2})
    config = tables.write_vectors(v, str(tmp_path / "many"))
    assert config["lists"] == 4 and ivf.read(spark, str(tmp_path / "many-index")).vectors.count() == 60


@pytest.fixture
def many_queries(spark, tmp_path):
    x = np.random.default_rng(10).normal(size=(1200, 8))  # without clusters: an audit sets many probes and candidates
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)] + [(2000, [0.0] * 8), (2001, [1.0])], "chunk_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 1200, 5)], "query_id long, query_vec array<double>")
    return ivf.build(v, str(tmp_path), lists=12, sub_vectors=2), v, q


def test_many_queries_move_no_vector_a_candidate(spark, many_queries):
    index, v, q = many_queries
    rows = lambda d: sorted(map(tuple, d.select("query_id", "chunk_id", "score", "pos").collect()))
    assert rows(ivf.search(index, q, 5, probes=12, candidates=300)) == rows(vectors.top_k(v, q, 5))
    got = ivf.search(index, q, 5, probes=3, candidates=40)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join \w+, .*chunk_id", plan) and "Join Inner, (list" in plan  # vectors and queries meet by list, not by candidate
    assert re.search(r"PartitionFilters: \[list#\d+ IN", ivf.search(index, q.limit(1), 5, probes=3, candidates=250)._jdf.queryExecution().toString())
    codes = ivf.search(index, q.limit(4), 5, probes=3, candidates=40)  # few enough for the codes
    found = {r[:2]: r[2] for r in rows(got)}
    exact = {r[:2] for r in rows(vectors.top_k(v, q.limit(4), 5))}
    assert {r[:2] for r in rows(codes)} & exact <= set(found) and all(found.get(r[:2], r[2]) == r[2] for r in rows(codes))


def test_query_blocks_are_handed_on_in_bounded_batches(many_queries, monkeypatch):
    import pyarrow as pa

    index, _, q = many_queries
    monkeypatch.setattr(vectors, "BATCH_BYTES", 20_000)
    box = type("Box", (), {"value": index.trained})
    batches = list(ivf._probes(box, 12)(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(r[0], r[1]) for r in q.collect()])], ["a", "b"])])))
    assert len(batches) > 3 and all(b.nbytes < 60_000 for b in batches)
    assert sum(len(ids) for b in batches for ids in b.column(1).to_pylist()) == 12 * 240
