"""Pruned BM25 against the exhaustive search on random corpora, and what it reads."""

import re

import numpy as np
import pytest

from lodestone.operators import bm25, impacts
from lodestone.sources import tables


def corpus(spark, seed, n, vocabulary, skew=1.1):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, vocabulary + 1) ** skew
    words = np.array([f"w{i}" for i in range(vocabulary)])
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 120)), p=p / p.sum())) for _ in range(n)]
    texts[5] = texts[6] = texts[7]  # ties
    texts[8] = ""
    queries = [" ".join(rng.choice(words, int(rng.integers(1, 9)), p=p / p.sum())) for _ in range(12)] + ["w0 w1 w2", "w0", "unknown", "", texts[5], f"w{vocabulary - 1} w0"]
    return spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string").repartition(5), spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")


@pytest.mark.parametrize("seed, n, vocabulary, k, k1, block", [(1, 600, 300, 10, 1.2, 16), (2, 900, 2000, 5, 1.5, 8)])
def test_equals_exhaustive_search(spark, monkeypatch, tmp_path, seed, n, vocabulary, k, k1, block):
    monkeypatch.setattr(impacts, "BLOCK", block)
    monkeypatch.setattr(impacts, "HEAD", 10)
    chunks, queries = corpus(spark, seed, n, vocabulary)
    index = bm25.build_index(chunks)
    impacts.write(impacts.build(index), str(tmp_path / "i"))
    s = impacts.Search(impacts.read(spark, str(tmp_path / "i")), queries, k, k1)
    want = sorted(map(tuple, bm25.search(index, queries, k, k1).select("query_id", "chunk_id", "score", "pos").collect()))
    assert sorted(map(tuple, s.hits().select("query_id", "chunk_id", "score", "pos").collect())) == want
    blocks = s.index.blocks.selectExpr("max(size(postings)) m", "sum(size(postings)) n").first()
    assert blocks["n"] == index.postings.count() and blocks["m"] <= 4 * block
    if n > 500:
        read = s.plan.where("NOT read").selectExpr("sum(n) n").first()["n"]
        assert read > 0.25 * s.plan.selectExpr("sum(n) n").first()["n"]  # of the postings of all queries' words, at least a quarter is left out


def test_stop_words_and_empty_corpus(spark):
    chunks, queries = corpus(spark, 4, 80, 40)
    index = bm25.build_index(chunks, ["w0", "w1"])
    got = impacts.search(impacts.build(index), queries, 5, stop=["w0", "w1"])
    want = bm25.search(index, queries, 5, stop=["w0", "w1"])
    assert sorted(map(tuple, got.select("query_id", "chunk_id", "score", "pos").collect())) == sorted(map(tuple, want.select("query_id", "chunk_id", "score", "pos").collect()))
    none = bm25.build_index(chunks.where("chunk_id < 0"))
    assert impacts.search(impacts.build(none), queries).count() == 0
    assert impacts.search(impacts.build(index), queries.where("query_id < 0")).count() == 0


def test_cheaper_way(spark, monkeypatch):
    chunks, queries = corpus(spark, 6, 200, 60)
    index = bm25.build_index(chunks)
    few = impacts.best(index, lambda: pytest.fail("too few pairs to prune"), queries, 7)
    monkeypatch.setattr(impacts, "PAIRS", 10)
    many = impacts.best(index, lambda: impacts.build(index), queries, 7)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_postings_are_never_shuffled_with_their_words(spark, tmp_path):
    chunks, queries = corpus(spark, 7, 300, 200)
    tables.write_index(bm25.build_index(chunks), str(tmp_path / "t"))
    index = impacts.build(tables.read_index(spark, str(tmp_path / "t")))
    plan = index.blocks._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange (hash|range)partitioning", plan)  # blocks are made where the postings are read
    impacts.write(index, str(tmp_path / "i"))
    s = impacts.Search(impacts.read(spark, str(tmp_path / "i")), queries, 5)
    words = len(s.asked.select("term").distinct().collect())
    most = s.numbers.selectExpr("count(*) n").first()["n"]
    moved = s._moved(s.asked)
    assert moved.columns == ["chunk_id", "no", "value"] and words < most  # numbers only, a row for a posting whatever the queries
    own = s.index.blocks.join(s.asked.select("term").distinct(), "term").selectExpr("sum(size(postings)) n").first()["n"]
    assert moved.count() == own < s.asked.selectExpr("sum(n) n").first()["n"]


def test_chunks_of_text_ids_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(impacts, "HEAD", 2)
    monkeypatch.setattr(impacts, "BLOCK", 4)
    monkeypatch.setattr(bm25, "QUERIES", 5)
    chunks, queries = corpus(spark, 8, 250, 120)
    named = chunks.selectExpr("concat('c', chunk_id) chunk_id", "content")
    index = bm25.build_index(named)
    got = impacts.search(impacts.build(index._replace(postings=index.postings.drop("dl"))), queries, 6)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bm25.search(index, queries, 6).collect()))
