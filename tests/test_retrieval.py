"""Golden cases of fusion, assembly, entities and BM25 on inline fixtures."""

import math

from lodestone.operators import bm25, chat, corpus, entities, fusion
from lodestone.streaming.cache import SemanticCache


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id string, score double, pos int, skip boolean")


def test_rrf_exact_and_skips(spark):
    v = hits(spark, [(1, "A", 0.95, 1, False), (1, "B", 0.8, 2, False), (1, "C", 0.7, 3, False)])
    b = hits(spark, [(1, "A", 10.0, 1, False), (1, "C", 8.0, 2, False)])
    got = {r["chunk_id"]: r for r in fusion.rrf(fusion.paths(vector=v, bm25=b)).collect()}
    assert got["A"]["rrf"] == round(2 / 61, 9) and got["A"]["pos"] == 1
    assert got["C"]["rrf"] == round(1 / 63 + 1 / 62, 9) and got["B"]["bm25_rank"] is None
    v = hits(spark, [(1, c, 1.0 - i / 10, i + 1, c in "BD") for i, c in enumerate("ABCDE")])
    got = {r["chunk_id"]: r for r in fusion.rrf(fusion.paths(vector=v)).collect()}
    assert [got[c]["rrf"] for c in "ACE"] == [round(1 / 61, 9), round(1 / 62, 9), round(1 / 63, 9)]
    assert got["B"]["rrf"] is None and got["B"]["vector_rank"] is None and got["B"]["vector_score"] == 0.9


def test_assembly_caps_documents_and_normalises(spark):
    v = hits(spark, [(1, f"a{i}", 1.0, i + 1, False) for i in range(6)] + [(1, "b0", 0.1, 7, False)])
    chunks = spark.createDataFrame([(f"a{i}", "A", f"line {i}\nx") for i in range(6)] + [("b0", "B", "line")], "chunk_id string, doc_id string, content string")
    fused = fusion.rrf(fusion.paths(vector=v))
    got = fusion.assemble(fused, chunks).orderBy("rank").collect()
    assert [r["doc_id"] for r in got].count("A") == 5 and got[0]["score"] == 0.95 and got[-1]["score"] == 0.05
    assert {r["source"] for r in got} == {"vector"}
    assert [r["doc_id"] for r in fusion.assemble(fused, chunks, entity=True).collect()].count("A") == 1


def test_entities_and_or_last_wins(spark):
    e = spark.createDataFrame([("x", "concept", 1, 0), ("x", "entity", 5, 1), ("y", "entity", 2, 2)], "name string, type string, frequency int, ordinal int")
    one = entities.last_wins(e)
    assert {r["name"]: r["type"] for r in one.collect()} == {"x": "entity", "y": "entity"}
    edges = spark.createDataFrame([("x", "c1"), ("x", "c2"), ("y", "c2")], "name string, chunk_id string")
    req = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "nobody")], "query_id long, name_pos int, name string")
    both = entities.lookup_and(req, one.drop("ordinal"), edges).collect()
    assert {r["chunk_id"] for r in both} == {"c2"}
    assert entities.lookup_or(req, one.drop("ordinal"), edges).count() == 3


def test_match_names_inside_words_and_phrases(spark):
    q = spark.createDataFrame([(1, "The Quick brown fox of Foobar Inc."), (2, "")], "query_id long, query string")
    e = spark.createDataFrame([("quick brown fox of foobar",), ("oobar",), ("none",), ("",), ("ck br",)], "name string")
    got = {(r["query_id"], r["name"]) for r in entities.match_names(q, e).collect()}
    assert got == {(1, "quick brown fox of foobar"), (1, "oobar"), (1, "ck br")}


def test_bm25_by_hand(spark):
    c = spark.createDataFrame([(1, "a b"), (2, "a a c"), (3, "")], "chunk_id long, content string")
    q = spark.createDataFrame([(7, "a a")], "query_id long, query string")
    got = {r["chunk_id"]: r["score"] for r in bm25.search(bm25.build_index(c), q).collect()}
    idf = math.log(1 + 0.5 / 2.5)
    want = lambda tf, dl: round(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 2.5)), 6)
    assert got == {1: want(1, 2), 2: want(2, 3)}


def test_percentiles_and_diff(spark):
    v = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    r = corpus.percentiles_by_index(v, "v", 0.5, 0.95).first()
    assert (r["p50"], r["p95"], r["n"]) == (5.0, 9.0, 10)
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "doc_key string, digest string")
    b = spark.createDataFrame([("b", "2"), ("c", "4"), ("d", "5")], "doc_key string, digest string")
    assert {r["doc_key"]: r["change"] for r in corpus.diff(a, b).collect()} == {"a": "deleted", "b": "unchanged", "c": "modified", "d": "added"}


def test_prompt_is_literal(spark):
    r = spark.createDataFrame([(1, 1, 5, "x $1 \\ {query}", 0.5)], "query_id long, rank int, doc_id long, content string, score double")
    q = spark.createDataFrame([(1, "why?")], "query_id long, query string")
    assert "x $1 \\ {query}" in chat.prompts(r, q).first()["prompt"]


def test_cache():
    c = SemanticCache(capacity=2)
    c.put("Hi ", [1, 0], 1, "p", [], "r")
    assert c.get("hi", None, 1, "p") == "r" and c.get("hello", [0.99, 0.05], 1, "p", ["e"]) == "r"
    assert c.get("hello", [0, 1], 1, "p") is None and c.get("hi", None, 2, "p") is None
    for k in "abc":
        c.put(k, None, 2, "p", [], k)
    assert c.get("a", None, 2, "p") is None and c.get("c", None, 2, "p") == "c"
