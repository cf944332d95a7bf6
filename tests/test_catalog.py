"""Registered queries over the smallest tables answer every query in full."""

import hashlib
import tempfile

import pytest

from lodestone.operators import linking
from lodestone.plans import catalog

D = "/root/testdata/sf0.001"


def test_queries_without_a_vector_partner_keep_their_lexical_hits(spark):
    lexical = {(r["query_id"], r["chunk_id"]): r["pos"] for r in catalog.Q["bm25_k1_12"](spark, D).collect()}
    got = {(r["query_id"], r["chunk_id"]): r for r in catalog.Q["rrf_fusion"](spark, D).collect()}
    assert {k: r["bm25_rank"] for k, r in got.items() if r["bm25_rank"]} == lexical
    alone = {q for q, _ in got} - {q for (q, _), r in got.items() if r["vector_rank"]}
    assert alone and all(r["rrf"] == round(1 / (60 + r["pos"]), 9) and r["pos"] == r["bm25_rank"] for (q, _), r in got.items() if q in alone)
    assert {r["query_id"] for r in catalog.Q["hybrid_search"](spark, D).collect()} == {q for q, _ in lexical}


def test_lookups_take_every_name_of_a_query(spark):
    names, chunk_ids = {}, {}
    for r in catalog.Q["entity_lookup_or"](spark, D).collect():
        names.setdefault(r["query_id"], {})[r["name"]] = r["type"]
        chunk_ids.setdefault((r["query_id"], r["name"]), set()).add(r["chunk_id"])
    want = set()
    for q, types in names.items():
        shared = set.intersection(*(chunk_ids[q, n] for n in types)) or {-1}
        want |= {(q, n, c) for n, t in types.items() if t == "entity" for c in shared}
    got = catalog.Q["entity_lookup_and"](spark, D).collect()
    assert {(r["query_id"], r["name"], r["chunk_id"]) for r in got} == want and max(r["name_pos"] for r in got) > 2
    contexts = {(r["query_id"], r["chunk_id"]) for r in catalog.Q["entity_context"](spark, D).collect()}
    assert contexts == {(q, c) for (q, _), cs in chunk_ids.items() for c in cs}


def test_dictionary_keeps_frequent_names(spark):
    docs = [(i, "everywhere" + (" sometimes" if i < 3 else ""), "s", "en") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    path = f"{tempfile.mkdtemp()}/t"
    df.write.parquet(f"{path}/documents.parquet")
    assert {tuple(r) for r in catalog.Q["entity_known"](spark, path).collect()} == {("everywhere", "entity", 60), ("sometimes", "concept", 3)}
    assert tuple(catalog.Q["struct_stats"](spark, path).first()) == (2, 1, 1, 63)


def test_links_need_no_bound_of_names(spark, monkeypatch):
    names = linking.load_names(catalog.dictionary(spark, D)[0].where("type = 'entity'"))
    want = {(r["chunk_id"], r["n_linked"], hashlib.md5(r["content"].encode()).hexdigest()) for r in linking.annotate(catalog.chunks(spark, D), names).collect()}
    monkeypatch.setattr(linking, "MAX_NAMES", 5)
    assert {tuple(r) for r in catalog.Q["link_annotation"](spark, D).collect()} == want


@pytest.mark.parametrize("bound", [200_000, 5])
def test_joined_names_equal_broadcast_ones(spark, monkeypatch, bound):
    rows = [(1, "data base, data; metadata [[data]] C++ 中文字 x-y _id"), (1, "other 中文 (über) a-data"), (None, "data"), (2, None), (3, ""), (4, "überdata dataü C+++ + --- 文")]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string")
    entries = spark.createDataFrame([(n,) for n in ["data base", "data", "C++", "中文", "über", "ata", "", "+", "--", "x-y", "_id", "文字", "dataü", "data", None]], "name string")
    want = sorted(map(repr, linking.annotate(chunks, linking.load_names(entries)).collect()))
    monkeypatch.setattr(linking, "MAX_NAMES", bound)
    assert sorted(map(repr, linking.annotate_joined(chunks, entries).collect())) == want


def test_a_table_rewritten_under_its_path_gives_new_answers(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for n in (200, 20):
        docs.limit(n).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        assert catalog.Q["corpus_stats"](spark, str(tmp_path)).first()["n"] == docs.limit(n).where("trim(text) <> ''").count()
    again = catalog.text_index(spark, str(tmp_path)).postings.inputFiles()
    assert again == catalog.text_index(spark, str(tmp_path)).postings.inputFiles()  # an unchanged table's index is built once
