"""The corpus pipeline against its stages by hand, on an empty table, and with further columns."""

from collections import Counter

import pytest

import corpus_pipeline
from lodestone.llm import mixing, ngram_join, pii, quality_rules, sentencepiece_sampling
from test_llm import DOCS, ROWS, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(*r[:5], *r[5:]) for r in ROWS] + [(300 + i, prose(300 + i, 60) + f"\nwrite to p{i}@mail.example.com now.", "en", "abc"[i % 3], 0, 0, 0) for i in range(40)]
    path = tmp_path_factory.mktemp("docs")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_run_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = quality_rules.keep(docs)
    one = ngram_join.keep_one(kept)
    clean = pii.redact(one)
    mixed = mixing.resample(clean)
    for stage in (kept, one, clean, mixed):
        assert stage.columns == docs.columns
    ids = lambda d: Counter(r["doc_id"] for r in d.collect())
    # each stage's decision takes effect on all the one before kept
    judged = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs).collect()}
    assert ids(kept) == Counter(i for i, *_ in [tuple(r) for r in docs.collect()] if judged[i])
    groups = {r["doc_id"]: r["component_id"] for r in ngram_join.link(kept).collect()}
    assert ids(one) == Counter(set(groups.values())) and 2 not in ids(one) and 1 in ids(one)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert sum("[email]" in t for t in texts.values()) >= 40 and not any("@mail.example.com" in t for t in texts.values())
    taken = {r["doc_id"]: r for r in mixing.mix(clean).collect()}
    assert set(ids(mixed)) <= set(taken) and sum(r["taken"] for r in taken.values()) > 0
    got = Counter((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == Counter((r["doc_id"], r["ids_sha256"]) for r in sentencepiece_sampling.encode(mixed).collect()) and sum(got.values()) == mixed.count()


def test_documents_that_share_an_id_both_stay(spark):
    rows = [(1, prose(1, 30), "x"), (1, prose(2, 30), "y"), (1, prose(1, 30), "x"), (2, prose(1, 30) + " more", "z"), (None, prose(2, 30), "n"), (3, None, "a"), (3, None, "a"), (4, " ", "b")]
    got = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, more string")).collect()
    assert Counter((r["doc_id"], r["text"], r["more"]) for r in got) == Counter([rows[0], rows[1], rows[5], rows[6], rows[7]])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
