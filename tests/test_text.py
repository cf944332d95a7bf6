"""Parsing, cleaning, chunking and highlighting on inline fixtures."""

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.tokenize import DictionaryTokenizer
from lodestone.operators import chunking


def col(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_filename(spark):
    assert tuple(col(spark, "big_co_proj_report_2024.md", T.filename_metadata)) == ("big_co", "proj", "report", "2024")
    assert tuple(col(spark, "a_b.md", T.filename_metadata)) == ("", "", "", "")


def test_title_links_tokens(spark):
    t = lambda x: T.title(x, F.lit("file"))
    assert col(spark, "# Head\nx", t) == "Head" and col(spark, "| a |\n# Later", t) == "Later" and col(spark, "---\nx", t) == "file" and col(spark, "plain\n# x", t) == "plain"
    assert col(spark, "[[ a ]] [[b]] [[a]]", T.wiki_links) == ["a", "b"] and col(spark, "x [[a]]", T.strip_links) == "x a"
    assert col(spark, "中文字abcd", T.estimate_tokens) == 3


def test_clean(spark):
    dirty = "﻿---\nk: v\n---\n<!-- c -->a​b：c，1\r\n\r\n\r\n\r\nx／y\n"
    r = col(spark, dirty, T.cleaned)
    assert r["content"] == "ab:c,1\n\nx/y" and r["warnings"] == ["large reduction"]
    assert col(spark, "", T.cleaned)["ratio"] == 0.0


def test_highlight(spark):
    h = lambda x: T.highlight(x, F.lit("needle"), 5, 20)
    assert "**needle**" in col(spark, "zzz needle here", h)


def test_chunker():
    assert chunking.chunk_text("d", "") == []
    long = " ".join(f"Sentence number {i} is here." for i in range(120))
    got = chunking.chunk_text("d", long)
    assert len(got) > 2 and all(len(c["content"]) <= 1100 for c in got) and [c["chunk_index"] for c in got] == list(range(len(got)))
    table = "| a | b |\n" * 6
    assert chunking.is_table(table) and chunking.paragraphs("| a |\n\n| b |\n\ntext") == ["| a |\n| b |", "text"]
    small = chunking.chunk_text("d", "## A\nshort one.\n\n## B\nshort two.")
    assert len(small) == 1 and small[0]["id"] == "d_0"


def test_windows(spark):
    d = spark.createDataFrame([(1, "x" * 1600), (2, "y" * 800), (3, " ")], "doc_id long, content string")
    got = {(r["doc_id"], r["chunk_index"]): len(r["content"]) for r in chunking.sliding(d).collect()}
    assert got == {(1, 0): 800, (1, 1): 800, (1, 2): 200, (2, 0): 800}


def test_dictionary_tokenizer():
    assert DictionaryTokenizer({"data base": 1, "database": 100, "data": 50}).cut("databaseX") == ["database", "x"]
