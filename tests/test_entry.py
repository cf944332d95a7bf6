"""The entry module imports and answers with or without the training-data operators."""

import __spark_entry__ as entry


def test_registry():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and "hybrid_search" in q


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "chunk_id", "doc_id", "score", "source"] and df.count() > 0
