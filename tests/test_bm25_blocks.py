"""The search by blocks against scores worked out one by one, and its plan."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from lodestone.operators import bm25


def test_blocks_of_any_cut_give_the_k_best(monkeypatch):
    monkeypatch.setattr(bm25, "CHUNKS", 3)
    monkeypatch.setattr(bm25, "PIECE", 4)
    monkeypatch.setattr(bm25, "HELD", 6)
    rng = np.random.default_rng(4)
    tf = {(f"c{i:02}", int(n)): int(rng.integers(1, 4)) for i in range(40) for n in rng.choice(9, rng.integers(0, 6), replace=False)}
    tf |= {(f"c{i:02}", n): 2 for i in range(33, 40) for n in (0, 1)}  # ties
    dl = {f"c{i:02}": int(rng.integers(3, 30)) for i in range(33)} | {f"c{i}": 9 for i in range(33, 39)}  # the last one's length is unknown
    asked = [{"query_id": q, "no": int(n), "idf": 0.3 + n / 7} for q in range(5) for n in rng.choice(9, 3, replace=False)]
    rows = sorted([(c, n, v) for (c, n), v in tf.items()] + [(c, -1, v) for c, v in dl.items()])
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + 5])], ["chunk_id", "no", "value"]) for i in range(0, len(rows), 5)]
    blocks = list(bm25._packed(iter(batches)))
    assert [c for b in blocks for c in b.column(0).to_pylist()[0]] == sorted({c for c, _, _ in rows}) and len(blocks) > 10
    pairs = [pa.RecordBatch.from_arrays([*b.columns, pa.array([asked]), pa.array([11.0])], [*b.schema.names, "asked", "avgdl"]) for b in blocks]
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("chunk_id", T.StringType()), T.StructField("score", T.DoubleType())])
    got = [tuple(r.values()) for b in bm25._Scored(4, 1.5, 0.75, schema)(iter(pairs)) for r in b.to_pylist()]
    for q in range(5):
        score = {}
        for a in asked:
            for c in (c for c, n in tf if a["query_id"] == q and n == a["no"]):
                t = tf[c, a["no"]]
                score[c] = score.get(c, 0) + a["idf"] * t * 2.5 / (t + 1.5 * (0.25 + 0.75 * dl.get(c, 11.0) / 11.0))
        want = sorted((-round(s, 6), c) for c, s in score.items())[:4]
        have = sorted({(-s, c) for i, c, s in got if i == q})[:4]
        assert [c for _, c in have] == [c for _, c in want] and all(math.isclose(x, y, abs_tol=1e-9) for (x, _), (y, _) in zip(have, want))


def test_no_row_for_each_query_and_chunk_is_shuffled(spark):
    chunks = spark.createDataFrame([(str(i), "a b c" if i % 2 else "a d") for i in range(30)], "chunk_id string, content string")
    queries = spark.createDataFrame([(q, "a b") for q in range(3)], "query_id long, query string")
    found = bm25.search(bm25.build_index(chunks), queries, 2)
    assert "keys=[query_id#" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["query_id"], r["chunk_id"], r["pos"]) for r in found.collect()) == [(q, c, p) for q in range(3) for p, c in ((1, "1"), (2, "11"))]
    assert bm25.search(bm25.build_index(chunks), queries.where("query_id < 0")).count() == 0
