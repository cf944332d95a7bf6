"""Embedding whitening against NumPy over all rows, whole numbers against Python's, and odd tables."""

import math

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import embedding_whitening as W

SCHEMA = "vec_id long, embedding array<float>, whitened string, component int, n long"


def made(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else list(v), "x", 1, 1) for i, v in vectors], SCHEMA).repartition(3)


def expected(kept):
    d = max(map(len, kept))
    x = [[math.floor(1024 * c) + 100000 for c in [*np.array(v, np.float32).astype(float).tolist(), *[0.0] * (d - len(v))]] for v in kept]
    n, s = len(x), [sum(col) for col in zip(*x, strict=True)]
    c = np.array([[(n * a - b) / n for a, b in zip(r, s, strict=True)] for r in x])
    e, u = np.linalg.eigh(c.T @ c / n)
    return n, [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x], c, e[::-1], u[:, ::-1]


def result(spark, tmp_path, vectors):
    made(spark, vectors).write.parquet(str(tmp_path / "embeddings.parquet"))
    return W.op11_embedding_whitening(spark, str(tmp_path)).collect()


def test_whitening_equals_numpy(spark, tmp_path):
    rng = np.random.default_rng(11)
    mix = rng.normal(size=(12, 12))
    rows = [(i, (rng.normal(size=12) @ mix).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400, None), (401, [math.nan] * 12), (402, [1.0] * 11 + [None]), (403, [math.inf] + [0.0] * 11), (404, [0.5] * 7), (405, []), (7, rows[7][1])]
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, deviation, c, e, u = expected([v for _, v in kept])
    got = result(spark, tmp_path, rows)
    assert len(got) == 8 * len(kept) and {r["n"] for r in got} == {n} and {r["vec_id"] for r in got} == {i for i, _ in kept}
    assert max(r["identity_error"] for r in got) < 1e-9 and {r["component"] for r in got} == set(range(1, 9))
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    for k in range(1, 9):
        want, have = c @ u[:, k - 1] / math.sqrt(e[k - 1]), np.array([by[i][k]["whitened"] for i, _ in kept])
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < 1e-9
        assert abs(by[0][k]["explained"] / (e[k - 1] / e.sum()) - 1) < 1e-9
    assert [by[i][1]["deviation"] for i, _ in kept] == deviation


def test_partitionings_agree_and_model_is_small(spark):
    rng = np.random.default_rng(3)
    v = made(spark, [(i, rng.normal(size=5).tolist()) for i in range(300)])
    a, b = W.fit(v), W.fit(v.repartition(11))
    assert a.sums == b.sums and a.n == b.n == 300 and a.components.shape == (5, 5)
    assert np.allclose(a.variances, b.variances, rtol=1e-12) and np.allclose(a.components.T @ a.components, np.eye(5), atol=1e-12)


def test_whole_numbers_of_any_size():
    for x, n in (([[5, -7], [1 << 20, 3]], 2), ([[1 << 52, -(1 << 52)], [0, 0], [3, 4]], 3), ([[100_000 + 900, 99_000]], 10**10)):
        s = [sum(c) for c in zip(*x, strict=True)] if n == len(x) else [n * 100_000 + 17, n * 99_500 - 3]
        assert [int(v) for v in W.deviations(np.array(x, np.int64), n, s)] == [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]


def test_extreme_entries_and_missing_variance(spark, tmp_path):
    big = made(spark, [(1, [1e38, 0.0]), (2, [-1e38, 0.0]), (3, [0.0, 0.0])])
    m = W.fit(big)
    assert m.sums == [3 * W.SHIFT, 3 * W.SHIFT] and len(m.variances) == 1  # the second dimension has no variance
    assert W.fit(made(spark, [])) is None and W.fit(made(spark, [(1, None)])) is None and W.fit(made(spark, [(1, [])])) is None
    same = result(spark, tmp_path, [(i, [1.0, 2.0]) for i in range(5)])
    assert same == []


def test_rank_below_eight(spark, tmp_path):
    rows = [(None if i == 3 else i, [float(i), float(i * i % 7), 0.0]) for i in range(20)]
    got = result(spark, tmp_path, rows)
    assert len(got) == 40 and {r["component"] for r in got} == {1, 2} and sum(r["vec_id"] is None for r in got) == 2
    assert max(r["identity_error"] for r in got) < 1e-9 and abs(sum({r["component"]: r["explained"] for r in got}.values()) - 1) < 1e-9


def test_empty_table(spark, tmp_path):
    made(spark, []).write.parquet(str(tmp_path / "embeddings.parquet"))
    df = W.op11_embedding_whitening(spark, str(tmp_path))
    assert df.count() == 0 and dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert df.where(F.col("component") > 0).count() == 0
