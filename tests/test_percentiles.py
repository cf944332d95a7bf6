"""Exact order statistics against sorting, over groups, ties, wide ranges and values that aren't numbers."""

import math

import numpy as np

from lodestone.operators import corpus


def test_order_statistics_equal_sorting(spark, monkeypatch):
    monkeypatch.setattr(corpus, "FEW", 20)
    monkeypatch.setattr(corpus, "CELLS", 64)
    rng = np.random.default_rng(6)
    groups = {
        "normal": rng.normal(size=700).tolist(), "wide": (10.0 ** rng.uniform(-300, 300, 300)).tolist(), "ties": [1.0] * 400 + [2.0] * 50 + rng.uniform(1, 2, 60).tolist(),
        "one": [3.5], "odd": [math.inf, -math.inf, math.nan, 1.0, 2.0, -1.7e308, 1.7e308], None: rng.integers(0, 9, 100).astype(float).tolist(),
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("one", None)]
    got = {r["kind"]: r for r in corpus.percentiles_by_index(spark.createDataFrame(rows, "kind string, v double").repartition(4), "v", 0.0, 0.5, 0.95, 0.99, group=("kind",)).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        order = sorted(vs, key=lambda v: (math.isnan(v), v))
        for p in (0.0, 0.5, 0.95, 0.99):
            want, have = order[min(math.floor(len(vs) * p), len(vs) - 1)], got[g][f"p{round(p * 100)}"]
            assert want == have or math.isnan(want) and math.isnan(have), (g, p)
        assert got[g]["n"] == len(vs)


def test_whole_numbers_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(corpus, "FEW", 3)
    big = [(1 << 55) + i for i in range(50)]  # beyond what a double can tell apart
    df = spark.createDataFrame([(v,) for v in big], "v long")
    r = corpus.percentiles_by_index(df, "v", 0.5, 0.9).first()
    assert (r["p50"], r["p90"], r["n"]) == (big[25], big[45], 50)
    none = corpus.percentiles_by_index(df.where("v < 0"), "v", 0.5).collect()
    assert len(none) == 1 and none[0]["n"] is None and none[0]["p50"] is None
