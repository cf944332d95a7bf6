import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.streaming.cache import SemanticCache
from lodestone.streaming.cache_table import CacheTable

ROW = "query_id long, query string, embedding array<double>, policy string, entities array<string>"


def stand_in(rows):
    """What a search would give: a row names the query that was asked."""
    return rows.select("query_id", F.concat(F.lit("r"), F.col("query_id").cast("string")).alias("results"))


def expected(cache, rows, version):
    """The same batch asked of the driver's cache: lookups first, then one save a key."""
    out, missed = {}, {}
    for i, query, e, policy, names in rows:
        hit = cache.get(query or "", e, version, policy, names)
        if hit is None:
            missed.setdefault(cache.key(query or "", version, policy, names), []).append((i, e))
        else:
            out[i] = hit
    for key, asked in missed.items():
        i, e = asked[0]
        cache.put(key[0], e, version, key[2], key[3], f"r{i}")
        out |= {j: f"r{i}" for j, _ in asked}
    return out


def test_equals_the_drivers_cache_on_random_batches(spark, tmp_path):
    rng = np.random.default_rng(8)
    table, cache, tiers = CacheTable(spark, str(tmp_path / "cache"), capacity=9), SemanticCache(capacity=9), set()
    places = rng.normal(size=(14, 5))
    for batch in range(6):
        version, rows = "v1" if batch < 4 else "v2", []
        for i in range(12):
            k = int(rng.integers(0, 14))
            e = None if rng.random() < 0.1 else (places[k] + rng.normal(size=5) * rng.choice([0.02, 0.3])).tolist()
            rows.append((batch * 100 + i, f" Q{k}" if rng.random() < 0.5 else f"q{k} {i % 3}", e, f"p{int(rng.integers(0, 2))}", ["b", "a"][: int(rng.integers(0, 3))]))
        got = table.answer(spark.createDataFrame(rows, ROW), version, stand_in).collect()
        assert {r["query_id"]: r["results"] for r in got} == expected(cache, rows, version) and len(got) == len(rows)
        tiers |= {r["tier"] for r in got}
        assert {r["results"] for r in table.state().collect()} == {v for _, v in cache.rows.values()}
    assert tiers == {"exact", "near", "searched"} and table.batches() == [5, 6]


def test_a_batch_that_fails_leaves_the_last_state(spark, tmp_path):
    table = CacheTable(spark, str(tmp_path / "cache"))
    one = spark.createDataFrame([(1, "a", [1.0, 0.0], "p", None), (2, None, None, None, None)], ROW)
    assert {r["tier"] for r in table.answer(one, "v", stand_in).collect()} == {"searched"}

    def broken(rows):
        raise RuntimeError("no search today")

    with pytest.raises(RuntimeError):
        table.answer(spark.createDataFrame([(3, "b", [0.0, 1.0], "p", [])], ROW), "v", broken)
    again = table.answer(one, "v", lambda rows: stand_in(rows.where("query <> 'none'")))
    assert {(r["query_id"], r["results"], r["tier"]) for r in again.collect()} == {(1, "r1", "exact"), (2, "r2", "exact")}
    none = table.answer(one.where("false"), "v", stand_in)
    assert none.isEmpty() and table.state().count() == 2


def test_rows_without_an_answer_are_not_saved(spark, tmp_path):
    table = CacheTable(spark, str(tmp_path / "cache"))
    two = spark.createDataFrame([(1, "a", None, "p", []), (2, "b", None, "p", [])], ROW)
    got = table.answer(two, "v", lambda rows: stand_in(rows.where("query_id = 1")))
    assert {(r["query_id"], r["results"]) for r in got.collect()} == {(1, "r1"), (2, None)}
    assert [r["key_query"] for r in table.state().collect()] == ["a"]
