"""The versioned build: merges equal a build of the final documents, replays change nothing, readers see whole versions."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import bm25
from lodestone.sources import versions

TEXT = "alpha beta [[Link {0}]] gamma {0} " * 60


def change(i, seq, text, op="upsert", vector=None):
    return (f"d{i}", seq, op, None if text is None else text, vector)


def frame(spark, rows):
    return spark.createDataFrame(rows, versions.CHANGE)


def content(store, name, version=None):
    t = store.table(name, version)
    return sorted(map(repr, t.select(sorted(t.columns)).collect()))


BATCHES = [
    [change(i, i, TEXT.format(i), vector=[1.0, float(i)]) for i in range(12)] + [change(3, 100, "newer of one batch"), change(3, 99, "older")],
    [change(1, 200, None, "delete"), change(2, 201, "short"), change(40, 202, TEXT.format(40)), change(77, 203, None, "delete")],
    [change(2, 300, "short"), change(4, 301, "")],
]
FINAL = [change(i, 0, TEXT.format(i), vector=[1.0, float(i)]) for i in (0, *range(5, 12))] + [change(2, 0, "short"), change(3, 0, "newer of one batch"), change(4, 0, ""), change(40, 0, TEXT.format(40))]


def test_merges_equal_one_build_and_old_versions_stay(spark, tmp_path):
    store = versions.Store(spark, str(tmp_path / "a"), 8)
    assert store.manifest()["version"] == 0 and store.table("documents").count() == 0 and store.ready() == {}
    store.merge(frame(spark, BATCHES[0]), 0)
    first, held = content(store, "postings"), store.table("documents")
    before = {r["doc_id"] for r in held.collect()}
    for n, b in enumerate(BATCHES[1:], 1):
        store.merge(frame(spark, b), n)
    once = versions.Store(spark, str(tmp_path / "b"), 8)
    once.merge(frame(spark, FINAL), 0)
    for name in versions.SCHEMAS:
        assert content(store, name) == content(once, name), name
    assert store.manifest()["version"] == 3 and store.ready() == once.ready() and store.ready()["documents"] == 12
    assert content(store, "postings", 1) == first and {r["doc_id"] for r in held.collect()} == before  # an open reader keeps its version
    q = spark.createDataFrame([(1, "gamma 40"), (2, "newer")], "query_id long, query string")
    found = lambda s: sorted(map(tuple, bm25.search(s.text_index(), q, 5).collect()))
    assert found(store) == found(once) and found(store)
    kept = store.manifest()["tables"]["documents"]
    assert len({f.split("/")[0] for f in kept.values()}) > 1  # buckets without a change stay where they were
    gone = store.vacuum(1)
    assert gone and content(store, "postings") == content(once, "postings")
    with pytest.raises(ValueError):
        store.table("postings", 1)


def test_replays_and_crashes(spark, tmp_path, monkeypatch):
    store = versions.Store(spark, str(tmp_path / "s"), 4)
    m = store.merge(frame(spark, BATCHES[0]), 0)
    assert store.merge(frame(spark, BATCHES[0]), 0) == m == store.merge(frame(spark, BATCHES[1]), 0)  # by its number, whatever it holds
    again = store.merge(frame(spark, [change(5, 400, TEXT.format(5), vector=[1.0, 5.0])]), 1)
    assert again["version"] == 1  # the same document changes nothing
    published = versions.Store._publish

    def dies(self, manifest):
        raise OSError("lost")

    monkeypatch.setattr(versions.Store, "_publish", dies)
    with pytest.raises(OSError):
        store.merge(frame(spark, BATCHES[1]), 2)
    monkeypatch.setattr(versions.Store, "_publish", published)
    assert store.manifest()["version"] == 1 and store.table("documents").count() == 12  # half-written folders aren't seen
    after = store.merge(frame(spark, BATCHES[1]), 2)
    assert after["version"] == 2 and after["applied"] == {"changes": 2}
    with pytest.raises(versions.Conflict):
        store._publish(after | {"rows": {}})
    assert store.vacuum(2) and store.vacuum(2) == [] and store.table("documents").count() == store.ready()["documents"] == 12


def test_stream_with_restart(spark, tmp_path):
    store, path = versions.Store(spark, str(tmp_path / "s"), 4), str(tmp_path / "in")
    for n, b in enumerate(BATCHES):
        frame(spark, b).coalesce(1).write.mode("append").parquet(path)
        if n != 1:  # two batches wait for the second run
            q = store.follow(spark.readStream.schema(versions.CHANGE).option("maxFilesPerTrigger", 1).parquet(path), str(tmp_path / "c"))
            assert q.awaitTermination(240) and q.exception() is None
    once = versions.Store(spark, str(tmp_path / "b"), 4)
    once.merge(frame(spark, FINAL), 0)
    for name in versions.SCHEMAS:
        assert content(store, name) == content(once, name), name
    assert store.manifest()["applied"] == {"changes": 2} and store.table("edges").where(F.col("name") == "Link 40").count() == 1
