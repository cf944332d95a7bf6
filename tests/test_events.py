"""Chat events, compaction, table checks, streaming sessions, staging and manifest."""

import pytest

from lodestone.operators import corpus
from lodestone.sources import tables
from lodestone.streaming import events, sessions


def test_chat_events(spark):
    a = spark.createDataFrame([(1, "rrf", "ctx", "a b", "ok"), (2, "rrf", "ctx", "", "no-llm"), (3, "rrf", "ctx", "", "boom")], "session_id long, method string, context string, answer string, status string")
    got = {}
    for r in events.chat_events(a).orderBy("session_id", "seq").collect():
        got.setdefault(r["session_id"], []).append(r["type"])
    assert got == {1: ["method", "context", "token", "token", "done"], 2: ["method", "context", "no-llm"], 3: ["method", "context", "error"]}


def test_compaction(spark):
    m = spark.createDataFrame([(s, t, "user", f"{t}") for s, n in ((1, 6), (2, 5), (3, 7)) for t in range(n)], "session_id long, turn long, role string, content string")
    out = events.compact(m, spark.createDataFrame([(1, "sum"), (2, "sum")], "session_id long, summary string"))
    got = {r["session_id"]: r["n"] for r in out.groupBy("session_id").count().withColumnRenamed("count", "n").collect()}
    assert got == {1: 3, 2: 5, 3: 7}


def test_broken_tables(spark):
    c = spark.createDataFrame([(1, "| a |\n|---|\n| b |"), (1, "x\n| a |\ny"), (2, "plain")], "sample_id long, content string")
    r = corpus.truncation_rates(c).first()
    assert (r["chunk_rate"], r["sample_rate"]) == (0.333333, 0.5)
    assert tuple(corpus.chunk_report(c.limit(0)).first()) == (0, 0, 0, 0)


def test_sources(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a_b_c_d.md").write_text("# T\nx")
    (tmp_path / "raw" / "skip.txt").write_text("no")
    assert [(r["doc_key"], r["content"]) for r in tables.scan_markdown(spark, str(tmp_path / "raw"), "raw_").collect()] == [("raw_a_b_c_d", "# T\nx")]
    m = str(tmp_path / "manifest.json")
    with pytest.raises(ValueError):
        tables.write_manifest(m, {"vectors": {"ready": True}})
    ready = {s: {"ready": True} for s in ("vectors", "text", "chunks", "parents")}
    assert tables.read_manifest(m) is None and tables.write_manifest(m, ready)["index_version"] == 1 and tables.write_manifest(m, ready)["index_version"] == 2
    tables.write_staging(spark.createDataFrame([(1, "x")], "id long, content string"), str(tmp_path / "staging"))
    assert tables.read_staging(spark, str(tmp_path / "staging"), "id long, content string").count() == 1


def test_streaming_sessions(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "user_id long, ts string").selectExpr("user_id", "cast(ts as timestamp) as ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    live = sessions.live_sessions(spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in")))
    q = live.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["user_id"], r["events"]) for r in spark.table("live").collect()} >= {(1, 2), (1, 1)}
