"""Sessions as keyed state over several batches, restarted in between, against the batch query."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from lodestone.streaming import state


def run(spark, path, checkpoint, out):
    live = state.closed_sessions(spark.readStream.schema(state.EVENT).option("maxFilesPerTrigger", 1).parquet(path), 30, "20 minutes")
    q = live.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240) and q.exception() is None


def rows(df):
    return sorted((r["session_id"], r["started"], r["ended"], r["messages"], tuple(r["roles"]), tuple(r["contents"])) for r in df.collect())


def test_batches_with_a_restart_equal_the_batch_query(spark, tmp_path):
    rng, t0 = np.random.default_rng(2), dt.datetime(2024, 1, 1)
    made, at = [], {}
    for n in range(240):
        who = f"s{rng.integers(0, 6)}"
        at[who] = at.get(who, t0) + dt.timedelta(seconds=int(rng.choice([20, 400, 1800, 1801, 5000], p=[0.4, 0.4, 0.1, 0.05, 0.05])))
        kind = "touch" if rng.random() < 0.3 else "message"
        made.append((who, at[who], n, kind, "user" if n % 2 else "assistant", f"text {n}"))
    made.append(("s0", t0, 9000, "message", "user", None))
    made.sort(key=lambda r: r[1])
    order = sorted(range(len(made)), key=lambda i: made[i][1] + dt.timedelta(minutes=float(rng.uniform(0, 15))))  # out of order, within the delay
    path, end = str(tmp_path / "in"), dt.datetime(2024, 2, 1)
    def write(part):
        spark.createDataFrame(part, state.EVENT).coalesce(1).write.mode("append").parquet(path)

    write([made[i] for i in order[:80]])
    write([made[i] for i in order[80:120]])
    run(spark, path, str(tmp_path / "c"), str(tmp_path / "out"))
    before = spark.read.parquet(str(tmp_path / "out")).count()
    write([made[i] for i in order[120:]] + [(None, end, 1, "message", "user", "nobody")])
    for k in range(2):  # events that move the watermark, so that everything closes
        write([("clock", end + dt.timedelta(days=k), k, "touch", None, None)])
    run(spark, path, str(tmp_path / "c"), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).where("session_id <> 'clock'")
    want = state.batch_sessions(spark.createDataFrame(made, state.EVENT), 30)
    assert rows(got) == rows(want) and 0 < before < got.count()
    assert want.where(F.size("roles") == 10).count() > 0 and want.where("messages = 0").count() + want.where("messages > 10").count() > 0
    run(spark, path, str(tmp_path / "c"), str(tmp_path / "out"))  # nothing new: nothing is emitted again
    assert rows(spark.read.parquet(str(tmp_path / "out")).where("session_id <> 'clock'")) == rows(want)


def test_a_touch_bridges_two_messages(spark):
    t = dt.datetime(2024, 1, 1)
    made = [("a", t, 1, "message", "user", "x"), ("a", t + dt.timedelta(minutes=25), 2, "touch", None, None), ("a", t + dt.timedelta(minutes=50), 3, "message", "user", "y")]
    assert [r[3] for r in rows(state.batch_sessions(spark.createDataFrame(made, state.EVENT)))] == [2]
    assert [r[3] for r in rows(state.batch_sessions(spark.createDataFrame([made[0], made[2]], state.EVENT)))] == [1, 1]
    ms = 60_000
    assert state.joined([(0, 0, 1, [(0, 1, "u", "x")]), (50 * ms, 50 * ms, 1, [(50 * ms, 3, "u", "y")])], 30 * ms)[0][2] == 1
    assert state.joined([(50 * ms, 50 * ms, 1, []), (25 * ms, 25 * ms, 0, []), (0, 0, 1, [])], 30 * ms) == [(0, 50 * ms, 2, [])]
