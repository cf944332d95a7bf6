"""Chat sessions as keyed state: a message or a touch renews a session, a timer closes it, its recent history lives in the state.

A session is a run of events of one id with no gap of more than the time to live. Events may come in any order within
the watermark's delay: a key holds all of its runs that can still grow, an event joins the runs it touches, and a
run is closed, emitted once and forgotten when the watermark has passed its last event by the time to live.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

MAX_MESSAGES, TTL_MINUTES = 10, 30
EVENT = "session_id string, ts timestamp, seq long, kind string, role string, content string"
CLOSED = "session_id string, started timestamp, ended timestamp, messages long, roles array<string>, contents array<string>"
#: RocksDB keeps state on disk beside the executor, its changes in the checkpoint.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Run = tuple[int, int, int, list]  # first and last event (ms), number of messages, the last of them as (ms, seq, role, content)


def joined(runs: list[Run], ttl: int) -> list[Run]:
    """Runs with no more than `ttl` between them become one; its history is the last MAX_MESSAGES messages of all."""
    out: list[Run] = []
    for r in sorted(runs, key=lambda r: (r[0], r[1])):
        if out and r[0] - out[-1][1] <= ttl:
            a = out.pop()
            r = (a[0], max(a[1], r[1]), a[2] + r[2], sorted(a[3] + r[3], key=lambda m: m[:2])[-MAX_MESSAGES:])
        out.append(r)
    return out


def runs_of(rows: pd.DataFrame, ttl: int) -> list[Run]:
    """The runs of a batch of one key's events."""
    ms = (rows["ts"].astype("datetime64[us]").astype("int64") // 1000).to_numpy()
    rows = rows.assign(ms=ms).sort_values(["ms", "seq"], kind="stable")
    out = []
    for _, g in rows.groupby((rows["ms"].diff() > ttl).cumsum(), sort=False):
        said = g[g["kind"] == "message"]
        last = said.tail(MAX_MESSAGES)
        out.append((int(g["ms"].iloc[0]), int(g["ms"].iloc[-1]), len(said), list(zip(last["ms"].tolist(), last["seq"].tolist(), last["role"].tolist(), last["content"].tolist(), strict=True))))
    return out


class Sessions(StatefulProcessor):
    def __init__(self, minutes: int = TTL_MINUTES):
        self.ttl = minutes * 60_000

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, messages long, history string")

    def _held(self) -> list[Run]:
        return [(r[0], r[1], r[2], [tuple(m) for m in json.loads(r[3])]) for r in self.open.get()] if self.open.exists() else []

    def _hold(self, runs: list[Run]) -> None:
        """Keep `runs` and one timer, for the first of them that can expire."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if runs:
            self.open.put([(r[0], r[1], r[2], json.dumps(r[3])) for r in runs])
            self.handle.registerTimer(min(r[1] for r in runs) + self.ttl + 1)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        runs = self._held()
        for part in rows:
            runs = joined(runs + runs_of(part, self.ttl), self.ttl)
        self._hold(runs)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, runs = timerValues.getCurrentWatermarkInMs(), self._held()  # one timer closes all that have expired
        over = [r for r in runs if r[1] + self.ttl < now]
        self._hold([r for r in runs if r[1] + self.ttl >= now])
        if over:
            at = lambda ms: pd.to_datetime(pd.Series(ms), unit="ms")
            yield pd.DataFrame({
                "session_id": [key[0]] * len(over), "started": at([r[0] for r in over]), "ended": at([r[1] for r in over]), "messages": [r[2] for r in over],
                "roles": [[m[2] for m in r[3]] for r in over], "contents": [[m[3] for m in r[3]] for r in over],
            })

    def close(self) -> None:
        pass


def closed_sessions(events: DataFrame, minutes: int = TTL_MINUTES, late: str = "10 minutes") -> DataFrame:
    """The stream of closed sessions of a stream of `events` (EVENT); events later than `late` are dropped. Sets the session's state store."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.where("session_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    return rows.groupBy("session_id").transformWithStateInPandas(Sessions(minutes), CLOSED, "append", "eventTime")


def batch_sessions(events: DataFrame, minutes: int = TTL_MINUTES) -> DataFrame:
    """The same sessions of a finished table of events, with windows."""
    by = Window.partitionBy("session_id").orderBy("ts", "seq")
    ms = F.unix_millis("ts")
    rows = events.where("session_id IS NOT NULL AND ts IS NOT NULL").withColumn("new", F.coalesce((ms - F.lag(ms).over(by) > minutes * 60_000).cast("int"), F.lit(0)))
    rows = rows.withColumn("run", F.sum("new").over(by))
    last = Window.partitionBy("session_id", "run", F.col("kind") == "message").orderBy(F.desc("ts"), F.desc("seq"))
    rows = rows.withColumn("age", F.row_number().over(last))
    kept = F.when((F.col("kind") == "message") & (F.col("age") <= MAX_MESSAGES), F.struct("ts", "seq", "role", "content"))
    out = rows.groupBy("session_id", "run").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count_if(F.col("kind") == "message").alias("messages"), F.array_sort(F.collect_list(kept)).alias("h"))
    return out.select("session_id", "started", "ended", "messages", F.col("h.role").alias("roles"), F.col("h.content").alias("contents"))
