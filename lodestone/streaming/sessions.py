"""Streaming: sessions with a time to live, and incremental merges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_sessions(events: DataFrame, minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """Sessions of `events(user_id, ts)`, closed after `minutes` without an event; late events beyond `late` are dropped."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", f"{minutes} minutes").alias("w"))
        .agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("expires"), "events")
    )


def merge_stream(changes: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Run `merge` on every micro-batch of changed documents until the source is drained."""
    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
