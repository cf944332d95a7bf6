"""Chat events as ordered rows, and history compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COMPACT_AT, KEEP_LAST = 6, 2


def chat_events(answers: DataFrame) -> DataFrame:
    """(session_id, seq, type, payload) of `answers(session_id, method, context, answer, status)`.

    method, context, the answer's tokens, done; status `no-llm` or `error` ends without done.
    """
    tokens = F.filter(F.split("answer", r"(?<=\s)"), lambda t: t != "")
    event = lambda kind, payload: F.struct(F.lit(kind).alias("type"), payload.alias("payload"))
    head = F.array(event("method", F.col("method")), event("context", F.col("context")))
    body = F.transform(tokens, lambda t: event("token", t))
    end = F.when(F.col("status") == "ok", F.concat(head, body, F.array(event("done", F.lit(""))))).when(F.col("status") == "no-llm", F.concat(head, F.array(event("no-llm", F.lit(""))))).otherwise(F.concat(head, F.array(event("error", F.col("status")))))
    return answers.select("session_id", F.posexplode(end).alias("seq", "e")).select("session_id", "seq", "e.type", "e.payload")


def compact(messages: DataFrame, summaries: DataFrame) -> DataFrame:
    """Sessions of `COMPACT_AT` or more messages keep the last `KEEP_LAST` behind their summary (role `summary`, turn -1).

    A session without a summary keeps all its messages.
    """
    by = Window.partitionBy("session_id")
    m = messages.withColumns({"size": F.count("*").over(by), "age": F.row_number().over(by.orderBy(F.desc("turn")))}).join(summaries, "session_id", "left")
    full = (F.col("size") >= COMPACT_AT) & F.col("summary").isNotNull()
    kept = m.where(~full | (F.col("age") <= KEEP_LAST)).select("session_id", "turn", "role", "content")
    heads = m.where(full & (F.col("age") == 1)).select("session_id", F.lit(-1).cast("long").alias("turn"), F.lit("summary").alias("role"), F.col("summary").alias("content"))
    return kept.unionByName(heads)
