"""Conversations, prompts, reranking and evaluation over batches."""

from __future__ import annotations

import re
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import lexicon
from lodestone.functions.text import strip_links
from lodestone.functions.tokenize import regex_tokens


class Embedder(Protocol):
    def __call__(self, texts: DataFrame) -> DataFrame: ...


class Reranker(Protocol):
    def __call__(self, results: DataFrame) -> DataFrame: ...


FOLLOW_UP = "|".join(lexicon.FOLLOW_UPS)


def follow_up(text: Column) -> Column:
    return F.trim(text).rlike(FOLLOW_UP)


def context(messages: DataFrame, last: int = 10, cut: int = 300) -> DataFrame:
    """(session_id, turn, role, content) of the last messages; assistant texts are cut."""
    recent = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    short = F.when((F.col("role") == "assistant") & (F.length("content") > cut), F.concat(F.substring("content", 1, cut), F.lit("..."))).otherwise(F.col("content"))
    return messages.withColumn("age", F.row_number().over(recent)).where(F.col("age") <= last).select("session_id", "turn", "role", short.alias("content"))


def pairs(messages: DataFrame) -> DataFrame:
    """User messages with the assistant message that follows at once."""
    order = Window.partitionBy("session_id").orderBy("turn")
    nxt = messages.withColumns({"next_role": F.lead("role").over(order), "answer": F.lead("content").over(order)})
    return nxt.where("role = 'user' AND next_role = 'assistant'").select("session_id", "turn", F.col("content").alias("question"), "answer")


def sessions(events: DataFrame, minutes: int = 30) -> DataFrame:
    """(user_id, session, start, end, events): a gap of `minutes` or more starts a session."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(by).cast("timestamp"))
    numbered = events.withColumn("new", F.coalesce((gap >= minutes * 60_000_000).cast("int"), F.lit(1))).withColumn("session", F.sum("new").over(by))
    return numbered.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events"))


def lexical_rerank(results: DataFrame, queries: DataFrame, n: int = 5, threshold: float = 0.5) -> DataFrame:
    """Stand-in reranker: share of query tokens found. At most n results stay untouched; otherwise those of
    `threshold` or more lead with their new score, and the n best remain. Every result is scored, so none is left to fill up with."""
    q = queries.select("query_id", F.array_distinct(regex_tokens(F.col("query"))).alias("qt"))
    text = F.substring(strip_links(F.col("content")), 1, 4000)
    r = results.join(q, "query_id").withColumn("size", F.count("*").over(Window.partitionBy("query_id")))
    rel = F.round(F.size(F.array_intersect("qt", F.array_distinct(regex_tokens(text)))) / F.greatest(F.size("qt"), F.lit(1)), 6)
    r = r.withColumn("relevance", F.when(F.col("size") > n, rel)).where("size <= %d OR relevance >= %f" % (n, threshold))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("relevance", "score")), "rank")
    return r.withColumn("reranked", F.row_number().over(order)).where(F.col("reranked") <= n).drop("qt", "size")


def rerank(results: DataFrame, scored: DataFrame, n: int = 5, threshold: float = 0.5) -> DataFrame:
    """(query_id, chunk_id, score, reranked) after a model scored some results, `scored(query_id, chunk_id, relevance)`.

    A query with at most n results, or without any scored one, keeps its first n. Otherwise results of `threshold` or more lead by
    relevance, and only results that the model did not return fill up to n, by their own score.
    """
    by = Window.partitionBy("query_id")
    r = results.select("query_id", "chunk_id", "score", "rank").join(scored, ["query_id", "chunk_id"], "left")
    r = r.withColumns({"size": F.count("*").over(by), "answers": F.count("relevance").over(by)})
    asis = (F.col("size") <= n) | (F.col("answers") == 0)
    r = r.where(asis | F.col("relevance").isNull() | (F.col("relevance") >= threshold))
    order = by.orderBy(F.when(asis, 0).when(F.col("relevance").isNotNull(), 1).otherwise(2), F.desc(F.when(asis, -F.col("rank")).otherwise(F.coalesce("relevance", "score"))), "rank")
    new = F.when(asis, F.col("score")).otherwise(F.coalesce("relevance", "score"))
    return r.withColumn("reranked", F.row_number().over(order)).where(F.col("reranked") <= n).select("query_id", "chunk_id", new.alias("score"), "reranked")


def context_blocks(results: DataFrame) -> DataFrame:
    """(query_id, context): results by score, each under a header with its title and its non-empty client, project, type and date."""
    label = {"client": "客户", "project": "项目", "doc_type": "类型", "date": "日期"}  # fixed values
    parts = F.concat_ws(" | ", *[F.when(F.col(c) != "", F.concat(F.lit(f"{x}: "), F.col(c))) for c, x in label.items()])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    head = F.concat(F.lit("### 文档 "), F.col("nr").cast("string"), F.lit(": "), F.col("title"), F.when(parts != "", F.concat(F.lit(" ("), parts, F.lit(")"))).otherwise(""))
    rows = results.withColumn("nr", F.row_number().over(order)).select("query_id", "nr", F.concat(head, F.lit("\n"), F.col("content")).alias("block"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nr", "block"))), lambda x: x["block"]), "\n\n---\n\n")  # a prompt's few results
    return rows.groupBy("query_id").agg(joined.alias("context"))


def filled(template: str, **values: Column) -> Column:
    """The template with `{name}` replaced by a column's text, in which nothing is taken for a place again."""
    return F.concat(*[values.get(x[1:-1], F.lit(x)) if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w+\})", template) if x])


def template_of(intent: Column, is_follow_up: Column) -> Column:
    """The template's name: a follow-up before a comparison before the base."""
    return F.when(is_follow_up, "followup").when(intent == "compare", "compare").otherwise("base")


def build(requests: DataFrame, templates: dict[str, str]) -> DataFrame:
    """`requests(query_id, query, context, entity_docs, history, intent, is_follow_up)` with `template`, `prompt` and `error`.

    Entity documents come before the semantic context, the history after it except in a follow-up's template, which places it itself.
    Texts are put in literally. Without a query or any context there is an error and no prompt.
    """
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    whole = F.concat_ws("\n\n", F.when(none("entity_docs") != "", F.col("entity_docs")), F.when(none("context") != "", F.col("context")))
    name = template_of(F.col("intent"), F.coalesce("is_follow_up", F.lit(False)))
    text = F.lit(None).cast("string")
    for key, value in templates.items():
        text = F.when(name == key, filled(value, query=none("query"), context=whole, history=none("history"))).otherwise(text)
    text = F.when((name != "followup") & (none("history") != ""), F.concat(text, F.lit("\n\n"), F.col("history"))).otherwise(text)
    bad = (none("query") == "") | (whole == "")
    return requests.withColumns({"template": name, "prompt": F.when(~bad, text), "error": F.when(bad, "no query or no context")})


def rewrite_names(entries: DataFrame, most: dict[str, int]) -> DataFrame:
    """(category, names): the most frequent names of each category, as many as `most` says, for a rewriting prompt."""
    order = Window.partitionBy("category").orderBy(F.desc("frequency"), "name")
    limit = F.lit(0)
    for category, n in most.items():
        limit = F.when(F.col("category") == category, n).otherwise(limit)
    top = entries.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit)
    return top.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("names"))


def history(messages: DataFrame, summaries: DataFrame, last: int = 10, cut: int = 300) -> DataFrame:
    """(session_id, history, has_follow_up): the summary, then the last messages as pairs of a question and the answer after it.

    A session is a follow-up's if the message before its last is an assistant's.
    """
    recent = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    m = messages.withColumn("age", F.row_number().over(recent)).where(F.col("age") <= last)
    order = Window.partitionBy("session_id").orderBy("turn")
    m = m.withColumns({"next_role": F.lead("role").over(order), "answer": F.lead("content").over(order)})
    short = F.concat(F.substring("answer", 1, cut), F.when(F.length("answer") > cut, "...").otherwise(""))
    pair = F.when(F.col("next_role") == "assistant", F.concat(F.lit("用户: "), F.col("content"), F.lit("\n助手: "), short)).otherwise(F.concat(F.lit("用户: "), F.col("content")))
    got = m.groupBy("session_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", pair.alias("p"))))), lambda x: x["p"]), "\n\n").alias("pairs"),
        F.coalesce(F.bool_or((F.col("age") == 2) & (F.col("role") == "assistant")), F.lit(False)).alias("has_follow_up"),
    )  # at most `last` messages a session
    text = F.concat(F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("## 对话历史摘要\n"), F.col("summary"), F.lit("\n\n"))).otherwise(""), F.when(F.col("pairs") != "", F.concat(F.lit("## 最近对话\n"), F.col("pairs"))).otherwise(""))
    return got.join(summaries, "session_id", "left").select("session_id", text.alias("history"), "has_follow_up")


def search_response(results: DataFrame, cut: int = 500) -> DataFrame:
    """Results as a search interface returns them: contents cut, with the number of results of the query."""
    return results.withColumns({"content": F.substring("content", 1, cut), "total": F.count("*").over(Window.partitionBy("query_id"))})


def prompts(results: DataFrame, queries: DataFrame, template: str = "{context}\n\nQuestion: {query}") -> DataFrame:
    """(query_id, prompt): results by score joined with rules, put into the template as literal text."""
    block = F.concat(F.lit("[doc "), F.col("doc_id").cast("string"), F.lit("]\n"), F.col("content"))
    joined = results.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("rank"), block.alias("b")))), lambda x: x["b"]), "\n---\n").alias("context"))
    text = filled(template, query=F.col("query"), context=F.col("context"))
    return joined.join(queries, "query_id").select("query_id", text.alias("prompt"))


def precision_recall(results: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, precision, recall) at k against `relevant(query_id, doc_id)`."""
    got = results.where(F.col("pos") <= k).select("query_id", "doc_id").distinct()
    n_got, n_want = got.groupBy("query_id").agg(F.count("*").alias("g")), relevant.groupBy("query_id").agg(F.count("*").alias("w"))
    hit = got.join(relevant, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("h"))
    both = n_want.join(n_got, "query_id", "left").join(hit, "query_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    return both.select("query_id", F.round(z(F.col("h")) / F.greatest(z(F.col("g")), F.lit(1)), 6).alias("precision"), F.round(z(F.col("h")) / F.col("w"), 6).alias("recall"))
