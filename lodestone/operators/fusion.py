"""Reciprocal-rank fusion, result assembly and score normalisation over batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import round_half_up

RRF_K, SOURCES = 60, ("vector", "bm25", "struct")


def paths(**hits: DataFrame) -> DataFrame:
    """Union of ranked paths (query_id, chunk_id, score, pos[, skip]) with the path's name and order."""
    out = None
    for name in SOURCES:
        if name in hits:
            h = hits[name]
            skip = F.col("skip") if "skip" in h.columns else F.lit(False)
            part = h.select("query_id", "chunk_id", F.col("score").alias("raw_score"), "pos", skip.alias("skip"), F.lit(name).alias("path"), F.lit(SOURCES.index(name)).alias("path_ord"))
            out = part if out is None else out.unionByName(part)
    return out


def whitelist(hits: DataFrame, allowed: DataFrame) -> DataFrame:
    """Keep hits of allowed chunks (query_id, chunk_id), after their path's cut."""
    of = allowed.select("query_id", "chunk_id").join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")  # hits are few, allowed chunks may be all
    return hits.join(of.distinct(), ["query_id", "chunk_id"], "left_semi")


def rrf(hits: DataFrame, k: int | None = None, rank_constant: int = RRF_K) -> DataFrame:
    """Sum of 1/(60 + rank) by chunk; ranks count only rows that aren't skipped, reported ranks are raw.

    Skipped rows keep their raw score, have no rank and add nothing. Ties keep insertion order (path, position).
    """
    upto = Window.partitionBy("query_id", "path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ranked = hits.withColumn("eff", F.sum(F.when(~F.col("skip"), 1).otherwise(0)).over(upto)).withColumn("raw", F.when(~F.col("skip"), F.col("pos")))
    per = [F.max(F.when(F.col("path") == p, F.col(c))).alias(f"{p}_{n}") for p in SOURCES for c, n in (("raw_score", "score"), ("raw", "rank"))]
    fused = ranked.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.when(~F.col("skip"), 1.0 / (rank_constant + F.col("eff")))), 9).alias("rrf"), F.min(F.col("path_ord") * 1_000_000 + F.col("pos")).alias("seq"), *per
    )
    order = Window.partitionBy("query_id").orderBy(F.coalesce("rrf", F.lit(0.0)).desc(), "seq")
    out = fused.withColumn("pos", F.row_number().over(order))
    return out if k is None else out.where(F.col("pos") <= k)


def assemble(hits: DataFrame, chunks: DataFrame, top_k: int = 10, entity: Column | bool = False) -> DataFrame:
    """Attach chunks, keep at most 5 (entity queries: 1) with distinct first lines a document, cut, normalise, label the source."""
    entity = entity if isinstance(entity, Column) else F.lit(entity)
    cap, size = F.when(entity, 1).otherwise(5), F.when(entity, top_k).otherwise(2 * top_k)
    rows = hits.join(chunks.select("chunk_id", "doc_id", "content"), "chunk_id").withColumn("first_line", F.trim(F.element_at(F.split("content", "\n"), 1)))
    same = Window.partitionBy("query_id", "doc_id", "first_line").orderBy("pos")
    doc = Window.partitionBy("query_id", "doc_id").orderBy("pos")
    rows = rows.withColumn("again", F.row_number().over(same)).where("again = 1").withColumn("of_doc", F.row_number().over(doc)).where(F.col("of_doc") <= cap)
    rows = rows.withColumn("doc_pos", F.min("pos").over(Window.partitionBy("query_id", "doc_id")))
    order = Window.partitionBy("query_id").orderBy(F.coalesce("rrf", F.lit(0.0)).desc(), "doc_pos", "pos")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    return rows.select("query_id", "rank", "chunk_id", "doc_id", "content", "rrf", *[f"{p}_{n}" for p in SOURCES for n in ("score", "rank")], normalised().alias("score"), source_label().alias("source"))


def normalised():
    """0.05 + 0.90 * (rrf - min) / (max - min) within the query, 0.5 where all are equal, 4 digits half up."""
    every = Window.partitionBy("query_id")
    x, lo, hi = F.coalesce("rrf", F.lit(0.0)), F.coalesce(F.min("rrf").over(every), F.lit(0.0)), F.coalesce(F.max("rrf").over(every), F.lit(0.001))
    return round_half_up(F.when(hi == lo, F.lit(0.5)).otherwise(0.05 + (x - lo) / (hi - lo) * 0.90))


def source_label():
    return F.when(F.col("vector_rank").isNotNull() & F.col("bm25_rank").isNull(), "vector").when(F.col("bm25_rank").isNotNull() & F.col("vector_rank").isNull(), "bm25").otherwise("hybrid")
