"""Hybrid search by profile, the entity route's chain of recalls, and routing between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text
from lodestone.operators import entities, fusion, linking, routing
from lodestone.operators.routing import Profile
from lodestone.sources import tables


def upto(hits: DataFrame, sizes: DataFrame, size: str = "recall") -> DataFrame:
    """Hits within their query's size, from sizes(query_id, <size>)."""
    return hits.join(sizes.select("query_id", size), "query_id").where(F.col("pos") <= F.col(size)).drop(size)


HITS = "query_id long, chunk_id long, score double, pos int"


def stage(name: str, path: Callable[[], DataFrame], schema: str = HITS) -> DataFrame:
    """A path's hits, run to its end as a stage of its own and written."""
    return tables.written(path().select(*[F.col(c.name).cast(c.dataType) for c in T._parse_datatype_string(schema)]), f"path-{name}")


def isolated(spark: SparkSession, paths: dict[str, Callable[[], DataFrame]], schema: str = HITS) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each path's hits, run to its end as a stage of its own and written, and the failures (path, error, message).

    A path that raises, when it is planned or when it runs, gives no hits and one row that names it; the others are answered and fused
    without it, so the caller must hand on the failures with what it makes of the hits. Paths run one after the other; each is split into
    tasks, so the cluster is full while one runs.
    """
    found, failed = {}, []
    for name, path in paths.items():
        try:
            found[name] = stage(name, path, schema)
        except Exception as e:  # whatever a path's source or function raises
            found[name] = spark.createDataFrame([], schema)
            failed.append((name, type(e).__name__, " ".join(str(e).split())[:500]))
    return found, spark.createDataFrame(failed, "path string, error string, message string")


def struct_path(requests: DataFrame, entries: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, pos): chunks of the requested entities, in the order of names, then chunks; the first
    occurrence of a chunk counts and its score is the entry's frequency."""
    hits = entities.lookup_or(requests, entries, edges).where("type = 'entity' AND chunk_id IS NOT NULL")
    first = hits.groupBy("query_id", "chunk_id").agg(F.min(F.struct("name_pos", "frequency")).alias("x"))
    order = Window.partitionBy("query_id").orderBy("x.name_pos", "chunk_id")
    return first.select("query_id", "chunk_id", F.col("x.frequency").cast("double").alias("score"), F.row_number().over(order).alias("pos"))


def hybrid(queries: DataFrame, requests: DataFrame, chunks: DataFrame, vector: DataFrame, lexical: DataFrame, struct: DataFrame | None, profile: Profile, top_k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """Assembled results of `queries(query_id, query)` under a profile.

    `requests(query_id, name, name_pos)` are the matched names: a query with any recalls the profile's sizes, one without recalls twice
    as many and is fused to three times top_k (`routing.sizes`). `vector`, `lexical` and `struct` are ranked hits of at
    least twice the profile's sizes; `struct` is used where the profile says so. `allowed(query_id, chunk_id)` applies
    to the queries it names, after the paths' cuts. With the entity filter, vector hits without any of the query's
    names are skipped in fusion, and queries with names are assembled as entity queries.
    """
    names = requests.groupBy("query_id").agg(F.collect_set("name").alias("names"))  # names in one query text
    q = queries.join(names, "query_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>"))).withColumn("is_entity", F.size("names") > 0)
    sized = q.withColumns({"v": routing.sizes(F.col("query"), F.col("is_entity"), top_k, profile.vector_top_n), "b": routing.sizes(F.col("query"), F.col("is_entity"), top_k, profile.bm25_top_n)})
    sized = sized.select("query_id", "names", "is_entity", F.col("v.recall").alias("v_recall"), F.col("b.recall").alias("b_recall"), F.col("v.fused").alias("fused"))
    found = {"vector": upto(vector, sized, "v_recall"), "bm25": upto(lexical, sized, "b_recall")}
    if profile.use_struct and struct is not None:
        found["struct"] = upto(struct, sized, "v_recall")
    if allowed is not None:
        restricted = allowed.select("query_id").distinct()
        found = {p: fusion.whitelist(h, allowed).unionByName(h.join(restricted, "query_id", "left_anti")) for p, h in found.items()}
    if profile.use_entity_filter:
        content = chunks.select("chunk_id", F.col("content").alias("text"))
        h = found["vector"].join(sized.select("query_id", "names"), "query_id").join(content, "chunk_id", "left")
        found["vector"] = h.withColumn("skip", routing.without_keywords(F.col("text"), F.col("names"))).drop("names", "text")
    fused = upto(fusion.rrf(fusion.paths(**found)), sized, "fused").join(sized.select("query_id", "is_entity"), "query_id")
    return fusion.assemble(fused, chunks, top_k, F.col("is_entity") & F.lit(profile.use_entity_filter))


def best_chunks(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id): each document's longest chunk that isn't a heading or its metadata, else its longest."""
    meta = (F.length("content") < 100) | F.trim("content").startswith("## 文档元信息")
    return chunks.groupBy("doc_id").agg(F.min(F.struct(meta.cast("int").alias("m"), (-F.length("content")).alias("n"), "chunk_id")).alias("x")).select("doc_id", "x.chunk_id")


def context_hits(requests: DataFrame, entries: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, step, x struct<name_pos, frequency>): chunks of all of a query's entities, else of any; each once, by its first name."""
    both, any_ = entities.lookup_and(requests, entries, edges), entities.lookup_or(requests, entries, edges).where("type = 'entity'")
    several = requests.groupBy("query_id").agg(F.count("*").alias("n")).where("n > 1").select("query_id")
    with_and = both.where("chunk_id IS NOT NULL").join(several, "query_id", "left_semi").withColumn("step", F.lit("and"))
    with_or = any_.where("chunk_id IS NOT NULL").join(with_and.select("query_id").distinct(), "query_id", "left_anti").withColumn("step", F.lit("or"))
    known = with_and.unionByName(with_or).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    return known.groupBy("query_id", "chunk_id", "step").agg(F.min(F.struct("name_pos", "frequency")).alias("x"))


#: Documents under this many tokens are taken whole; of a longer one three windows around names are, which count as SNIPPETS tokens.
WHOLE_BELOW, SNIPPETS = 3000, 300


def entity_documents(requests: DataFrame, entries: DataFrame, edges: DataFrame, chunks: DataFrame, articles: DataFrame | None = None, budget: int = 6000) -> DataFrame:
    """(query_id, pos, kind, name, tokens, whole, upto, content): what a query's entities bring to its prompt, in order, as far as `budget` tokens reach.

    `articles(name, content)` of the requested names come first, in the names' order, then the documents of the chunks of all names, else of any
    (`context_hits`), by first occurrence. Short documents come whole, long ones as the windows around names. `upto` is the running sum of tokens; the
    first piece that passes the budget ends the packing, so a piece is never cut. Links are reduced to their words.
    """
    plain = lambda c: text.strip_links(F.col(c))
    hits = context_hits(requests, entries, edges, chunks).join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    docs = hits.groupBy("query_id", "doc_id").agg(F.min(F.struct("x.name_pos", "chunk_id")).alias("at"))
    names = requests.groupBy("query_id").agg(F.array_sort(F.collect_set("name")).alias("names"))  # names of one query text
    whole_text = chunks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "content"))), lambda c: c["content"]), "\n").alias("text"))  # chunks of one document
    rows = docs.join(whole_text, "doc_id").join(names, "query_id").select("query_id", F.lit(1).alias("part"), "at.name_pos", "at.chunk_id", F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("name"), plain("text").alias("text"), "names")
    if articles is not None:
        known = requests.join(articles, "name").join(names, "query_id").select("query_id", F.lit(0).alias("part"), "name_pos", F.lit(None).cast(rows.schema["chunk_id"].dataType).alias("chunk_id"), F.lit("article").alias("kind"), "name", plain("content").alias("text"), "names")
        rows = known.unionByName(rows)
    rows = rows.withColumn("tokens", text.estimate_tokens(F.col("text"))).withColumn("whole", (F.col("tokens") < WHOLE_BELOW) | (F.col("kind") == "article"))
    order = Window.partitionBy("query_id").orderBy("part", "name_pos", "chunk_id", "name")
    cost = F.when(F.col("whole"), F.col("tokens")).otherwise(SNIPPETS)
    rows = rows.withColumns({"pos": F.row_number().over(order), "upto": F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, 0))}).where(F.col("upto") <= budget)
    content = F.when(F.col("whole"), F.col("text")).otherwise(linking.contexts(F.col("text"), F.col("names")))
    return rows.select("query_id", "pos", "kind", "name", "tokens", "whole", "upto", content.alias("content"))


def recall_chain(requests: DataFrame, entries: DataFrame, edges: DataFrame, links: DataFrame, chunks: DataFrame, top_k: int = 10) -> DataFrame:
    """(query_id, chunk_id, score, pos, step): a query's entity chunks by the first step that finds any.

    Several names: chunks of all of them ("and"), else of any ("or"); one name: of it ("or"). Entries come in the order
    of names, a chunk counts once, unknown chunks are left out, the score is frequency / 500. Else the documents with most weighted
    `links(name, doc_id)`, by their best chunk ("links").
    """
    first = context_hits(requests, entries, edges, chunks)
    order = Window.partitionBy("query_id").orderBy("x.name_pos", "chunk_id")
    context = first.select("query_id", "chunk_id", (F.col("x.frequency") / 500).alias("score"), F.row_number().over(order).alias("pos"), "step").where(F.col("pos") <= top_k)
    rest = requests.join(context.select("query_id").distinct(), "query_id", "left_anti")
    linked = entities.link_recall(rest, links, top_k).join(best_chunks(chunks), "doc_id").select("query_id", "chunk_id", "score", "pos", F.lit("links").alias("step"))
    return context.unionByName(linked)


def fallback_reason(names: Column, method: Column) -> Column:
    """Why a query isn't answered by the entity route."""
    return F.when(method == "rrf", "forced").when(F.size(names) == 0, "no known entity").otherwise("entity")
