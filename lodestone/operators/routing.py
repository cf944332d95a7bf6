"""Query analysis: broad queries, recall sizes, profiles, type filters, entity extraction from model output."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import lexicon


@dataclass(frozen=True)
class Profile:
    id: str
    use_struct: bool = False
    use_entity_filter: bool = True
    vector_top_n: int = 20
    bm25_top_n: int = 20
    rerank_top_k: int = 5


PROFILES = {p.id: p for p in (Profile("baseline"), Profile("struct", use_struct=True), Profile("no_entity_filter", use_entity_filter=False))}


def profile(name: str | None) -> Profile:
    return PROFILES.get(name or "", PROFILES["baseline"])


def is_broad(query: Column) -> Column:
    return query.rlike("|".join(lexicon.BROAD_QUERIES))


def sizes(query: Column, has_entities: Column, top_k: int = 5, top_n: int = 20) -> Column:
    """struct(recall, fused, assembled): recall doubles and fusion triples without entities; a broad query is
    fused to 3 at most, but assembled by the size asked for."""
    fused = F.when(is_broad(query) & (F.lit(top_k) > 3), 3).otherwise(top_k)
    return F.struct(
        F.when(has_entities, top_n).otherwise(2 * top_n).alias("recall"), F.when(has_entities, fused).otherwise(3 * fused).alias("fused"), F.when(has_entities, top_k).otherwise(2 * top_k).alias("assembled")
    )


def without_keywords(content: Column, keywords: Column) -> Column:
    """Whether a vector hit is skipped: it has none of the query's keywords (never, if there are none)."""
    return (F.size(keywords) > 0) & ~F.exists(keywords, lambda k: F.contains(F.coalesce(content, F.lit("")), k))


def known_doc_types(wanted: Column) -> Column:
    return F.array_intersect(wanted, F.array(*[F.lit(t) for t in lexicon.DOC_TYPES]))


def entity_category(name: Column) -> Column:
    return (
        F.when(name.isin(lexicon.CLIENTS), "客户企业").when(name.isin(lexicon.TECHNOLOGY), "技术组件").when(name.isin(lexicon.DEPARTMENTS), "部门")
        .when(name.rlike("^[一-龥]{2,3}$"), "人员").otherwise("项目系统")
    )


def enterprise_gate(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Requested names that are entities of the dictionary and look like enterprises."""
    return requests.join(entries.where("type = 'entity'").select("name"), "name", "left_semi").where(F.col("name").rlike(lexicon.ENTERPRISE))


def parse_entities(answer: Column) -> Column:
    """array<struct<name, type>> from the outermost JSON array of a model's answer; types but entity become concept."""
    rows = F.from_json(F.regexp_extract(answer, r"(?s)(\[.*\])", 1), "array<struct<name:string,type:string>>")
    named = F.filter(F.coalesce(rows, F.array().cast("array<struct<name:string,type:string>>")), lambda x: F.trim(x["name"]) != "")
    return F.transform(named, lambda x: F.struct(F.trim(x["name"]).alias("name"), F.when(x["type"] == "entity", "entity").otherwise("concept").alias("type")))


def new_entities(found: DataFrame, known: DataFrame) -> DataFrame:
    """(name, type, frequency, chunks) of names `found(chunk_id, name, type)` that the dictionary lacks, case-insensitively."""
    fresh = found.withColumn("low", F.lower("name")).join(known.select(F.lower("name").alias("low")), "low", "left_anti")
    return fresh.groupBy("low").agg(F.min_by("name", "chunk_id").alias("name"), F.min_by("type", "chunk_id").alias("type"), F.count_distinct("chunk_id").alias("frequency")).drop("low")


def to_extract(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks of raw documents not yet extracted for this build (doc_id, built_at)."""
    return chunks.where(F.col("doc_id").startswith("raw_")).join(done.select("doc_id", "built_at"), ["doc_id", "built_at"], "left_anti")


def needs_definition(content: Column, frequency: Column) -> Column:
    return ~content.rlike("## (定义|核心|应用)") & (F.length(content) <= 500) & (frequency >= 2)


def concept_sources(concepts: DataFrame, links: DataFrame, documents: DataFrame, most: int = 3) -> DataFrame:
    """(name, doc_id, snippet): up to `most` documents that link a concept, with their first 500 characters."""
    order = Window.partitionBy("name").orderBy("doc_id")
    hits = concepts.join(links.select("name", "doc_id").distinct(), "name").withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    return hits.join(documents, "doc_id").select("name", "doc_id", F.substring("content", 1, 500).alias("snippet"))


def merge_wiki(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, frequency, action) of merged articles: the greater frequency; created or updated."""
    o, n = old.select("name", F.col("frequency").alias("was")), new.select("name", F.col("frequency").alias("now"))
    return o.join(n, "name", "full_outer").select("name", F.greatest("was", "now").alias("frequency"), F.when(F.col("was").isNull(), "created").otherwise("updated").alias("action"))
