"""Entity dictionary: entries, edges, lookups, dictionary matching and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import entry_context

#: An entry table with more names than this is not broadcast.
BROADCAST_NAMES = 100_000


def last_wins(entries: DataFrame) -> DataFrame:
    """One row a name, the one with the greatest `ordinal`; ids in name order."""
    latest = entries.groupBy("name").agg(F.max_by(F.struct(*[c for c in entries.columns if c != "name"]), "ordinal").alias("x"))
    return latest.select("name", "x.*")


def first_edges(edges: DataFrame) -> DataFrame:
    """One row an (entry, chunk) pair, the one with the smallest `ordinal`."""
    return edges.groupBy("name", "chunk_id").agg(F.min_by("context", "ordinal").alias("context"))


def relations(chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """(name, chunk_id, context): links of chunks to known entries."""
    links = chunks.select("chunk_id", F.explode("wiki_links").alias("name"), entry_context(F.col("content")).alias("context"))
    return links.join(entries.select("name").distinct(), "name").select("name", "chunk_id", "context")


def link_index(chunks: DataFrame) -> DataFrame:
    """(name, n_chunks, first_chunk) of every link; its list of chunks is `link_lists`."""
    return chunks.select("chunk_id", F.explode("wiki_links").alias("name")).distinct().groupBy("name").agg(F.count("*").alias("n_chunks"), F.min("chunk_id").alias("first_chunk"))


def link_lists(chunks: DataFrame, size: int = 1000) -> DataFrame:
    """(name, part, parts, chunk_ids): every link's chunk ids in parts of about `size`, each sorted; a link that very many chunks hold has many parts."""
    rows = chunks.select("chunk_id", F.explode("wiki_links").alias("name")).distinct()
    parts = rows.groupBy("name").agg(F.ceil(F.count("*") / size).alias("parts"))
    dealt = rows.join(parts, "name").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")))
    return dealt.groupBy("name", "part", "parts").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))


def lookup_or(requests: DataFrame, entries: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, name_pos, name, type, frequency, chunk_id) of every requested name that is known."""
    return requests.join(entries, "name").join(edges, "name", "left").select("query_id", "name_pos", "name", "type", "frequency", "chunk_id")


def lookup_and(requests: DataFrame, entries: DataFrame, edges: DataFrame) -> DataFrame:
    """Chunks shared by all requested names that are known; unknown names are ignored. Entities only are returned,
    though concepts among the names restrict the intersection."""
    known = requests.join(entries, "name").select("query_id", "name", "name_pos", "type", "frequency")
    needed = known.groupBy("query_id").agg(F.countDistinct("name").alias("needed"))
    shared = known.join(edges, "name").groupBy("query_id", "chunk_id").agg(F.countDistinct("name").alias("got")).join(needed, "query_id").where("got = needed")
    return known.where("type = 'entity'").join(shared.select("query_id", "chunk_id"), "query_id", "left").select("query_id", "name_pos", "name", "type", "frequency", "chunk_id")


def known_entities(entries: DataFrame) -> DataFrame:
    return entries.select("name", "type", "category", "frequency").orderBy(F.desc("frequency"), "name")


def struct_stats(entries: DataFrame, edges: DataFrame) -> DataFrame:
    e = entries.agg(F.count("*").alias("entries"), F.count_if(F.col("type") == "concept").alias("concepts"), F.count_if(F.col("type") == "entity").alias("entities"))
    return e.crossJoin(edges.agg(F.count("*").alias("relations")))  # one row each


def fuzzy(entries: DataFrame, part: str, k: int = 20) -> DataFrame:
    return entries.where(F.contains("name", F.lit(part))).orderBy(F.desc("frequency"), "name").limit(k)


def entries_by_chunk(entries: DataFrame, edges: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    return edges.join(chunk_ids, "chunk_id").join(entries, "name").select("chunk_id", "name", "type", "frequency")


def match_names(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """(query_id, name, first): entry names contained in query texts, case-insensitively.

    The texts' words are joined with each name's longest word first, and `contains` verifies, so
    the dictionary isn't compared with every text. Names without a letter or digit are left out.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    t = texts.select("query_id", F.lower("query").alias("q"))
    # a name may begin or end inside a word: only words between two others are certain to occur whole
    e = entries.select("name", F.lower("name").alias("low")).distinct().withColumn("inner", F.slice(words(F.col("name")), 2, F.greatest(F.size(words(F.col("name"))) - 2, F.lit(0))))
    e = e.where(F.size(words(F.col("name"))) > 0)
    anchored = e.where(F.size("inner") > 0).withColumn("anchor", F.get(F.array_sort("inner", lambda a, b: F.length(b) - F.length(a)), 0))
    by_word = t.select("query_id", "q", F.explode(F.array_distinct(words(F.col("q")))).alias("anchor")).join(anchored, "anchor")
    # short names: any window of the text of the name's length, by length (few lengths occur)
    short = e.where(F.size("inner") == 0).withColumn("n", F.length("low"))
    lengths = short.select("n").distinct().agg(F.array_sort(F.collect_set("n")).alias("ns"))  # bounded by the longest name
    grams = t.crossJoin(F.broadcast(lengths)).select(
        "query_id", "q", F.explode(F.array_distinct(F.flatten(F.transform("ns", lambda n: F.when(F.length("q") >= n, F.transform(F.sequence(F.lit(1), F.length("q") - n + 1), lambda i: F.substring(F.col("q"), i, n))).otherwise(F.array().cast("array<string>")))))).alias("low")
    )
    found = by_word.select("query_id", "q", "name", "low").unionByName(grams.join(short, "low").select("query_id", "q", "name", "low"))
    return found.where(F.contains("q", F.col("low"))).select("query_id", "name", F.instr("q", F.col("low")).alias("first")).distinct()


def ordered_matches(matches: DataFrame) -> DataFrame:
    """Matches with their position: longest first, then by first occurrence, then name."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.length("name")), "first", "name")
    return matches.withColumn("name_pos", F.row_number().over(order))


def decompose(unknown: Column, names: Column) -> Column:
    """Known names (2 letters or more) inside an unknown one, longest first, none inside another kept one."""
    inside = F.array_sort(F.filter(names, lambda n: (F.length(n) >= 2) & F.contains(unknown, n)), lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(inside, F.array().cast("array<string>"), lambda kept, n: F.when(F.exists(kept, lambda k: F.contains(k, n)), kept).otherwise(F.array_append(kept, n)))


def link_recall(requests: DataFrame, links: DataFrame, top_k: int = 10) -> DataFrame:
    """Documents by weighted link matches: the i-th name weighs 1/i a matching chunk; scores are divided by the names asked."""
    asked = requests.groupBy("query_id").agg(F.count("*").alias("asked"))
    hits = requests.join(links, "name").groupBy("query_id", "doc_id").agg(F.sum(1.0 / F.col("name_pos")).alias("weight"))
    scored = hits.join(asked, "query_id").select("query_id", "doc_id", F.round(F.col("weight") / F.col("asked"), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= top_k)


def route(queries: DataFrame, entity_hits: DataFrame, hybrid_hits: DataFrame) -> DataFrame:
    """Entity results where a query has any (or is forced), hybrid results otherwise. `queries.method`: auto, entity or rrf."""
    with_entity = entity_hits.select("query_id").distinct().withColumn("found", F.lit(True))
    q = queries.join(with_entity, "query_id", "left").withColumn("route", F.when(F.col("method") == "entity", "entity").when(F.col("method") == "rrf", "rrf").when(F.col("found"), "entity").otherwise("rrf"))
    cols = ["query_id", "chunk_id", "score", "pos"]
    pick = lambda hits, r: hits.select(*cols).join(q.where(F.col("route") == r).select("query_id", "route"), "query_id")
    return pick(entity_hits, "entity").unionByName(pick(hybrid_hits, "rrf"))
