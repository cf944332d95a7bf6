"""Corpus maintenance: quality gates and reports, change data, staging, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import link_density
from lodestone.sources import tables


def hard_gate(chunks: DataFrame, least: int = 50) -> DataFrame:
    """Chunks of `least` characters or more, the first of equal trimmed contents in a document."""
    again = Window.partitionBy("doc_id", F.trim("content")).orderBy("chunk_index")
    return chunks.where(F.length("content") >= least).withColumn("again", F.row_number().over(again)).where("again = 1").drop("again")


def soft_warnings(chunks: DataFrame) -> DataFrame:
    w = F.array_compact(F.array(F.when(F.length("content") < 100, "short"), F.when(link_density(F.col("content"), F.col("wiki_links")) > 0.3, "link density")))
    return chunks.withColumn("warnings", w)


#: Cells of a histogram within an octave, and distinct values of a range that are sorted.
CELLS, FEW = 256, 1000


def _same(a: str, b: str, group: tuple[str, ...]) -> Column:
    """Equality of the group columns of two aliased frames, nulls included."""
    out = F.lit(True)
    for g in group:
        out = out & F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}"))
    return out


def _narrowed(counted: DataFrame, value: str, state: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """For every (group, s): the cell of its range that holds the value with index `want`, with the rows below it."""
    v, lo, hi = (F.col(c).cast("double") for c in (f"c.{value}", "s.lo", "s.hi"))
    # a range of several octaves is cut by octaves, one within an octave evenly: at most some eight rounds, however the values lie
    octave = F.when(v == 0, 0).otherwise(F.signum(v) * (2000 + F.floor(F.log2(F.abs(v)))))
    narrow = (F.signum(lo) == F.signum(hi)) & (F.greatest(F.abs(lo), F.abs(hi)) <= 2 * F.least(F.abs(lo), F.abs(hi)))
    even = F.when(hi > lo, F.floor((v - lo) / (hi - lo) * (CELLS - 1))).otherwise(0)
    where = F.when(F.isnan(v), 9001).when(F.abs(v) == float("inf"), F.signum(v) * 9000).when(narrow, even).otherwise(octave).cast("int")
    rows = counted.alias("c").join(state.alias("s"), _same("c", "s", group) & F.col(f"c.{value}").between(F.col("s.lo"), F.col("s.hi")))
    cells = rows.select(*[f"c.{g}" for g in group], "s.s", "s.want", "s.below", F.col("s.m").alias("before"), where.alias("cell"), F.col(f"c.{value}").alias("v"), "c.c")
    hist = cells.groupBy(*group, "s", "cell").agg(F.first("want").alias("want"), F.first("below").alias("below"), F.first("before").alias("before"), F.sum("c").alias("c"), F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    upto = Window.partitionBy(*group, "s").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)  # some 4,000 rows at most
    hist = hist.withColumn("upto", F.col("below") + F.sum("c").over(upto)).where((F.col("upto") > F.col("want")) & (F.col("upto") - F.col("c") <= F.col("want")))
    return hist.select(*group, "s", "want", (F.col("upto") - F.col("c")).alias("below"), "m", "before", "lo", "hi")


def percentiles_by_index(values: DataFrame, value: str, *shares: float, group: tuple[str, ...] = ()) -> DataFrame:
    """Percentiles by index floor(n * p) of the sorted values (not interpolated), exact, of all groups and shares at once.

    Equal values are counted first. Each wanted index has a range of values; a histogram of its cells, summed before it is
    shuffled, gives the cell that holds the index, whose least and greatest values are the next range. Only ranges of at most FEW
    distinct values are sorted, so no task sees a group's values. NaN is above all numbers; nulls don't count.
    """
    counted = tables.written(values.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("c")), "counted")
    stats = counted.groupBy(*group).agg(F.sum("c").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.sum(F.col(value) * F.col("c")) / F.sum("c"), 6).alias("mean"), F.count("*").alias("m"))
    each = stats.where("n > 0").select(*group, F.posexplode(F.array(*[F.lit(float(p)) for p in shares])).alias("s", "p"), "n", "m", F.col("least").alias("lo"), F.col("most").alias("hi"))
    state = each.select(*group, "s", F.least(F.floor(F.col("n") * F.col("p")), F.col("n") - 1).alias("want"), F.lit(0).cast("long").alias("below"), "m", F.lit(None).cast("long").alias("before"), "lo", "hi")
    open_ = (F.col("m") > FEW) & (F.col("before").isNull() | (F.col("m") < F.col("before")))  # a range that can't be cut is sorted
    state = tables.written(state, "ranks")
    while state.where(open_).take(1):
        state = tables.written(state.where(~open_).unionByName(_narrowed(counted, value, state.where(open_), group)), "ranks")
    rows = counted.alias("c").join(state.alias("s"), _same("c", "s", group) & F.col(f"c.{value}").between(F.col("s.lo"), F.col("s.hi")))
    rows = rows.select(*[f"c.{g}" for g in group], "s.s", "s.want", "s.below", F.col(f"c.{value}").alias("v"), "c.c")
    upto = Window.partitionBy(*group, "s").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("upto", F.col("below") + F.sum("c").over(upto)).where("upto > want").groupBy(*group, "s").agg(F.min("v").alias("v"))
    wide = found.groupBy(*group).agg(*[F.max(F.when(F.col("s") == i, F.col("v"))).alias(f"p{round(p * 100)}") for i, p in enumerate(shares)])
    out = stats.drop("m").alias("a").join(wide.alias("b"), _same("a", "b", group), "left")
    return out.select(*[f"a.{g}" for g in group], "n", "least", "most", "mean", *[f"p{round(p * 100)}" for p in shares])


def diff(before: DataFrame, after: DataFrame, key: str = "doc_key", digest: str = "digest") -> DataFrame:
    """(key, change) of two snapshots: added, modified, deleted or unchanged."""
    a, b = before.select(key, F.col(digest).alias("was")), after.select(key, F.col(digest).alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "modified").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def upsert(staged: DataFrame, removed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Staged chunks without those of removed documents (doc_id), plus fresh ones."""
    return staged.join(removed.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(fresh)


def cut_tables(chunks: DataFrame) -> DataFrame:
    """Chunks whose last line and the next chunk's first line both belong to a table."""
    line = lambda c, i: F.trim(F.element_at(F.split(c, "\n"), i))
    row = lambda x: x.startswith("|") & x.endswith("|")
    nxt = F.lead("content").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    return chunks.withColumn("next", nxt).where(row(line(F.col("content"), -1)) & row(line(F.col("next"), 1))).drop("next")


def base_stats(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks, and distinct non-empty clients and document types."""
    d = docs.agg(F.count("*").alias("documents"), F.count_distinct(F.nullif("client", F.lit(""))).alias("clients"), F.count_distinct(F.nullif("doc_type", F.lit(""))).alias("doc_types"))
    return d.crossJoin(chunks.agg(F.count("*").alias("chunks")))  # one row each


def doc_type_filter(requests: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, chunk_id) of chunks with one of the wanted types, and the queries that match none, which aren't filtered."""
    hits = requests.join(chunks, requests["doc_type"] == chunks["doc_type"]).select("query_id", "chunk_id")
    none = requests.select("query_id").distinct().join(hits.select("query_id").distinct(), "query_id", "left_anti")
    return hits.distinct(), none


def broken_tables(content: Column) -> Column:
    """Whether a chunk holds a run of table lines that is under two lines long or has no rule line."""
    row = lambda x: F.trim(x).startswith("|") & F.trim(x).endswith("|") & (F.trim(x) != "")
    marked = F.array_join(F.transform(F.split(content, "\n"), lambda x: F.when(row(x), F.when(x.contains("---"), "r").otherwise("t")).otherwise(" ")), "")
    runs = F.filter(F.split(marked, " +"), lambda x: x != "")
    return F.exists(runs, lambda x: (F.length(x) < 2) | ~x.contains("r"))


def truncation_rates(contexts: DataFrame) -> DataFrame:
    """One row of `contexts(sample_id, content)`: shares of chunks and of samples with a broken table."""
    by = contexts.groupBy("sample_id").agg(F.count("*").alias("n"), F.count_if(broken_tables(F.col("content"))).alias("broken"))
    return by.agg(F.round(F.sum("broken") / F.greatest(F.sum("n"), F.lit(1)), 6).alias("chunk_rate"), F.round(F.count_if(F.col("broken") > 0) / F.greatest(F.count("*"), F.lit(1)), 6).alias("sample_rate"))


def worst(results: DataFrame, metric: str, k: int = 5) -> DataFrame:
    """The k samples with the lowest metric; a missing one counts as 1."""
    return results.withColumn("m", F.coalesce(metric, F.lit(1.0))).orderBy("m", "sample_id").limit(k).drop("m")


def chunk_report(chunks: DataFrame) -> DataFrame:
    """One row: chunks, and the least, greatest and mean (floored) length; zeros without chunks."""
    n = F.length("content")
    z = lambda c: F.coalesce(c, F.lit(0))
    return chunks.agg(F.count("*").alias("chunks"), z(F.min(n)).alias("least"), z(F.max(n)).alias("most"), z(F.floor(F.avg(n))).alias("mean"))


def lookup_in_order(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of `wanted(pos, chunk_id)` with their position; unknown ids are skipped, repeated ones answered each time."""
    return wanted.join(chunks, "chunk_id")


def by_document(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Staged chunks whose doc_id is wanted, or whose parent is `parent_` and a wanted id."""
    own = wanted.select("doc_id").distinct()
    parents = own.select(F.concat(F.lit("parent_"), F.col("doc_id")).alias("parent_doc_id"))
    return chunks.join(own, "doc_id", "left_semi").unionByName(chunks.join(own, "doc_id", "left_anti").join(parents, "parent_doc_id", "left_semi").select(*chunks.columns))


def browse(docs: DataFrame, **chosen: str) -> DataFrame:
    """Documents equal to every choice; an empty choice doesn't restrict."""
    for name, value in chosen.items():
        if value:
            docs = docs.where(F.col(name) == value)
    return docs


def parent_map(docs: DataFrame) -> DataFrame:
    """(doc_id, content, title, path) of whole documents, behind their chunks."""
    return docs.select("doc_id", "content", "title", "path")


def wiki_chunks(entries: DataFrame) -> DataFrame:
    """One chunk an article of `entries(name, type, frequency)`: id, text and its own link."""
    head = F.concat(F.lit("# "), F.col("name"), F.lit("\n"), F.when(F.col("type") == "entity", "实体").otherwise("概念"), F.lit(" | 出现频次: "), F.col("frequency").cast("string"))
    return entries.select(F.concat(F.lit("wiki_"), F.col("name")).alias("chunk_id"), head.alias("content"), F.array("name").alias("wiki_links"))


def kb_facets(docs: DataFrame) -> DataFrame:
    """(facet, value, documents) of the non-empty clients, projects and document types."""
    facets = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("client", "project", "doc_type")]))
    return docs.select(facets.alias("f")).where("f.value <> ''").groupBy("f.facet", "f.value").agg(F.count("*").alias("documents"))


def top_entries(entries: DataFrame, k: int = 20) -> DataFrame:
    """(type, pos, name, frequency): the k most frequent names of each type."""
    order = Window.partitionBy("type").orderBy(F.desc("frequency"), "name")
    return entries.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k).select("type", "pos", "name", "frequency")


def document_list(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, title, n_links, chunk_count) of documents(doc_id, title, wiki_links)."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    return docs.join(n, "doc_id", "left").select("doc_id", "title", F.size("wiki_links").alias("n_links"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def route_share(results: DataFrame) -> DataFrame:
    """One row: shares of samples whose search method names struct or rrf."""
    share = lambda w: F.round(F.avg(F.contains(F.lower("method"), F.lit(w)).cast("double")), 6).alias(w)
    return results.agg(share("struct"), share("rrf"))


def answered(samples: DataFrame) -> DataFrame:
    """Samples with an answer and without an error."""
    return samples.where("coalesce(error, '') = '' AND coalesce(trim(answer), '') <> ''")
