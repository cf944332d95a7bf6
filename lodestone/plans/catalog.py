"""Registered queries over the driver's tables, each with its DuckDB form where SQL has one.

Documents play the chunks (chunk_id = doc_id), source the document type, lang the client; benchmark texts
are lexical queries, embeddings the vectors. The entity dictionary is derived from the corpus: words
of 8 letters or more that occur in 3 documents or more, even-length ones entities, odd-length ones concepts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.tokenize import DictionaryTokenizer
from lodestone.operators import bm25, chat, chunking, corpus, entities, fusion, impacts, ivf, linking, routing, vectors
from lodestone.sources import tables

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("text").alias("content"), F.col("source").alias("doc_type"), F.col("lang").alias("client"))


_WRITTEN: dict[tuple[str, str, str], tuple[str, str]] = {}


def stored(spark: SparkSession, d: str, name: str, sources: tuple[str, ...], write) -> str:
    """The folder of an index that `write(path)` makes from `sources`, once for each state of their files; results are never stored.

    The state is the paths, sizes and modification times of the tables' files, so a table that changes under its path gives a new index.
    """
    state = tables.fingerprint(spark, [f"{d}/{t}.parquet" for t in sources])
    key = (spark.sparkContext.applicationId, d, name)
    known = _WRITTEN.get(key)
    if not known or known[0] != state or not tables.exists(spark, known[1]):
        path = f"{tables.work_dir(spark)}/{name}-{uuid.uuid4().hex}"
        write(path)
        _WRITTEN[key] = (state, path)
    return _WRITTEN[key][1]


def text_index(spark: SparkSession, d: str) -> bm25.TextIndex:
    return tables.read_index(spark, stored(spark, d, "text-index", ("documents",), lambda path: tables.write_index(bm25.build_index(chunks(spark, d)), path)))


def impact_index(spark: SparkSession, d: str) -> impacts.ImpactIndex:
    return impacts.read(spark, stored(spark, d, "impacts", ("documents",), lambda path: impacts.write(impacts.build(text_index(spark, d)), path)))


def texts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


TOK = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
POSTINGS = f"""tok AS (SELECT doc_id AS chunk_id, unnest({TOK.format('text')}) AS term FROM documents WHERE trim(text) <> ''),
post AS (SELECT term, chunk_id, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id AS chunk_id, len({TOK.format('text')}) AS dl FROM documents WHERE trim(text) <> ''),
corp AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""
QTERMS = f"qt AS (SELECT DISTINCT item_id AS query_id, unnest({TOK.format('text')}) AS term FROM benchmark)"


def _bm25_sql(k: int, k1: float, tail: str) -> str:
    return f"""WITH {POSTINGS}, {QTERMS},
sc AS (SELECT query_id, post.chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM qt JOIN post USING (term) JOIN df USING (term) JOIN dl ON dl.chunk_id = post.chunk_id, corp GROUP BY ALL),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM sc) WHERE pos <= {k}){tail}"""


def _bm25(spark: SparkSession, d: str, k: int, k1: float = 1.2) -> DataFrame:
    return impacts.best(text_index(spark, d), lambda: impact_index(spark, d), texts(spark, d), k, k1)


@query(_bm25_sql(20, 1.5, " SELECT query_id, chunk_id, score, pos FROM bm"))
def bm25_topk(spark, d):
    return _bm25(spark, d, 20, 1.5).select("query_id", "chunk_id", "score", "pos")


@query(_bm25_sql(20, 1.2, " SELECT query_id, chunk_id, score, pos FROM bm"))
def bm25_k1_12(spark, d):
    return _bm25(spark, d, 20).select("query_id", "chunk_id", "score", "pos")


@query(_bm25_sql(20, 1.5, " SELECT query_id, chunk_id, score, pos FROM bm"))
def bm25_pruned(spark, d):
    """The rows of bm25_topk from postings grouped by impact: only levels that can reach a query's k best are read."""
    return impacts.search(impact_index(spark, d), texts(spark, d), 20, 1.5).select("query_id", "chunk_id", "score", "pos")


@query()
def bm25_pruned_reading(spark, d):
    """How many postings each query's words have, and how many of them both passes of bm25_pruned read."""
    return impacts.Search(impact_index(spark, d), texts(spark, d), 20, 1.5).reading()


@query(f"WITH {POSTINGS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM post GROUP BY term")
def inverted_index_stats(spark, d):
    return text_index(spark, d).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


@query(f"WITH {POSTINGS} SELECT n, round(avgdl, 6) AS avgdl, (SELECT max(dl) FROM dl)::BIGINT AS longest, (SELECT count(*) FROM df) AS terms FROM corp")
def corpus_stats(spark, d):
    i = text_index(spark, d)
    return i.corpus.select("n", F.round("avgdl", 6).alias("avgdl")).crossJoin(i.doc_len.agg(F.max("dl").alias("longest"))).crossJoin(i.term_stats.agg(F.count("*").alias("terms")))


VEC = """qv AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
vs AS (SELECT query_id, vec_id AS chunk_id, round(coalesce(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 0), 6) AS score FROM qv, embeddings),
vt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM vs) WHERE pos <= 20)"""


def _vector(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    e = load(spark, d, "embeddings")
    return vectors.top_k(e.select(F.col("vec_id").alias("chunk_id"), "embedding"), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), k)


@query(f"WITH {VEC} SELECT query_id, chunk_id, score, pos FROM vt")
def vector_topk_cosine(spark, d):
    """Every vector whose id is divisible by 20 against all vectors."""
    return _vector(spark, d)


@query()
def vector_topk_ivf(spark, d):
    """The same queries by the inverted file, whose probes an audit of 64 of them has set to find 95 of 100 exact hits."""
    e = load(spark, d, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))

    def write(path: str) -> None:
        index = ivf.build(e.select(F.col("vec_id").alias("chunk_id"), "embedding"), path)
        ivf.audit(index, asked.orderBy(F.xxhash64("query_id")).limit(64), path)

    return ivf.search(ivf.read(spark, stored(spark, d, "ivf", ("embeddings",), write)), asked).select("query_id", "chunk_id", "score", "pos")


# fusion: vector queries are paired with benchmark queries by rank of id
PAIR = "pr AS (SELECT b.query_id, v.query_id AS vq FROM (SELECT item_id AS query_id, row_number() OVER (ORDER BY item_id) AS r FROM benchmark) b LEFT JOIN (SELECT query_id, row_number() OVER (ORDER BY query_id) AS r FROM qv) v USING (r))"
RRF = """hits AS (SELECT pr.query_id, chunk_id, score, pos, 0 AS ord FROM vt JOIN pr ON vq = vt.query_id UNION ALL SELECT bm.query_id, chunk_id, score, pos, 1 FROM bm),
fu AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + pos)), 9) AS rrf, min(ord * 1000000 + pos) AS seq, max(CASE WHEN ord = 0 THEN pos END) AS vector_rank, max(CASE WHEN ord = 1 THEN pos END) AS bm25_rank FROM hits GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, seq) AS pos FROM fu)"""


def vector_of_queries(spark: SparkSession, d: str, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """The vector queries' hits, and (query_id, vq): the vector query of each benchmark query that has one."""
    v = _vector(spark, d, k)
    asked = load(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("vq"))
    number = lambda t, c: t.select(c).distinct().withColumn("r", F.row_number().over(Window.orderBy(c)))
    return v, number(texts(spark, d), "query_id").join(number(asked, "vq"), "r").select("query_id", "vq")


def _fused(spark: SparkSession, d: str, k: int | None = None) -> DataFrame:
    """A benchmark query without a vector partner is answered by its lexical path alone."""
    v, pair = vector_of_queries(spark, d)
    v = v.withColumnRenamed("query_id", "vq").join(pair, "vq").drop("vq")
    return fusion.rrf(fusion.paths(vector=v, bm25=_bm25(spark, d, 20, 1.2)), k)


@query(_bm25_sql(20, 1.2, f", {VEC}, {PAIR}, {RRF} SELECT query_id, chunk_id, rrf, coalesce(vector_rank, 0) AS vector_rank, coalesce(bm25_rank, 0) AS bm25_rank, pos FROM rk"))
def rrf_fusion(spark, d):
    ranks = [F.coalesce(c, F.lit(0)).alias(c) for c in ("vector_rank", "bm25_rank")]  # 0: not on that path
    return _fused(spark, d).select("query_id", "chunk_id", "rrf", *ranks, "pos")


ASSEMBLE = """jn AS (SELECT rk.*, doc_id, text, trim(string_split(text, chr(10))[1]) AS fl FROM rk JOIN documents ON chunk_id = doc_id WHERE pos <= 30),
d1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, fl ORDER BY pos) AS again FROM jn),
d2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY pos) AS od, min(pos) OVER (PARTITION BY query_id, doc_id) AS dp FROM d1 WHERE again = 1),
d3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dp, pos) AS rank FROM d2 WHERE od <= 5),
d4 AS (SELECT *, min(rrf) OVER (PARTITION BY query_id) AS lo, max(rrf) OVER (PARTITION BY query_id) AS hi FROM d3 WHERE rank <= 20)
SELECT query_id, rank, chunk_id, doc_id, floor((CASE WHEN hi = lo THEN 0.5::DOUBLE ELSE 0.05::DOUBLE + (rrf - lo) / (hi - lo) * 0.90::DOUBLE END) * 10000 + 0.5) / 10000 AS score,
CASE WHEN vector_rank IS NOT NULL AND bm25_rank IS NULL THEN 'vector' WHEN bm25_rank IS NOT NULL AND vector_rank IS NULL THEN 'bm25' ELSE 'hybrid' END AS source FROM d4"""


@query(_bm25_sql(20, 1.2, f", {VEC}, {PAIR}, {RRF}, {ASSEMBLE}"))
def hybrid_search(spark, d):
    """Flagship: lexical and vector paths, fusion, assembly, normalised scores."""
    return fusion.assemble(_fused(spark, d, 30), chunks(spark, d)).select("query_id", "rank", "chunk_id", "doc_id", "score", "source")


ENTRIES = f"""{POSTINGS}, ent AS (SELECT term AS name, CASE WHEN length(term) % 2 = 0 THEN 'entity' ELSE 'concept' END AS type, sum(tf)::BIGINT AS frequency FROM post WHERE length(term) >= 8 AND regexp_full_match(term, '\\p{{L}}+') GROUP BY term HAVING count(*) >= 3),
edge AS (SELECT term AS name, chunk_id FROM post JOIN ent ON term = name)"""


def dictionary(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    def write(path: str) -> None:
        post = text_index(spark, d).postings.where((F.length("term") >= 8) & F.col("term").rlike(r"^\p{L}+$"))
        e = post.groupBy("term").agg(F.sum("tf").alias("frequency"), F.count("*").alias("df")).where("df >= 3")
        e.select(F.col("term").alias("name"), F.when(F.length("term") % 2 == 0, "entity").otherwise("concept").alias("type"), F.lit("").alias("category"), "frequency").write.parquet(f"{path}/entries")
        names = spark.read.parquet(f"{path}/entries").select(F.col("name").alias("term"))
        post.join(names, "term").select(F.col("term").alias("name"), "chunk_id").write.parquet(f"{path}/edges")

    path = stored(spark, d, "dictionary", ("documents",), write)
    return spark.read.parquet(f"{path}/entries"), spark.read.parquet(f"{path}/edges")


@query(f"WITH {ENTRIES} SELECT name, type, frequency FROM ent")
def entity_known(spark, d):
    return entities.known_entities(dictionary(spark, d)[0]).select("name", "type", "frequency")


@query(f"WITH {ENTRIES} SELECT (SELECT count(*) FROM ent) AS entries, (SELECT count(*) FROM ent WHERE type = 'concept') AS concepts, (SELECT count(*) FROM ent WHERE type = 'entity') AS entities, (SELECT count(*) FROM edge) AS relations")
def struct_stats(spark, d):
    return entities.struct_stats(*dictionary(spark, d))


@query(f"WITH {ENTRIES} SELECT name, frequency FROM ent WHERE contains(name, 'tion') ORDER BY frequency DESC, name LIMIT 20")
def entry_fuzzy(spark, d):
    return entities.fuzzy(dictionary(spark, d)[0], "tion").select("name", "frequency")


@query(f"WITH {ENTRIES} SELECT chunk_id, name, type, frequency FROM edge JOIN ent USING (name)")
def entries_by_chunk(spark, d):
    e, edges = dictionary(spark, d)
    return entities.entries_by_chunk(e, edges, chunks(spark, d).select("chunk_id"))


MATCH = f"""{ENTRIES}, mt AS (SELECT item_id AS query_id, name, instr(lower(text), name) AS first FROM benchmark, ent WHERE contains(lower(text), name)),
rq AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(name) DESC, first, name) AS name_pos FROM mt)"""


def _requests(spark: SparkSession, d: str, e: DataFrame) -> DataFrame:
    return entities.ordered_matches(entities.match_names(texts(spark, d), e))


@query(f"WITH {MATCH} SELECT query_id, name, first, name_pos FROM rq")
def keyword_match(spark, d):
    return _requests(spark, d, dictionary(spark, d)[0]).select("query_id", "name", "first", "name_pos")


@query(f"WITH {MATCH} SELECT query_id, name_pos, name, type, frequency, chunk_id FROM rq JOIN ent USING (name) LEFT JOIN edge USING (name)")
def entity_lookup_or(spark, d):
    e, edges = dictionary(spark, d)
    return entities.lookup_or(_requests(spark, d, e).select("query_id", "name", "name_pos"), e.drop("category"), edges)


@query(f"""WITH {MATCH}, kn AS (SELECT query_id, name, name_pos, type, frequency FROM rq JOIN ent USING (name)),
nd AS (SELECT query_id, count(DISTINCT name) AS needed FROM kn GROUP BY ALL), sh AS (SELECT query_id, chunk_id FROM kn JOIN edge USING (name) JOIN nd USING (query_id) GROUP BY query_id, chunk_id, needed HAVING count(DISTINCT name) = needed)
SELECT query_id, name_pos, name, type, frequency, coalesce(chunk_id, -1) AS chunk_id FROM kn LEFT JOIN sh USING (query_id) WHERE type = 'entity'""")
def entity_lookup_and(spark, d):
    e, edges = dictionary(spark, d)
    hits = entities.lookup_and(_requests(spark, d, e).select("query_id", "name", "name_pos"), e.drop("category"), edges)
    return hits.withColumn("chunk_id", F.coalesce("chunk_id", F.lit(-1)))


RECALL = f"""{MATCH}, h AS (SELECT query_id, chunk_id AS doc_id, sum(1.0::DOUBLE / name_pos) AS w FROM rq JOIN edge USING (name) GROUP BY ALL), a AS (SELECT query_id, count(*) AS asked FROM rq GROUP BY ALL),
rc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS pos FROM (SELECT query_id, doc_id, round(w / asked, 6) AS score FROM h JOIN a USING (query_id))) WHERE pos <= 10)"""


@query(f"WITH {RECALL} SELECT query_id, doc_id, score, pos FROM rc")
def entity_recall_weighted(spark, d):
    e, edges = dictionary(spark, d)
    return entities.link_recall(_requests(spark, d, e).select("query_id", "name", "name_pos"), edges.withColumnRenamed("chunk_id", "doc_id"))


SLIDE = "SELECT doc_id, i AS chunk_index, substr(text, i * 700 + 1, 800) AS content FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 800 THEN 1 ELSE ceil((length(text) - 800) / 700.0)::INT + 1 END)) AS i FROM documents WHERE length(trim(text)) > 0)"


def _contents(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.col("text").alias("content"))


@query(f"SELECT doc_id, chunk_index::INT AS chunk_index, content FROM ({SLIDE})")
def chunk_sliding_800_100(spark, d):
    return chunking.sliding(_contents(spark, d))


@query("SELECT doc_id, i::INT AS chunk_index, substr(text, i * 1000 + 1, 1000) AS content FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 1000.0)::INT)) AS i FROM documents WHERE length(text) > 0) WHERE trim(substr(text, i * 1000 + 1, 1000)) <> ''")
def chunk_fixed_1000(spark, d):
    return chunking.fixed(_contents(spark, d))


@query()
def chunk_semantic(spark, d):
    return chunking.semantic(_contents(spark, d)).drop("wiki_links")


@query(f"SELECT doc_id, chunk_index::INT AS chunk_index, length(content) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, trim(content) ORDER BY chunk_index) AS again FROM ({SLIDE}) WHERE length(content) >= 50) WHERE again = 1")
def quality_gate(spark, d):
    return corpus.hard_gate(chunking.sliding(_contents(spark, d))).select("doc_id", "chunk_index", F.length("content").alias("n"))


@query(f"WITH c AS (SELECT length(content) AS v, row_number() OVER (ORDER BY length(content)) - 1 AS i, count(*) OVER () AS n FROM ({SLIDE})) SELECT max(n) AS n, min(v) AS least, max(v) AS most, round(avg(v), 6) AS mean, max(CASE WHEN i = least(floor(n * 0.5), n - 1) THEN v END) AS p50, max(CASE WHEN i = least(floor(n * 0.95), n - 1) THEN v END) AS p95 FROM c")
def quality_report(spark, d):
    return corpus.percentiles_by_index(chunking.sliding(_contents(spark, d)).select(F.length("content").alias("v")), "v", 0.5, 0.95)


@query("WITH c AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(n) AS n, min(v) AS least, max(v) AS most, round(avg(v), 6) AS mean, max(CASE WHEN i = least(floor(n * 0.5), n - 1) THEN v END) AS p50, max(CASE WHEN i = least(floor(n * 0.95), n - 1) THEN v END) AS p95, max(CASE WHEN i = least(floor(n * 0.99), n - 1) THEN v END) AS p99 FROM c GROUP BY event_type")
def latency_percentiles(spark, d):
    return corpus.percentiles_by_index(load(spark, d, "events").select("event_type", "value"), "value", 0.5, 0.95, 0.99, group=("event_type",))


@query("SELECT page_id, trim(regexp_replace(replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), chr(13) || chr(10), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), chr(10)) AS content FROM pages")
def clean_pages(spark, d):
    return load(spark, d, "pages").select("page_id", T.clean_steps(F.col("html")).alias("content"))


@query("SELECT doc_id, CASE WHEN starts_with(fl, '# ') THEN trim(substr(fl, 3)) WHEN fl = '' OR starts_with(fl, '|') OR starts_with(fl, '---') OR starts_with(fl, '###') THEN CASE WHEN hd <> '' THEN hd ELSE 'untitled' END ELSE fl END AS title FROM (SELECT doc_id, trim(string_split(text, chr(10))[1]) AS fl, trim(regexp_extract(text, '(?m)^# (.+)$', 1)) AS hd FROM documents)")
def title_extract(spark, d):
    return load(spark, d, "documents").select("doc_id", T.title(F.col("text"), F.lit("untitled")).alias("title"))


@query("SELECT doc_id, lang AS client, source AS project, 'report' AS doc_type, '2024' AS date FROM documents")
def filename_metadata(spark, d):
    m = T.filename_metadata(F.concat_ws("_", "lang", "source", F.lit("report"), F.lit("2024.md")))
    return load(spark, d, "documents").select("doc_id", m.alias("m")).select("doc_id", "m.client", "m.project", F.col("m.docType").alias("doc_type"), "m.date")


@query(f"SELECT doc_id, ceil((length(t) - length(o)) / 1.5 + length(o) / 4.0)::BIGINT AS tokens FROM (SELECT doc_id, t, regexp_replace(t, '{T.CJK}', '', 'g') AS o FROM (SELECT doc_id, text || repeat('，知识库（２０２４）、ｆ。', (doc_id % 4)::INT) AS t FROM documents))")
def token_estimate(spark, d):
    """Texts with Chinese letters and full-width marks behind some of them."""
    t = F.concat("text", F.repeat(F.lit("，知识库（２０２４）、ｆ。"), (F.col("doc_id") % 4).cast("int")))
    return load(spark, d, "documents").select("doc_id", T.estimate_tokens(t).alias("tokens"))


@query("SELECT count(*) AS documents, count(DISTINCT nullif(lang, '')) AS clients, count(DISTINCT nullif(source, '')) AS doc_types, count(*) AS chunks FROM documents")
def kb_stats(spark, d):
    return corpus.base_stats(chunks(spark, d), chunks(spark, d))


@query("SELECT source, count(*) AS documents FROM documents GROUP BY source ORDER BY documents DESC, source LIMIT 20")
def source_top20(spark, d):
    return load(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "source").limit(20)


@query("WITH b AS (SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id % 7 <> 0), a AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE md5(text) END AS digest FROM documents WHERE doc_id % 11 <> 0) SELECT coalesce(b.doc_id, a.doc_id) AS doc_key, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'deleted' WHEN a.digest <> b.digest THEN 'modified' ELSE 'unchanged' END AS change FROM b FULL JOIN a ON a.doc_id = b.doc_id")
def cdc_diff(spark, d):
    """A synthetic edit: some documents missing before, some after, some changed."""
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("doc_key"), F.md5("text").alias("digest"))
    after = docs.where("doc_key % 11 <> 0").withColumn("digest", F.when(F.col("doc_key") % 5 == 0, "x").otherwise(F.col("digest")))
    return corpus.diff(docs.where("doc_key % 7 <> 0"), after)


@query("SELECT doc_id, length(text) AS n FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id % 5 = 0")
def staging_upsert(spark, d):
    docs = _contents(spark, d)
    changed = docs.where("doc_id % 5 = 0")
    return corpus.upsert(docs, changed, changed.withColumn("content", F.lit("x"))).select("doc_id", F.length("content").alias("n"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))


@query("SELECT conv_id AS session_id, turn, role, CASE WHEN role = 'assistant' AND length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations) WHERE age <= 10")
def conversation_context(spark, d):
    return chat.context(_messages(spark, d))


@query("SELECT conv_id AS session_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'")
def message_pairs(spark, d):
    return chat.pairs(_messages(spark, d))


@query(f"SELECT conv_id AS session_id, turn, regexp_matches(trim(text), '{chat.FOLLOW_UP}') AS follow_up FROM conversations WHERE role = 'user'")
def follow_up_flag(spark, d):
    return _messages(spark, d).where("role = 'user'").select("session_id", "turn", chat.follow_up(F.col("content")).alias("follow_up"))


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, session::BIGINT AS session, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM s GROUP BY user_id, session")
def sessionize_30m(spark, d):
    return chat.sessions(load(spark, d, "events").select("event_id", "user_id", "ts"))


@query("""WITH rel AS (SELECT lang AS query_id, doc_id FROM labels JOIN documents USING (doc_id) WHERE quality = 1), got AS (SELECT lang AS query_id, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS pos FROM documents) WHERE pos <= 10)
SELECT w.query_id, round(coalesce(h, 0) / greatest(coalesce(g, 0), 1), 6) AS precision, round(coalesce(h, 0) / w, 6) AS recall FROM (SELECT query_id, count(*) AS w FROM rel GROUP BY ALL) w LEFT JOIN (SELECT query_id, count(*) AS g FROM got GROUP BY ALL) USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS h FROM got JOIN rel USING (query_id, doc_id) GROUP BY ALL) USING (query_id)""")
def eval_precision_recall(spark, d):
    docs = load(spark, d, "documents")
    pos = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    got = docs.select(F.col("lang").alias("query_id"), "doc_id", pos.alias("pos"))
    rel = load(spark, d, "labels").where("quality = 1").join(docs, "doc_id").select(F.col("lang").alias("query_id"), "doc_id")
    return chat.precision_recall(got, rel)


HAN = "的一是不了人我在有他这为之大来以个中上们到说国和地也"


def _han(text):
    """Latin letters as Chinese ones, without blanks: runs that only a dictionary can cut."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "abcdefghijklmnopqrstuvwxyz", HAN), " +", "")


@query()
def dictionary_tokens(spark, d):
    """Documents as Chinese runs, cut by the words of the dictionary (a table of words and frequencies)."""
    words = dictionary(spark, d)[0].select(_han(F.col("name")).alias("word"), "frequency")
    tokens = DictionaryTokenizer.of(words)(_han(F.col("text")))
    t = load(spark, d, "documents").select("doc_id", tokens.alias("t"))
    return t.select("doc_id", F.size("t").alias("tokens"), F.size(F.filter("t", lambda w: F.length(w) >= 8)).alias("words"), F.md5(F.array_join("t", "|")).alias("digest"))


@query()
def highlight(spark, d):
    hits = _bm25(spark, d, 5).join(texts(spark, d), "query_id").join(chunks(spark, d), "chunk_id")
    return hits.select("query_id", "chunk_id", T.highlight(F.col("content"), F.col("query")).alias("highlight"))


@query(_bm25_sql(20, 1.2, f""", {VEC}, {PAIR}, {RRF}, {ASSEMBLE.replace("SELECT query_id, rank,", ", done AS (SELECT query_id, rank,").replace("AS source FROM d4", "AS source, fl, text FROM d4)")},
rl AS (SELECT done.*, count(*) OVER (PARTITION BY query_id) AS size, round(len(list_intersect(qk, {TOK.format("substr(regexp_replace(done.text, '\\[\\[([^\\]]+)\\]\\]', '\\1', 'g'), 1, 4000)")}))::DOUBLE / greatest(len(qk), 1), 6) AS rel FROM done JOIN (SELECT item_id AS query_id, list_distinct({TOK.format('text')}) AS qk FROM benchmark) USING (query_id))
SELECT * FROM (SELECT query_id, chunk_id, CASE WHEN size > 5 THEN rel END AS relevance, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(CASE WHEN size > 5 THEN rel END, score) DESC, rank) AS reranked FROM rl WHERE size <= 5 OR rel >= 0.1) WHERE reranked <= 5"""))
def rerank_lexical(spark, d):
    found = fusion.assemble(_fused(spark, d, 30), chunks(spark, d))
    return chat.lexical_rerank(found, texts(spark, d), threshold=0.1).select("query_id", "chunk_id", "relevance", "reranked")


@query(_bm25_sql(20, 1.2, f""", {VEC}, {PAIR}, {RRF}, {ASSEMBLE.replace("pos <= 30", "pos <= 10").replace("rank <= 20", "rank <= 6").replace("SELECT query_id, rank,", ", done AS (SELECT query_id, rank,").replace("AS source FROM d4", "AS source, text FROM d4)")}
SELECT query_id, string_agg('[doc ' || doc_id || ']' || chr(10) || done.text, chr(10) || '---' || chr(10) ORDER BY score DESC, rank) || chr(10) || chr(10) || 'Question: ' || any_value(b.text) AS prompt FROM done JOIN benchmark b ON item_id = query_id GROUP BY query_id"""))
def prompt_build(spark, d):
    return chat.prompts(fusion.assemble(_fused(spark, d, 10), chunks(spark, d), top_k=3), texts(spark, d))


@query(f"SELECT item_id AS query_id, regexp_matches(text, '{'|'.join(routing.lexicon.BROAD_QUERIES)}') AS broad, CASE WHEN item_id % 2 = 0 THEN 20 ELSE 40 END AS recall, (CASE WHEN item_id % 2 = 0 THEN 1 ELSE 3 END) * (CASE WHEN regexp_matches(text, '{'|'.join(routing.lexicon.BROAD_QUERIES)}') THEN 3 ELSE 5 END) AS fused FROM benchmark")
def broad_query_sizes(spark, d):
    q = texts(spark, d).withColumn("s", routing.sizes(F.col("query"), F.col("query_id") % 2 == 0))
    return q.select("query_id", routing.is_broad(F.col("query")).alias("broad"), "s.recall", "s.fused")


@query("SELECT lang AS query_id, doc_id AS chunk_id FROM documents WHERE (lang, source) IN (('en', 'src0'), ('de', 'src1'))")
def doc_type_semijoin(spark, d):
    """Two type filters; the query without a match (fr) isn't filtered and is reported by the second frame."""
    wanted = spark.createDataFrame([("en", "src0"), ("de", "src1"), ("fr", "nothing")], "query_id string, doc_type string")
    hits, _ = corpus.doc_type_filter(wanted, chunks(spark, d).withColumnRenamed("client", "lang"))
    return hits.join(chunks(spark, d).select("chunk_id", F.col("client").alias("query_id")), ["chunk_id", "query_id"], "left_semi").select("query_id", "chunk_id")


@query(f"""WITH {MATCH}, pe AS (SELECT DISTINCT query_id, chunk_id, name FROM rq JOIN edge USING (name)), pp AS (SELECT query_id, chunk_id, name, text, string_split(lower(text), name) AS parts FROM pe JOIN documents ON doc_id = chunk_id),
oc AS (SELECT query_id, chunk_id, name, text, i, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(name))::BIGINT AS pl FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM pp)),
sp AS (SELECT query_id, chunk_id, text, greatest(pl - 200, 0) AS s, least(length(text), pl + length(name) + 200) AS e FROM oc WHERE i <= 3),
isl AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY query_id, chunk_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM sp),
gi AS (SELECT *, sum(nw) OVER (PARTITION BY query_id, chunk_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM isl), un AS (SELECT query_id, chunk_id, text, g, min(s) AS s, max(e) AS e FROM gi GROUP BY ALL)
SELECT query_id, chunk_id, string_agg(substr(text, (s + 1)::BIGINT, (e - s)::BIGINT), chr(10) ORDER BY s) AS context FROM un GROUP BY query_id, chunk_id""")
def entity_context(spark, d):
    e, edges = dictionary(spark, d)
    req = _requests(spark, d, e).select("query_id", "name", "name_pos")
    per = req.join(edges, "name").groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return per.join(chunks(spark, d), "chunk_id").select("query_id", "chunk_id", linking.contexts(F.col("content"), F.col("names")).alias("context"))


@query()
def entity_snippets(spark, d):
    e, edges = dictionary(spark, d)
    per = _requests(spark, d, e).select("query_id", "name").join(edges, "name").groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    s = per.join(chunks(spark, d), "chunk_id").select("query_id", "chunk_id", F.explode(linking.snippets(F.col("content"), F.col("names"))).alias("s"))
    return s.select("query_id", "chunk_id", "s.start", "s.end", "s.mentions")


@query()
def link_annotation(spark, d):
    names = dictionary(spark, d)[0].where("type = 'entity'")
    return linking.annotate_joined(chunks(spark, d), names).select("chunk_id", "n_linked", F.md5("content").alias("digest"))
