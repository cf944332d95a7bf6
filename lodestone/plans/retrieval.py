"""More registered queries: search by profile, the entity route, prompts, and the smaller operators on derived columns.

Where the driver's tables lack something (sections, tables, links, articles), the query writes it around the documents' texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import lexicon
from lodestone.functions import text as T
from lodestone.functions.tokenize import index_tokens, query_tokens
from lodestone.operators import bm25, chat, chunking, corpus, entities, model_calls, reports, routing, search
from lodestone.plans import catalog
from lodestone.plans.catalog import ENTRIES, MATCH, PAIR, POSTINGS, QTERMS, SLIDE, TOK, VEC, chunks, dictionary, load, query, texts
from lodestone.sources import tables
from lodestone.streaming import events

BROAD = "|".join(lexicon.BROAD_QUERIES)
VEC40, TOP = VEC.replace("pos <= 20", "pos <= 40"), 10


def _requests(spark: SparkSession, d: str, e: DataFrame) -> DataFrame:
    """The matched names of every query."""
    return entities.ordered_matches(entities.match_names(texts(spark, d), e)).select("query_id", "name", "name_pos")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vector path of the benchmark queries, 40 hits each."""
    v, pair = catalog.vector_of_queries(spark, d, 40)
    return v.withColumnRenamed("query_id", "vq").join(pair, "vq").drop("vq")


def _hybrid(spark: SparkSession, d: str, profile: str, allowed: DataFrame | None = None, req: DataFrame | None = None) -> DataFrame:
    """Each path is a written stage of its own. One that fails fails the query: its hits are part of the result."""
    e, edges = dictionary(spark, d)
    req = tables.written(_requests(spark, d, e), "requests") if req is None else req
    p = routing.profile(profile)
    paths = {"vector": lambda: _vectors(spark, d), "bm25": lambda: catalog._bm25(spark, d, 40)}
    if p.use_struct and allowed is None:
        paths["struct"] = lambda: search.struct_path(req, e.drop("category"), edges)
    found = {name: search.stage(name, path) for name, path in paths.items()}
    return search.hybrid(texts(spark, d), req, chunks(spark, d), found["vector"], found["bm25"], found.get("struct"), p, TOP, allowed)


def _hybrid_sql(profile: str, allowed: str = "", tail: str = "SELECT query_id, rank, chunk_id, doc_id, score, source FROM done") -> str:
    """`allowed`: SQL of (query_id, chunk_id)."""
    p = routing.profile(profile)
    skip = "(is_entity AND NOT EXISTS (SELECT 1 FROM rq r JOIN documents dd ON dd.doc_id = h0.chunk_id WHERE r.query_id = h0.query_id AND contains(dd.text, r.name)))" if p.use_entity_filter else "false"
    struct = """UNION ALL SELECT query_id, chunk_id, score, pos, 2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY np, chunk_id) AS pos FROM
  (SELECT query_id, chunk_id, min(name_pos) AS np, arg_min(frequency, name_pos)::DOUBLE AS score FROM rq JOIN ent USING (name) JOIN edge USING (name) WHERE type = 'entity' GROUP BY query_id, chunk_id))""" if p.use_struct else ""
    keep = "WHERE query_id NOT IN (SELECT query_id FROM al) OR (query_id, chunk_id) IN (SELECT (query_id, chunk_id) FROM al)" if allowed else ""
    bm = catalog._bm25_sql(40, 1.2, "").removeprefix(f"WITH {POSTINGS}, ")
    return f"""WITH {MATCH}, {bm}, {VEC40}, {PAIR}{f', al AS ({allowed})' if allowed else ''},
isq AS (SELECT item_id AS query_id, item_id IN (SELECT query_id FROM rq) AS is_entity, CASE WHEN regexp_matches(text, '{BROAD}') THEN 3 ELSE {TOP} END AS k FROM benchmark),
h0 AS (SELECT x.*, is_entity, k FROM (SELECT pr.query_id, chunk_id, score, pos, 0 AS ord FROM vt JOIN pr ON vq = vt.query_id UNION ALL SELECT query_id, chunk_id, score, pos, 1 FROM bm {struct}) x JOIN isq USING (query_id) WHERE pos <= CASE WHEN is_entity THEN 20 ELSE 40 END),
h1 AS (SELECT *, ord = 0 AND {skip} AS skip FROM h0 {keep}),
h2 AS (SELECT *, sum(CASE WHEN skip THEN 0 ELSE 1 END) OVER (PARTITION BY query_id, ord ORDER BY pos) AS eff FROM h1),
fu AS (SELECT query_id, chunk_id, is_entity, k, round(sum(CASE WHEN NOT skip THEN 1.0::DOUBLE / (60 + eff) END), 9) AS rrf, min(ord * 1000000 + pos) AS seq,
  max(CASE WHEN ord = 0 AND NOT skip THEN pos END) AS vector_rank, max(CASE WHEN ord = 1 AND NOT skip THEN pos END) AS bm25_rank FROM h2 GROUP BY query_id, chunk_id, is_entity, k),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(rrf, 0) DESC, seq) AS pos FROM fu),
jn AS (SELECT rk.*, doc_id, text, trim(string_split(text, chr(10))[1]) AS fl, {'is_entity' if p.use_entity_filter else 'false'} AS ent FROM rk JOIN documents ON chunk_id = doc_id WHERE pos <= CASE WHEN is_entity THEN k ELSE 3 * k END),
d1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, fl ORDER BY pos) AS again FROM jn),
d2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY pos) AS od, min(pos) OVER (PARTITION BY query_id, doc_id) AS dp FROM d1 WHERE again = 1),
d3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(rrf, 0) DESC, dp, pos) AS rank FROM d2 WHERE od <= CASE WHEN ent THEN 1 ELSE 5 END),
d4 AS (SELECT *, coalesce(min(rrf) OVER (PARTITION BY query_id), 0) AS lo, coalesce(max(rrf) OVER (PARTITION BY query_id), 0.001) AS hi FROM d3 WHERE rank <= CASE WHEN ent THEN {TOP} ELSE {2 * TOP} END),
done AS (SELECT query_id, rank, chunk_id, doc_id, text, floor((CASE WHEN hi = lo THEN 0.5::DOUBLE ELSE 0.05::DOUBLE + (coalesce(rrf, 0) - lo) / (hi - lo) * 0.90::DOUBLE END) * 10000 + 0.5) / 10000 AS score,
  CASE WHEN vector_rank IS NOT NULL AND bm25_rank IS NULL THEN 'vector' WHEN bm25_rank IS NOT NULL AND vector_rank IS NULL THEN 'bm25' ELSE 'hybrid' END AS source FROM d4)
{tail}"""


RESULT = ["query_id", "rank", "chunk_id", "doc_id", "score", "source"]


@query(_hybrid_sql("baseline"))
def hybrid_baseline(spark, d):
    return _hybrid(spark, d, "baseline").select(*RESULT)


@query(_hybrid_sql("struct"))
def hybrid_struct(spark, d):
    return _hybrid(spark, d, "struct").select(*RESULT)


@query(_hybrid_sql("no_entity_filter"))
def hybrid_no_entity_filter(spark, d):
    return _hybrid(spark, d, "no_entity_filter").select(*RESULT)


@query(_hybrid_sql("baseline", "SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark, documents WHERE item_id % 2 = 0 AND lang = 'en'"))
def hybrid_whitelist(spark, d):
    """Every second query is restricted to English documents, the others aren't."""
    e = chunks(spark, d).where("client = 'en'").select("chunk_id")
    q = texts(spark, d).where("query_id % 2 = 0").select("query_id", F.lit("en").alias("client"))
    return _hybrid(spark, d, "baseline", q.join(e.withColumn("client", F.lit("en")), "client").select("query_id", "chunk_id")).select(*RESULT)


CHAIN = f"""{MATCH}, nm AS (SELECT query_id, count(*) AS asked FROM rq GROUP BY ALL), kn AS (SELECT query_id, name, name_pos, type, frequency FROM rq JOIN ent USING (name)),
nd AS (SELECT query_id, count(DISTINCT name) AS needed FROM kn GROUP BY ALL), sh AS (SELECT query_id, chunk_id FROM kn JOIN edge USING (name) JOIN nd USING (query_id) GROUP BY query_id, chunk_id, needed HAVING count(DISTINCT name) = needed),
an AS (SELECT kn.query_id, name_pos, frequency, sh.chunk_id, 'and' AS step FROM kn JOIN sh USING (query_id) JOIN nm USING (query_id) WHERE type = 'entity' AND asked > 1),
oo AS (SELECT query_id, name_pos, frequency, chunk_id, 'or' AS step FROM kn JOIN edge USING (name) WHERE type = 'entity' AND query_id NOT IN (SELECT query_id FROM an)),
fs AS (SELECT query_id, chunk_id, step, min(name_pos) AS np, arg_min(frequency, name_pos) AS frequency FROM (FROM an UNION ALL FROM oo) GROUP BY query_id, chunk_id, step),
ct AS (SELECT * FROM (SELECT query_id, chunk_id, frequency::DOUBLE / 500 AS score, row_number() OVER (PARTITION BY query_id ORDER BY np, chunk_id) AS pos, step FROM fs) WHERE pos <= {TOP}),
lh AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / name_pos) AS w FROM rq JOIN edge USING (name) WHERE query_id NOT IN (SELECT query_id FROM ct) GROUP BY ALL),
ln AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM (SELECT query_id, chunk_id, round(w / asked, 6) AS score FROM lh JOIN nm USING (query_id))) WHERE pos <= {TOP}),
ch AS (FROM ct UNION ALL SELECT query_id, chunk_id, score, pos, 'links' FROM ln)"""


def _chain(spark: SparkSession, d: str, req: DataFrame | None = None) -> DataFrame:
    e, edges = dictionary(spark, d)
    req = tables.written(_requests(spark, d, e), "requests") if req is None else req
    return search.recall_chain(req, e.drop("category"), edges, edges.select("name", F.col("chunk_id").alias("doc_id")), chunks(spark, d), TOP)


@query(f"WITH {CHAIN} SELECT query_id, chunk_id, score, pos, step FROM ch")
def entity_recall_chain(spark, d):
    """All names, else any, else weighted links."""
    return _chain(spark, d)


@query(f"""WITH {CHAIN}, dt AS (SELECT doc_id, t, ceil((length(t) - length(o)) / 1.5 + length(o) / 4.0)::BIGINT AS tokens FROM (SELECT doc_id, t, regexp_replace(t, '{T.CJK}', '', 'g') AS o FROM (SELECT doc_id, regexp_replace(text, '\\[\\[([^\\]]+)\\]\\]', '\\1', 'g') AS t FROM documents))),
ed AS (SELECT query_id, chunk_id, tokens, tokens < {search.WHOLE_BELOW} AS whole, t, row_number() OVER w AS pos, sum(CASE WHEN tokens < {search.WHOLE_BELOW} THEN tokens ELSE {search.SNIPPETS} END) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM fs JOIN dt ON doc_id = chunk_id WINDOW w AS (PARTITION BY query_id ORDER BY np, chunk_id))
SELECT query_id, pos, chunk_id::VARCHAR AS name, tokens, whole, upto, CASE WHEN whole THEN md5(t) END AS digest FROM ed WHERE upto <= 6000""")
def entity_documents(spark, d):
    """The documents of each query's entities in a budget of 6,000 tokens."""
    e, edges = dictionary(spark, d)
    req = tables.written(_requests(spark, d, e), "requests")
    r = search.entity_documents(req, e.drop("category"), edges, chunks(spark, d))
    return r.select("query_id", F.col("pos").cast("long").alias("pos"), "name", "tokens", "whole", "upto", F.when(F.col("whole"), F.md5("content")).alias("digest"))


@query(_hybrid_sql("baseline", tail=f", {CHAIN.removeprefix(MATCH + ', ')}, mq AS (SELECT item_id AS query_id, CASE item_id % 5 WHEN 3 THEN 'entity' WHEN 4 THEN 'rrf' ELSE 'auto' END AS method FROM benchmark), en AS (SELECT query_id FROM mq WHERE method = 'entity' OR method = 'auto' AND query_id IN (SELECT query_id FROM ch)) SELECT query_id, chunk_id, score, pos::BIGINT AS pos, 'entity' AS route FROM ch WHERE query_id IN (SELECT query_id FROM en) UNION ALL SELECT query_id, chunk_id, score, rank, 'rrf' FROM done WHERE query_id NOT IN (SELECT query_id FROM en)"))
def routed_search(spark, d):
    """Queries ask for a route or leave it open; one left open takes the entity route if that finds anything, else hybrid search with its names."""
    q = texts(spark, d).select("query_id", F.when(F.col("query_id") % 5 == 3, "entity").when(F.col("query_id") % 5 == 4, "rrf").otherwise("auto").alias("method"))
    req = tables.written(_requests(spark, d, dictionary(spark, d)[0]), "requests")
    chain = tables.written(_chain(spark, d, req), "chain")
    r = entities.route(q, chain, tables.written(_hybrid(spark, d, "baseline", req=req).withColumnRenamed("rank", "pos"), "hybrid"))
    return r.withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {MATCH} SELECT item_id AS query_id, CASE WHEN item_id % 5 = 4 THEN 'forced' WHEN item_id NOT IN (SELECT query_id FROM rq) THEN 'no known entity' ELSE 'entity' END AS reason FROM benchmark")
def fallback_reason(spark, d):
    names = _requests(spark, d, dictionary(spark, d)[0]).groupBy("query_id").agg(F.collect_set("name").alias("names"))
    q = texts(spark, d).join(names, "query_id", "left")
    return q.select("query_id", search.fallback_reason(F.coalesce("names", F.array().cast("array<string>")), F.when(F.col("query_id") % 5 == 4, "rrf").otherwise("auto")).alias("reason"))


STOP = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in [*lexicon.STOP_WORDS, "and", "the", "der", "les", "los"]) + "]"
STOP_LIST = [*lexicon.STOP_WORDS, "and", "the", "der", "les", "los"]


@query(f"SELECT item_id AS query_id, list_aggregate(list_sort(list_distinct(list_filter({TOK.format('text')}, lambda t: NOT list_contains({STOP}, t)))), 'string_agg', ' ') AS terms FROM benchmark")
def query_terms(spark, d):
    """The query side of the tokenizer: distinct terms without stop words."""
    return texts(spark, d).select("query_id", F.array_join(F.array_sort(query_tokens(F.col("query"), STOP_LIST)), " ").alias("terms"))


@query(f"SELECT doc_id, len(list_filter({TOK.format('text')}, lambda t: NOT list_contains({STOP}, t)))::BIGINT AS n FROM documents")
def index_terms(spark, d):
    """The index side: all terms without stop words."""
    return load(spark, d, "documents").select("doc_id", F.size(index_tokens(F.col("text"), STOP_LIST)).cast("long").alias("n"))


@query(f"""WITH tok AS (SELECT doc_id AS chunk_id, unnest(list_filter({TOK.format('text')}, lambda t: NOT list_contains({STOP}, t))) AS term FROM documents WHERE trim(text) <> ''), post AS (SELECT term, chunk_id, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id AS chunk_id, len(list_filter({TOK.format('text')}, lambda t: NOT list_contains({STOP}, t))) AS dl FROM documents WHERE trim(text) <> ''), corp AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM post GROUP BY term), {QTERMS},
sc AS (SELECT query_id, post.chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN post USING (term) JOIN df USING (term) JOIN dl ON dl.chunk_id = post.chunk_id, corp GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM sc) WHERE pos <= 20""")
def bm25_stopwords(spark, d):
    return bm25.search(bm25.build_index(chunks(spark, d), STOP_LIST), texts(spark, d), 20, stop=STOP_LIST)


@query("SELECT item_id AS pos, doc_id AS chunk_id, length(documents.text) AS n FROM benchmark JOIN documents ON doc_id = item_id * 7 % 1500")
def chunk_lookup(spark, d):
    wanted = texts(spark, d).select(F.col("query_id").alias("pos"), (F.col("query_id") * 7 % 1500).alias("chunk_id"))
    return corpus.lookup_in_order(wanted, chunks(spark, d)).select("pos", "chunk_id", F.length("content").alias("n"))


@query(f"SELECT doc_id::VARCHAR AS doc_id, chunk_index::INT AS chunk_index FROM ({SLIDE}) WHERE CASE WHEN chunk_index = 0 THEN doc_id ELSE doc_id + 1 END % 10 = 0 OR doc_id % 10 = 0")
def staging_by_doc(spark, d):
    """Chunks of every tenth document; those after a document's first belong to the next one's parent besides."""
    c = chunking.sliding(load(spark, d, "documents").select("doc_id", F.col("text").alias("content")))
    c = c.select(F.col("doc_id").cast("string"), "chunk_index", F.when(F.col("chunk_index") > 0, F.concat(F.lit("parent_"), (F.col("doc_id") + 1).cast("string"))).alias("parent_doc_id"))
    ids = load(spark, d, "documents").select((F.floor(F.col("doc_id") / 10) * 10).cast("string").alias("doc_id")).unionByName(load(spark, d, "documents").select((F.floor(F.col("doc_id") / 10) * 10 + 10).cast("string").alias("doc_id")))
    return corpus.by_document(c, ids).select("doc_id", "chunk_index")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1'")
def document_browse(spark, d):
    return corpus.browse(chunks(spark, d), client="en", doc_type="src1", doc_id="").select("doc_id")


@query(f"WITH {ENTRIES} SELECT 'wiki_' || name AS chunk_id, '# ' || name || chr(10) || CASE type WHEN 'entity' THEN '实体' ELSE '概念' END || ' | 出现频次: ' || frequency AS content FROM ent")
def wiki_chunks(spark, d):
    return corpus.wiki_chunks(dictionary(spark, d)[0]).select("chunk_id", "content")


@query("SELECT 'client' AS facet, lang AS value, count(*) AS documents FROM documents WHERE lang <> '' GROUP BY ALL UNION ALL SELECT 'doc_type', source, count(*) FROM documents WHERE source <> '' GROUP BY ALL")
def kb_facets(spark, d):
    return corpus.kb_facets(chunks(spark, d).withColumn("project", F.lit("")))


@query(f"WITH {ENTRIES} SELECT * FROM (SELECT type, row_number() OVER (PARTITION BY type ORDER BY frequency DESC, name) AS pos, name, frequency FROM ent) WHERE pos <= 20")
def top_entries(spark, d):
    return corpus.top_entries(dictionary(spark, d)[0])


LINKED = "'[[' || source || ']] ' || coalesce(text, '') || ' [[x y]] [[ ' || lang || ' ]] [[x y]]'"


def _linked(spark: SparkSession, d: str) -> DataFrame:
    c = F.concat(F.lit("[["), "source", F.lit("]] "), F.coalesce("text", F.lit("")), F.lit(" [[x y]] [[ "), "lang", F.lit(" ]] [[x y]]"))
    return load(spark, d, "documents").select("doc_id", c.alias("content"))


@query(f"SELECT doc_id, list_aggregate(list_transform(list_distinct(list_transform(regexp_extract_all({LINKED}, '\\[\\[([^\\]]+)\\]\\]', 1), lambda x: trim(x))), lambda x: x).list_sort(), 'string_agg', '|') AS links, length(regexp_replace({LINKED}, '\\[\\[([^\\]]+)\\]\\]', '\\1', 'g')) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def wiki_links(spark, d):
    docs = _linked(spark, d).where("content IS NOT NULL")
    return docs.select("doc_id", F.array_join(F.array_sort(T.wiki_links(F.col("content"))), "|").alias("links"), F.length(T.strip_links(F.col("content"))).alias("n"))


@query(f"SELECT doc_id, 'doc ' || doc_id AS title, 0 AS n_links, (SELECT count(*) FROM ({SLIDE}) s WHERE s.doc_id = documents.doc_id) AS chunk_count FROM documents")
def document_list(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), F.array().cast("array<string>").alias("wiki_links"))
    return corpus.document_list(docs, chunking.sliding(load(spark, d, "documents").select("doc_id", F.col("text").alias("content"))))


@query("SELECT round(avg((doc_id % 3 = 0)::INT::DOUBLE), 6) AS struct, round(avg((doc_id % 3 = 1)::INT::DOUBLE), 6) AS rrf FROM documents")
def route_share(spark, d):
    m = F.when(F.col("doc_id") % 3 == 0, "Struct-AND").when(F.col("doc_id") % 3 == 1, "hybrid RRF").otherwise("none")
    return corpus.route_share(load(spark, d, "documents").select(m.alias("method")))


@query("SELECT sample_id, value FROM (SELECT doc_id AS sample_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE quality * 0.5 END::DOUBLE AS value FROM labels) ORDER BY coalesce(value, 1), sample_id LIMIT 5")
def worst_samples(spark, d):
    v = F.when(F.col("doc_id") % 4 != 0, F.col("quality") * 0.5)
    return corpus.worst(load(spark, d, "labels").select(F.col("doc_id").alias("sample_id"), v.alias("value")), "value")


@query("SELECT conv_id, turn FROM conversations WHERE trim(text) <> '' AND turn % 5 <> 0")
def answered_samples(spark, d):
    s = load(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("answer"), F.when(F.col("turn") % 5 == 0, "timeout").otherwise("").alias("error"))
    return corpus.answered(s).select("conv_id", "turn")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations), m AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS ans FROM r WHERE age <= 10 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT conv_id, coalesce(string_agg(CASE WHEN role = 'user' THEN CASE WHEN nr = 'assistant' THEN '用户: ' || text || chr(10) || '助手: ' || substr(ans, 1, 300) || CASE WHEN length(ans) > 300 THEN '...' ELSE '' END ELSE '用户: ' || text END END, chr(10) || chr(10) ORDER BY turn), '') AS p, coalesce(bool_or(age = 2 AND role = 'assistant'), false) AS f FROM m GROUP BY conv_id)
SELECT conv_id AS session_id, md5(CASE WHEN conv_id % 3 = 0 THEN '## 对话历史摘要' || chr(10) || 'earlier ' || conv_id || chr(10) || chr(10) ELSE '' END || CASE WHEN p <> '' THEN '## 最近对话' || chr(10) || p ELSE '' END) AS digest, f AS has_follow_up FROM g""")
def conversation_history(spark, d):
    m = load(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))
    s = m.where("session_id % 3 = 0").select("session_id").distinct().withColumn("summary", F.concat(F.lit("earlier "), F.col("session_id").cast("string")))
    return chat.history(m, s).select("session_id", F.md5("history").alias("digest"), "has_follow_up")


BLOCKS = """nb AS (SELECT dn.*, lang, documents.source AS kind, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS nr FROM done dn JOIN documents USING (doc_id) WHERE rank <= 5),
cx AS (SELECT query_id, string_agg('### 文档 ' || nr || ': doc ' || doc_id || ' (' || '客户: ' || lang || ' | 类型: ' || kind || ')' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY nr) AS context FROM nb GROUP BY query_id)"""


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    meta = chunks(spark, d).select("chunk_id", "client", "doc_type", F.lit("").alias("project"), F.lit(None).cast("string").alias("date"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"))
    return chat.context_blocks(_hybrid(spark, d, "baseline").where("rank <= 5").join(meta, "chunk_id"))


@query(_hybrid_sql("baseline", tail=f", {BLOCKS} SELECT query_id, md5(context) AS digest FROM cx"))
def prompt_context(spark, d):
    """The five best results of each query as headed blocks."""
    return _blocks(spark, d).select("query_id", F.md5("context").alias("digest"))


TEMPLATES = {"base": "Use:\n{context}\n\nQuestion: {query}", "compare": "Compare by:\n{context}\n\nQuestion: {query}", "followup": "Before:\n{history}\n\nUse:\n{context}\n\nThen: {query}"}


@query(_hybrid_sql("baseline", tail=f""", {BLOCKS}, rqs AS (SELECT item_id AS query_id, text AS query, CASE WHEN item_id % 3 = 0 THEN 'article' ELSE '' END AS docs, 'was ' || item_id || ' {{query}}' AS hist, item_id % 4 = 1 AS fu, item_id % 4 = 2 AS cmp FROM benchmark),
w AS (SELECT *, CASE WHEN docs <> '' AND context IS NOT NULL THEN docs || chr(10) || chr(10) || context ELSE coalesce(context, docs) END AS whole FROM rqs LEFT JOIN cx USING (query_id))
SELECT query_id, CASE WHEN fu THEN 'followup' WHEN cmp THEN 'compare' ELSE 'base' END AS template, md5(CASE WHEN whole = '' THEN NULL WHEN fu THEN 'Before:' || chr(10) || hist || chr(10) || chr(10) || 'Use:' || chr(10) || whole || chr(10) || chr(10) || 'Then: ' || query
 ELSE CASE WHEN cmp THEN 'Compare by:' ELSE 'Use:' END || chr(10) || whole || chr(10) || chr(10) || 'Question: ' || query || chr(10) || chr(10) || hist END) AS digest, CASE WHEN whole = '' THEN 'no query or no context' END AS error FROM w"""))
def prompt_templates(spark, d):
    q = texts(spark, d).join(_blocks(spark, d), "query_id", "left")
    q = q.select("query_id", "query", "context", F.when(F.col("query_id") % 3 == 0, "article").otherwise("").alias("entity_docs"), F.concat(F.lit("was "), F.col("query_id").cast("string"), F.lit(" {query}")).alias("history"), F.when(F.col("query_id") % 4 == 2, "compare").alias("intent"), (F.col("query_id") % 4 == 1).alias("is_follow_up"))
    return chat.build(q, TEMPLATES).select("query_id", "template", F.md5("prompt").alias("digest"), "error")


@query(_hybrid_sql("baseline", tail=""", sc2 AS (SELECT done.*, CASE WHEN chunk_id % 3 <> 0 AND query_id % 7 <> 0 THEN (chunk_id * 7919 % 100) / 100.0::DOUBLE END AS rel, count(*) OVER (PARTITION BY query_id) AS size FROM done),
a2 AS (SELECT *, count(rel) OVER (PARTITION BY query_id) AS answers FROM sc2), k2 AS (SELECT *, size <= 5 OR answers = 0 AS asis FROM a2),
o2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN asis THEN 0 WHEN rel IS NOT NULL THEN 1 ELSE 2 END, CASE WHEN asis THEN -rank ELSE coalesce(rel, score) END DESC, rank) AS reranked FROM k2 WHERE asis OR rel IS NULL OR rel >= 0.5)
SELECT query_id, chunk_id, CASE WHEN asis THEN score ELSE coalesce(rel, score) END AS score, reranked FROM o2 WHERE reranked <= 5"""))
def rerank_model(spark, d):
    """A stand-in model scores two results in three and answers nothing for every seventh query."""
    r = _hybrid(spark, d, "baseline")
    scored = r.where("chunk_id % 3 <> 0 AND query_id % 7 <> 0").select("query_id", "chunk_id", ((F.col("chunk_id") * 7919 % 100) / 100).alias("relevance"))
    return chat.rerank(r, scored)


@query(_hybrid_sql("baseline", tail="SELECT query_id, chunk_id, md5(substr(text, 1, 500)) AS digest, count(*) OVER (PARTITION BY query_id) AS total FROM done"))
def search_response(spark, d):
    return chat.search_response(_hybrid(spark, d, "baseline")).select("query_id", "chunk_id", F.md5("content").alias("digest"), "total")


@query(f"WITH {ENTRIES} SELECT type AS category, string_agg(name, ',' ORDER BY r) AS names FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY frequency DESC, name) AS r FROM ent) WHERE r <= CASE type WHEN 'entity' THEN 15 WHEN 'concept' THEN 8 ELSE 0 END GROUP BY type")
def rewrite_names(spark, d):
    e = dictionary(spark, d)[0].withColumn("category", F.col("type"))
    return chat.rewrite_names(e, {"entity": 15, "concept": 8}).select("category", F.array_join("names", ",").alias("names"))


@query(f"WITH {ENTRIES} SELECT DISTINCT chunk_id AS doc_id, name, type FROM edge JOIN ent USING (name)")
def entries_by_document(spark, d):
    e, edges = dictionary(spark, d)
    return entities.entries_by_chunk(e, edges, chunks(spark, d).select("chunk_id")).select(F.col("chunk_id").alias("doc_id"), "name", "type").distinct()


@query(f"WITH {ENTRIES} SELECT name, count(*) AS n_chunks, min(chunk_id) AS first_chunk FROM edge GROUP BY name")
def link_index(spark, d):
    e, edges = dictionary(spark, d)
    per = edges.groupBy("chunk_id").agg(F.collect_set("name").alias("wiki_links"))
    return entities.link_index(per)


@query(f"WITH {ENTRIES} SELECT name, array_to_string(list(chunk_id ORDER BY chunk_id), ',') AS chunk_ids FROM edge GROUP BY name")
def link_lists(spark, d):
    """Every link's chunks; here a link's parts are put together."""
    per = dictionary(spark, d)[1].groupBy("chunk_id").agg(F.collect_set("name").alias("wiki_links"))
    whole = entities.link_lists(per).groupBy("name").agg(F.array_sort(F.flatten(F.collect_list("chunk_ids"))).alias("ids"))
    return whole.select("name", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("chunk_ids"))


@query(f"WITH {ENTRIES} SELECT edge.name, chunk_id, trim(translate(substr(text, 1, 200), chr(10), ' ')) AS context FROM edge JOIN documents ON chunk_id = doc_id")
def entry_relations(spark, d):
    e, edges = dictionary(spark, d)
    per = edges.groupBy("chunk_id").agg(F.collect_set("name").alias("wiki_links")).withColumn("wiki_links", F.array_append("wiki_links", F.lit("unknown name")))
    return entities.relations(per.join(chunks(spark, d), "chunk_id"), e)


@query("SELECT lang AS name, arg_max(source, doc_id) AS type, max(doc_id) AS ordinal FROM documents GROUP BY lang")
def entries_last_wins(spark, d):
    return entities.last_wins(load(spark, d, "documents").select(F.col("lang").alias("name"), F.col("source").alias("type"), F.col("doc_id").alias("ordinal")))


@query("SELECT lang AS name, source AS chunk_id, md5(arg_min(text, doc_id)) AS context FROM documents GROUP BY lang, source")
def edges_first_wins(spark, d):
    e = load(spark, d, "documents").select(F.col("lang").alias("name"), F.col("source").alias("chunk_id"), F.md5("text").alias("context"), F.col("doc_id").alias("ordinal"))
    return entities.first_edges(e)


@query("SELECT coalesce(o.name, n.name) AS name, greatest(o.f, n.f) AS frequency, CASE WHEN o.name IS NULL THEN 'created' ELSE 'updated' END AS action FROM (SELECT doc_id AS name, n_chars AS f FROM documents WHERE doc_id % 3 <> 0) o FULL JOIN (SELECT doc_id AS name, n_chars % 1000 AS f FROM documents WHERE doc_id % 5 <> 0) n ON o.name = n.name")
def wiki_merge(spark, d):
    docs = load(spark, d, "documents")
    return routing.merge_wiki(docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("name"), F.col("n_chars").alias("frequency")), docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("name"), (F.col("n_chars") % 1000).alias("frequency")))



def _articles(spark: SparkSession, d: str) -> DataFrame:
    lit = F.lit
    c = F.concat(lit("# "), "source", lit("\n> "), "lang", lit(" | x\n> 定义: about "), F.col("doc_id").cast("string"), lit("\n出现频次: "), F.col("n_chars").cast("string"), lit("\n\n\nend"))
    return load(spark, d, "documents").where("source IS NOT NULL AND lang IS NOT NULL").select("doc_id", c.alias("content"))


@query("SELECT doc_id, lang AS category, n_chars::INT AS frequency, 'about ' || doc_id AS definition, length('# ' || source || chr(10) || '> ' || lang || ' | x' || chr(10) || '> 定义: about ' || doc_id || chr(10) || chr(10) || 'end') AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def wiki_articles(spark, d):
    """Articles written from the documents' columns, parsed and cleaned."""
    p = _articles(spark, d).select("doc_id", T.parse_wiki_entry(F.col("content"), F.lit("concept")).alias("p"), F.length(T.clean_wiki(F.col("content"))).alias("n"))
    return p.select("doc_id", "p.category", "p.frequency", "p.definition", "n")



def _tabled(spark: SparkSession, d: str) -> DataFrame:
    c = F.concat(F.lit("## one\n"), "text", F.lit("\n## two\n| a | b |\n"), F.when(F.col("doc_id") % 2 == 0, "| --- | --- |\n").otherwise(""), F.lit("| 1 | 2 |"))
    return load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", c.alias("content"))


@query("SELECT doc_id, len(list_filter(string_split(c, chr(10)), lambda x: starts_with(x, '## '))) AS sections, doc_id % 2 <> 0 AS broken FROM (SELECT doc_id, '## one' || chr(10) || text || chr(10) || '## two' AS c FROM documents WHERE text IS NOT NULL)")
def sections_and_tables(spark, d):
    """Documents with two headings and a table, which lacks its rule line in every second."""
    return _tabled(spark, d).select("doc_id", F.size(T.sections(F.col("content"))).cast("long").alias("sections"), corpus.broken_tables(F.col("content")).alias("broken"))


@query("WITH c AS (SELECT lang AS sample_id, doc_id % 2 <> 0 AS broken FROM documents WHERE text IS NOT NULL), b AS (SELECT sample_id, count(*) AS n, sum(broken::INT) AS k FROM c GROUP BY ALL) SELECT round(sum(k) / greatest(sum(n), 1), 6) AS chunk_rate, round(sum((k > 0)::INT) / greatest(count(*), 1), 6) AS sample_rate FROM b")
def truncation_rates(spark, d):
    return corpus.truncation_rates(_tabled(spark, d).join(load(spark, d, "documents").select("doc_id", F.col("lang").alias("sample_id")), "doc_id"))


@query(f"SELECT count(*) AS chunks, min(length(content)) AS least, max(length(content)) AS most, floor(avg(length(content)))::BIGINT AS mean FROM ({SLIDE})")
def chunk_report(spark, d):
    return corpus.chunk_report(chunking.sliding(load(spark, d, "documents").select("doc_id", F.col("text").alias("content"))))


@query(f"SELECT doc_id, chunk_index::INT AS chunk_index, CASE WHEN length(content) < 100 THEN 'short' ELSE '' END AS warnings FROM ({SLIDE})")
def soft_warnings(spark, d):
    c = chunking.sliding(load(spark, d, "documents").select("doc_id", F.col("text").alias("content"))).withColumn("wiki_links", F.array().cast("array<string>"))
    return corpus.soft_warnings(c).select("doc_id", "chunk_index", F.array_join("warnings", ",").alias("warnings"))


@query("""SELECT conv_id AS session_id, turn, role, md5(text) AS digest FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations) WHERE NOT (n >= 6 AND conv_id % 2 = 0) OR age <= 2
UNION ALL SELECT conv_id, -1, 'summary', md5('sum ' || conv_id) FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id HAVING count(*) >= 6""")
def history_compaction(spark, d):
    m = load(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))
    s = m.where("session_id % 2 = 0").select("session_id").distinct().withColumn("summary", F.concat(F.lit("sum "), F.col("session_id").cast("string")))
    return events.compact(m, s).select("session_id", "turn", "role", F.md5("content").alias("digest"))


@query("SELECT item_id AS session_id, 2 + CASE WHEN item_id % 3 = 0 THEN 1 ELSE 3 END AS n, CASE item_id % 3 WHEN 0 THEN 'no-llm' ELSE 'done' END AS last FROM benchmark")
def chat_event_order(spark, d):
    a = texts(spark, d).select(F.col("query_id").alias("session_id"), F.lit("rrf").alias("method"), F.col("query").alias("context"), F.lit("two words").alias("answer"), F.when(F.col("query_id") % 3 == 0, "no-llm").otherwise("ok").alias("status"))
    return events.chat_events(a).groupBy("session_id").agg(F.count("*").alias("n"), F.max_by("type", "seq").alias("last"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN '项目系统' WHEN doc_id % 2 = 0 THEN '人员' ELSE '项目系统' END AS category FROM documents")
def entity_categories(spark, d):
    name = F.when(F.col("lang") == "en", F.lit("plain")).when(F.col("doc_id") % 2 == 0, F.lit("张三丰")).otherwise(F.lit("某个很长的名字"))
    return load(spark, d, "documents").select("doc_id", routing.entity_category(name).alias("category"))


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND length(text) <= 500 AND n_chars >= 2")
def needs_definition(spark, d):
    return load(spark, d, "documents").where(routing.needs_definition(F.col("text"), F.col("n_chars"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0")
def extraction_queue(spark, d):
    """Raw documents that this build hasn't extracted yet."""
    c = load(spark, d, "documents").select(F.concat(F.when(F.col("doc_id") % 3 == 0, "wiki_").otherwise("raw_"), F.col("doc_id").cast("string")).alias("doc_id"), F.lit("b1").alias("built_at"), F.col("doc_id").alias("id"))
    done = c.where("id % 4 = 0").select("doc_id", "built_at")
    return routing.to_extract(c, done).select(F.col("id").alias("doc_id"))


@query(f"WITH {POSTINGS} SELECT term, chunk_id, tf FROM post WHERE chunk_id % 9 <> 0 UNION ALL SELECT 'fresh', chunk_id, 1 FROM post WHERE chunk_id % 9 = 0 GROUP BY chunk_id")
def index_update(spark, d):
    """Postings after every ninth document changed to one new word."""
    post = catalog.text_index(spark, d).postings.withColumn("chunk_id", F.concat(F.col("chunk_id").cast("string"), F.lit("_0")))
    changed = post.select(F.regexp_replace("chunk_id", r"_\d+$", "").alias("doc_id")).where("cast(doc_id as long) % 9 = 0").distinct()
    fresh = changed.select(F.lit("fresh").alias("term"), F.concat("doc_id", F.lit("_0")).alias("chunk_id"), F.lit(1).cast("long").alias("tf"))
    return bm25.merge_index(post, changed, fresh).select("term", F.regexp_replace("chunk_id", r"_\d+$", "").cast("long").alias("chunk_id"), "tf")


CONCEPT = "Write about {name}.\nKnown: {definition}\n{contexts}\nEnd."


@query(f"""WITH {ENTRIES}, cn AS (SELECT name, frequency, CASE WHEN length(name) % 3 = 0 THEN 'word of ' || length(name) || ' letters' ELSE '' END AS def FROM ent WHERE type = 'concept'),
md AS (SELECT name, chunk_id, row_number() OVER (PARTITION BY name ORDER BY chunk_id) AS pos FROM edge JOIN cn USING (name) WHERE chunk_id IN (SELECT doc_id FROM documents WHERE length(text) > 100)),
cx AS (SELECT name, string_agg(pos || '. doc ' || doc_id || ': ' || trim(replace(substr(text, 1, 500), chr(10), ' ')), chr(10) ORDER BY pos) AS contexts FROM md JOIN documents ON doc_id = chunk_id WHERE pos <= 3 GROUP BY name),
pm AS (SELECT name, frequency, def, md5('Write about ' || name || '.' || chr(10) || 'Known: ' || def || chr(10) || coalesce(contexts, '') || chr(10) || 'End.') AS digest FROM cn LEFT JOIN cx USING (name))
SELECT name, CASE WHEN starts_with(digest, '7') THEN 2 ELSE 1 END AS run, md5('# ' || name || chr(10) || chr(10) || '> 概念 | 出现频次: ' || frequency || chr(10) || CASE WHEN def <> '' THEN '> 定义: ' || def || chr(10) ELSE '' END || '> 来源: LLM生成' || chr(10) || chr(10) || '## 定义' || chr(10) || digest) AS digest FROM pm""")
def concept_articles(spark, d):
    """An article for every concept, by a stand-in model that fails on one prompt in 16 at first; the second run asks for those only."""
    e, edges = dictionary(spark, d)
    defined = F.when(F.length("name") % 3 == 0, F.concat(F.lit("word of "), F.length("name").cast("string"), F.lit(" letters"))).otherwise("")
    concepts = e.where("type = 'concept'").select("name", "frequency", defined.alias("definition"))
    docs = load(spark, d, "documents").select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content"))
    contexts = model_calls.concept_contexts(concepts, edges.withColumnRenamed("chunk_id", "doc_id"), docs)
    prompts = tables.written(model_calls.concept_prompts(concepts, contexts, CONCEPT), "prompts")
    path = f"{tables.work_dir(spark)}/model-calls-{uuid.uuid4().hex}"
    model_calls.run(prompts, model_calls.StandIn("## 定义\n", fails="7"), path)
    calls = model_calls.run(prompts, model_calls.StandIn("## 定义\n"), path)
    return model_calls.concept_articles(concepts, calls).select("name", "run", F.md5("content").alias("digest"))


ROWS = "\n| a | b |\n| --- | --- |\n" + "| 1 | 2 |\n" * 30
CUT_CHUNKS = f"""td AS (SELECT doc_id, text || '{ROWS}' AS text FROM documents WHERE text IS NOT NULL), tc AS ({SLIDE.replace("FROM documents", "FROM td")}),
tm AS (SELECT doc_id, chunk_index::INT AS chunk_index, length(content) AS n, array_to_string(list_transform(string_split(content, chr(10)), lambda x: CASE WHEN starts_with(trim(x), '|') AND ends_with(trim(x), '|') THEN CASE WHEN contains(x, '---') THEN 'r' ELSE 't' END ELSE ' ' END), '') AS m FROM tc),
tf AS (SELECT doc_id, chunk_index, n, trim(m) <> '' AS has_table, regexp_matches(m, '(^| )(r|t+)( |$)') AS is_cut FROM tm)"""


def _chunk_report(spark: SparkSession, d: str) -> reports.Report:
    """A report on sliding chunks of documents that end with a table, taken while they are written."""
    docs = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.concat("text", F.lit(ROWS)).alias("content"))
    return reports.write_chunks(chunking.sliding(docs), f"{tables.work_dir(spark)}/chunks-{uuid.uuid4().hex}")


@query(f"WITH {CUT_CHUNKS} SELECT count(*) AS chunks, count_if(has_table)::BIGINT AS tables, count_if(is_cut)::BIGINT AS cut, count_if(n < 100)::BIGINT AS short, coalesce(min(n), 0) AS least, coalesce(max(n), 0) AS most, coalesce(floor(avg(n)), 0)::BIGINT AS mean FROM tf")
def chunk_write_report(spark, d):
    """The figures that were observed while the chunks were written."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in _chunk_report(spark, d).summary.items()])


@query(f"WITH {CUT_CHUNKS} SELECT doc_id, count(*) AS chunks, count_if(has_table)::BIGINT AS tables, count_if(is_cut)::BIGINT AS cut FROM tf GROUP BY doc_id")
def chunk_document_counts(spark, d):
    """Every document's chunks, those with a table and those with a cut one, from what was written."""
    return reports.document_counts(_chunk_report(spark, d))
