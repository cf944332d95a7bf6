"""Inverted index and BM25 ranking as joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions.tokenize import Tokenizer, index_tokens, query_tokens, regex_tokens
from lodestone.sources import tables

#: Postings a row of a task's counts at most, and tokens that a task counts together.
RUN, TOKENS = 64, 1_000_000
#: Chunks and queries a block of a search, pairs of a query and a posting scored together, rows that a task holds before it hands them on.
CHUNKS, QUERIES, PIECE, HELD = 2048, 512, 1_000_000, 1_000_000


class TextIndex(NamedTuple):
    """postings(term, chunk_id, tf, dl), doc_len(chunk_id, dl), term_stats(term, df), corpus(n, avgdl)."""

    postings: DataFrame
    doc_len: DataFrame
    term_stats: DataFrame
    corpus: DataFrame


def _counted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(chunk_id, tokens) -> (term, ids, counts, lengths) in runs of at most RUN chunks; the runs of a null term hold the chunks' lengths as counts."""
    t = pa.Table.from_batches(held)
    ids, lists = t.column(0).combine_chunks(), t.column(1).combine_chunks()
    coded = pc.list_flatten(lists).dictionary_encode()
    key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(ids) + pc.list_parent_indices(lists).to_numpy()
    key, tf = np.unique(key, return_counts=True)
    none = len(coded.dictionary)
    term, row = np.r_[key // len(ids), np.full(len(ids), none)], np.r_[key % len(ids), np.arange(len(ids))]
    length = pc.list_value_length(lists).to_numpy()
    tf = np.r_[tf, length]
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    place = np.arange(len(term)) - np.repeat(first, np.diff(np.r_[first, len(term)]))
    start = np.flatnonzero(place % RUN == 0)
    ends = pa.array(np.r_[start, len(term)], pa.int32())
    words = pa.concat_arrays([coded.dictionary, pa.nulls(1, coded.dictionary.type)]).take(pa.array(term[start]))
    parts = [ids.take(pa.array(row)), pa.array(tf, pa.int32()), pa.array(length[row], pa.int32())]
    return pa.RecordBatch.from_arrays([words, *(pa.ListArray.from_arrays(ends, x) for x in parts)], ["term", "ids", "counts", "lengths"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += pc.sum(pc.list_value_length(b.column(1))).as_py() or 0
        if size > TOKENS:
            yield _counted(held)
            held, size = [], 0
    if held:
        yield _counted(held)


def build_index(chunks: DataFrame, stop: list[str] = (), tokenizer: Tokenizer = regex_tokens) -> TextIndex:
    """Index `chunks(chunk_id, content)`, whose chunk_id is a key; empty contents are left out.

    Words are counted where the chunks are read, so a posting is shuffled at most once, in runs that share their word. The runs
    are written to the shared folder: texts are read and cut once for postings and lengths. Runs are dealt by ranges of (term, chunk),
    so a word of all chunks is divided too.
    """
    tables.small_batches(chunks.sparkSession)
    tokens = chunks.where(F.trim("content") != "").select("chunk_id", index_tokens(F.col("content"), stop, tokenizer).alias("tokens"))
    of = types.ArrayType(chunks.schema["chunk_id"].dataType)
    schema = types.StructType([types.StructField("term", types.StringType()), types.StructField("ids", of), *(types.StructField(c, types.ArrayType(types.IntegerType())) for c in ("counts", "lengths"))])
    runs = tables.written(tokens.mapInArrow(_runs, schema), "runs")
    opened = lambda r: r.select("term", F.explode(F.arrays_zip("ids", "counts", "lengths")).alias("p"))
    value = lambda c, name: F.col(f"p.{c}").cast("long").alias(name)
    words = runs.where("term IS NOT NULL")
    dealt = words.withColumn("first", F.col("ids")[0]).repartitionByRange("term", "first").sortWithinPartitions("term", "first")
    doc_len = opened(runs.where("term IS NULL")).select(F.col("p.ids").alias("chunk_id"), value("counts", "dl"))
    corpus = doc_len.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    postings = opened(dealt).select("term", F.col("p.ids").alias("chunk_id"), value("counts", "tf"), value("lengths", "dl"))
    return TextIndex(postings, doc_len, words.groupBy("term").agg(F.sum(F.size("ids")).alias("df")), corpus)


def whole(batches: Iterator[pa.RecordBatch], block: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`block` of the rows of at most CHUNKS chunks at a time, each with all its rows, from rows in the order of chunks."""
    left = None
    for b in batches:
        t = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
        first = starts(t.column(0).combine_chunks())
        while len(first) > CHUNKS:  # the last chunk may go on in the next batch
            yield block(t.slice(0, first[CHUNKS]))
            t, first = t.slice(first[CHUNKS]), first[CHUNKS:] - first[CHUNKS]
        left = t
    if left is not None and left.num_rows:
        yield block(left)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk_id, no, value) in the order of chunks, then no -> blocks of at most some CHUNKS whole chunks: ids, row of each posting, its number, its tf, and dl (NaN if unknown)."""
    names = ["ids", "row", "no", "tf", "dl"]

    def block(t: pa.Table) -> pa.RecordBatch:
        ids, no, value = t.column(0).combine_chunks(), t.column(1).to_numpy(), t.column(2).to_numpy()
        first = starts(ids)
        row, length = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(ids)])), no < 0
        dl = np.full(len(first), np.nan)
        dl[row[length]] = value[length]
        cols = [pa.array([ids.take(pa.array(first)).to_pylist()], pa.list_(ids.type))]
        cols += [pa.array([x.tobytes()], pa.binary()) for x in (row[~length].astype(np.int64), no[~length], value[~length].astype(np.float64), dl)]
        return pa.RecordBatch.from_arrays(cols, names)

    yield from whole(batches, block)


def starts(ids: pa.Array) -> np.ndarray:
    """The first row of each id in a sorted column."""
    if isinstance(ids, pa.ChunkedArray):
        ids = pa.concat_arrays(ids.chunks)
    return np.flatnonzero(np.r_[True, pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)]) if len(ids) else np.empty(0, np.int64)


def _array(values: list) -> np.ndarray:
    return np.array(values) if values and not isinstance(values[0], str) else np.array(values, object)


def _cut(query: np.ndarray, chunk: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of every query by (score, chunk)."""
    place = lambda x: np.unique(x, return_inverse=True)[1] if x.dtype == object else x
    q = place(query)
    order = np.lexsort((place(chunk), -score, q))
    q = q[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    order = order[np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < k]
    return query[order], chunk[order], score[order]


class _Scored:
    """The k best chunks of a task for every query, from pairs of a block of chunks and a block of queries."""

    def __init__(self, k: int, k1: float, b: float, schema: types.StructType):
        self.k, self.k1, self.b = k, k1, b
        self.types = [to_arrow_type(f.dataType) for f in schema]

    def pair(self, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, no, tf, dl = (np.frombuffer(p[c], t) for c, t in (("row", np.int64), ("no", np.int64), ("tf", np.float64), ("dl", np.float64)))
        ids, asked = _array(p["ids"]), sorted(p["asked"], key=lambda a: (a["no"], a["query_id"]))
        q_ids, q = np.unique(_array([a["query_id"] for a in asked]), return_inverse=True)
        q_no, idf = np.array([a["no"] for a in asked], np.int64), np.array([a["idf"] for a in asked])
        share = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * np.where(np.isnan(dl), p["avgdl"], dl)[row] / p["avgdl"]))
        score = np.zeros(len(ids) * len(q_ids))
        lo, hi = np.searchsorted(q_no, no, "left"), np.searchsorted(q_no, no, "right")
        ends = np.cumsum(hi - lo)
        at = 0
        while at < len(no):  # a posting meets the queries of its word, some PIECE pairs at a time; each chunk's words stay in order
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
            n = hi[at:upto] - lo[at:upto]
            posting = np.repeat(np.arange(at, upto), n)
            asking = np.arange(len(posting)) - np.repeat(np.cumsum(n) - n, n) + lo[posting]
            score += np.bincount(row[posting] * len(q_ids) + q[asking], idf[asking] * share[posting], len(score))
            at = upto
        score = np.where(score > 0, np.round(score, 6), -1.0).reshape(len(ids), len(q_ids)).T
        low = np.partition(score, len(ids) - self.k, axis=1)[:, [len(ids) - self.k]] if len(ids) > self.k else -1.0
        r, c = np.nonzero((score >= low) & (score >= 0))
        return _cut(q_ids[r], ids[c], score[r, c], self.k)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for i in range(b.num_rows):
                held.append(self.pair(b.slice(i, 1).to_pylist()[0]))
                size += len(held[-1][0])
                if size > HELD:
                    held = [_cut(*(np.concatenate(x) for x in zip(*held, strict=True)), self.k)]
                    size = len(held[0][0])
                    if size > HELD // 2:  # of very many queries a task hands on what it has
                        yield self._rows(held[0])
                        held, size = [], 0
        if held:
            yield self._rows(_cut(*(np.concatenate(x) for x in zip(*held, strict=True)), self.k))

    def _rows(self, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, self.types, strict=True)], ["query_id", "chunk_id", "score"])


def search(index: TextIndex, queries: DataFrame, k: int = 20, k1: float = 1.2, b: float = 0.75, stop: list[str] = (), tokenizer: Tokenizer = regex_tokens) -> DataFrame:
    """(query_id, chunk_id, score, pos): the k best chunks a query by (score, chunk_id).

    Postings of the queries' words and the chunks' lengths are shuffled once, by chunk, as two numbers a row; a chunk then lies in one block with all its
    words, and every block of chunks meets every block of queries, so the pairs of a query and a posting are summed where they arise and a task hands on its
    k best a query. The query blocks are broadcast where Spark's size check allows it, else paired by partitions.
    """
    of, asker = index.postings.schema["chunk_id"].dataType, queries.schema["query_id"].dataType
    tables.small_batches(queries.sparkSession)
    words = queries.select("query_id", F.explode(query_tokens(F.col("query"), stop, tokenizer)).alias("term"))
    words = tables.written(words.join(index.term_stats, "term"), "query-words")
    numbers = tables.written(words.select("term").distinct().withColumn("no", F.monotonically_increasing_id()), "query-numbers")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = words.join(numbers, "term").crossJoin(F.broadcast(index.corpus)).select("query_id", F.struct("query_id", "no", idf.alias("idf")).alias("a"), "avgdl")  # one row
    blocks = F.lit(1 + queries.count() // QUERIES)
    asked = tables.written(weighted.groupBy(F.pmod(F.xxhash64("query_id"), blocks)).agg(F.collect_list("a").alias("asked"), F.first("avgdl").alias("avgdl")).select("asked", "avgdl"), "query-blocks")
    rows = index.postings.join(numbers, "term").select("chunk_id", "no", F.col("tf").cast("long").alias("value")).unionByName(index.doc_len.select("chunk_id", F.lit(-1).cast("long").alias("no"), F.col("dl").cast("long").alias("value")))
    packed = types.StructType([types.StructField("ids", types.ArrayType(of)), *(types.StructField(c, types.BinaryType()) for c in ("row", "no", "tf", "dl"))])
    found = types.StructType([types.StructField("query_id", asker), types.StructField("chunk_id", of), types.StructField("score", types.DoubleType())])
    dealt = rows.repartition("chunk_id").sortWithinPartitions("chunk_id", "no").mapInArrow(_packed, packed)
    best = dealt.crossJoin(asked).mapInArrow(_Scored(k, k1, b, found), found)  # a stated set of queries against all chunks, in blocks
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return best.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def merge_index(postings: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Postings with the chunks of changed documents (doc_id) replaced by `fresh` postings."""
    own = postings.withColumn("doc_id", F.regexp_replace("chunk_id", r"_\d+$", ""))
    return own.join(changed.select("doc_id").distinct(), "doc_id", "left_anti").select("term", "chunk_id", "tf").unionByName(fresh.select("term", "chunk_id", "tf"))
