"""Exact cosine retrieval over blocks of vectors, and the choice of an index by size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors a block, queries a partition of blocks, rows that a task holds before it hands them on, bytes of an Arrow batch.
ROWS, QUERY_BLOCK, HELD, BATCH_BYTES = 1024, 10_000, 4_000_000, 8 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the components both have; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    den = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(den > 0, dot(x, y) / den).otherwise(0.0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector) packed into blocks of at most ROWS vectors of one length: ids, dim, entries (doubles, null and non-finite ones as 0)."""
    for b in batches:
        length = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
        ends = np.r_[0, np.cumsum(length)]
        values = b.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        values = np.where(np.isfinite(values), values, 0.0)
        ids, out = b.column(0).to_numpy(zero_copy_only=False), []
        for dim in np.unique(length).tolist():
            own = np.flatnonzero(length == dim)
            for at in range(0, len(own), ROWS):
                rows = own[at : at + ROWS]
                out.append((ids[rows].tolist(), dim, values[ends[rows][:, None] + np.arange(dim)].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.list_(pa.int64()), pa.int32(), pa.binary()))], ["ids", "dim", "entries"])


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return m, np.sqrt((m * m).sum(1))


def cut(query: np.ndarray, chunk: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of every query by (score, chunk)."""
    order = np.lexsort((chunk, -score, query))
    query, chunk, score = query[order], chunk[order], score[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, np.int64)
    keep = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)])) < k
    return query[keep], chunk[keep], score[keep]


class _Best:
    """The k best vectors of a task for every query, from pairs of blocks; a pair's cosines use the components both lengths have."""

    def __init__(self, k: int):
        self.k = k

    def pair(self, v_ids: np.ndarray, v: np.ndarray, q_ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = min(v.shape[1], q.shape[1])
        (v, v_norm), (q, q_norm) = _unit(v[:, :n]), _unit(q[:, :n])
        norm = q_norm[:, None] * v_norm[None, :]
        s = np.round(np.divide(q @ v.T, norm, out=np.zeros_like(norm), where=norm > 0), 6)
        r, c = np.nonzero(s >= np.partition(s, len(v) - self.k, axis=1)[:, [len(v) - self.k]]) if len(v) > self.k else np.nonzero(np.ones_like(s, bool))
        return cut(q_ids[r], v_ids[c], s[r, c], self.k)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for v_ids, v_dim, v, q_ids, q_dim, q in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
                found = self.pair(np.array(v_ids), np.frombuffer(v).reshape(len(v_ids), v_dim), np.array(q_ids), np.frombuffer(q).reshape(len(q_ids), q_dim))
                held.append(found)
                size += len(found[0])
                if size > HELD:
                    held = [cut(*(np.concatenate(x) for x in zip(*held, strict=True)), self.k)]
                    size = len(held[0][0])
                    if size > HELD // 2:  # of very many queries a task hands on what it has
                        yield self._rows(held[0])
                        held, size = [], 0
        if held:
            yield self._rows(cut(*(np.concatenate(x) for x in zip(*held, strict=True)), self.k))

    @staticmethod
    def _rows(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "chunk_id", "score"])


def in_blocks(rows: DataFrame, key: str, vector: str, parts: int | None = None) -> DataFrame:
    """ids, dim, entries: blocks of `rows` whose id and vector aren't null."""
    kept = rows.select(F.col(key).cast("long"), vector).where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    kept = kept if parts is None else kept.repartition(parts)
    return kept.mapInArrow(_blocks, "ids array<long>, dim int, entries binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, chunk_id, score, pos) of `vectors(chunk_id, embedding)` for `queries(query_id, query_vec)`; rows without a vector are left out.

    Score: `cosine` over the components that the query and the vector have, rounded to 6 digits, so it depends on those two alone.
    Both sides are packed into blocks of at most ROWS vectors of one length, and every query block meets every vector block:
    a product of bounded size. The query blocks are broadcast where Spark's size check allows it, else paired by partitions. A task keeps its k best a query over all its pairs.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    asked = in_blocks(queries, "query_id", "query_vec", 1 + queries.count() // QUERY_BLOCK).toDF("q_ids", "q_dim", "q_entries")
    pairs = in_blocks(vectors, "chunk_id", "embedding").crossJoin(asked)  # a stated query set against all rows, in blocks
    found = pairs.mapInArrow(_Best(k), "query_id long, chunk_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def index_policy(n: int, dim: int) -> dict:
    """Index kind and parameters by corpus size: none, graph, or inverted file."""
    if n < 10_000:
        return {"kind": "none"}
    if n < 100_000:
        return {"kind": "graph"}
    return {"kind": "inverted-file", "partitions": min(max(n // 20, 4), 256), "sub_vectors": min(dim // 8, 64)}
