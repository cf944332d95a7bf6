"""Inverted file of vectors with product quantisation: build, probe, re-rank exactly, and audit the recall.

Build: vectors are scaled to unit length; centroids and the codebooks of the residuals are fitted by k-means on a sample of at most SAMPLE
vectors (its rounds are Spark jobs that merge sums in a tree, so the driver sees lists x dim numbers whatever the sample). Every vector of the table
is then assigned to its list and coded. Codes and vectors are written as two tables partitioned by list, so a search reads the
probed lists only: codes to choose candidates, vectors of the candidates' lists to score them exactly.

A search deals blocks and query blocks by list (rows are blocks of bounded size, so a list of very many vectors is many rows). While all queries
together have fewer candidates than the index has vectors, it reads codes, keeps the best candidates of each task, and re-ranks them with exact cosines.
With more candidates than that, moving each with its vector would cost more than the lists themselves: then the vectors of the probed lists meet the
query blocks, all of them are scored where they meet, and only the k best of a task move on. Scores are those of `vectors.top_k`, only hits may be
missing, and those that the codes find are always found without them. `audit`
measures how many, against the exact search, and doubles lists and candidates until the wanted recall is met; with every
list probed and every vector a candidate the search is exact, so the audit ends.

Vectors of another length than the index's, and zero ones, lie in list -1, which every query probes with all its vectors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import vectors
from lodestone.operators.vectors import ROWS, cut
from lodestone.sources import tables

#: Vectors that fit the index, rounds of k-means, codes a sub-vector.
SAMPLE, ROUNDS, CODES = 65_536, 12, 256


class Trained(NamedTuple):
    """centroids (lists x dim), books (sub-vectors x CODES x dim / sub-vectors)."""

    centroids: np.ndarray
    books: np.ndarray


class Index(NamedTuple):
    codes: DataFrame  # list, ids, codes: blocks of at most ROWS vectors of one list
    vectors: DataFrame  # list, chunk_id, embedding
    trained: Trained
    config: dict


def _entries(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length dim with finite entries and a norm above 0: their indices and unit vectors."""
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(length == dim)
    x = values[(np.cumsum(np.maximum(length, 0)) - dim)[rows][:, None] + np.arange(dim)]
    norm = np.sqrt((x * x).sum(1))
    ok = np.isfinite(norm) & (norm > 0)
    return rows[ok], x[ok] / norm[ok, None]


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Index of each row's nearest centroid, in products of at most ROWS rows; the first of equal ones."""
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + ROWS] @ c.T - half, 1) for i in range(0, len(x), ROWS)] or [np.empty(0, np.int64)])


# --- fitting ----------------------------------------------------------------------------------------


def _partial(sums) -> Iterator[pa.RecordBatch]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            new = sums(b)
            total = new if total is None else total + new
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    return run


def _merged(rows: DataFrame, sums, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of `sums(batch)`, one array a task, merged in a tree."""
    flat = rows.mapInArrow(_partial(sums), "m binary").rdd.treeAggregate(np.zeros(int(np.prod(shape))), lambda a, r: a + np.frombuffer(r["m"]), np.add)
    return flat.reshape(shape)


def _counted(assigned: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Per centroid: the number of its rows, then their sum."""
    out = np.zeros((n, x.shape[1] + 1))
    np.add.at(out[:, 0], assigned, 1)
    np.add.at(out[:, 1:], assigned, x)
    return out


def _moved(c: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """New centroids; one without rows takes its place beside the one with most."""
    n, new = sums[:, 0], c.copy()
    full = n > 0
    new[full] = sums[full, 1:] / n[full, None]
    order = np.argsort(-n, kind="stable")
    for k, i in enumerate(np.flatnonzero(~full)):
        big = order[k % max(int(full.sum()), 1)]
        new[i] = new[big] * (1 + 1e-3 * (-1) ** np.arange(c.shape[1]))
    return new


def fit(sample: DataFrame, n: int, dim: int, lists: int, sub_vectors: int) -> Trained:
    """Centroids and codebooks by k-means over `sample(embedding)`, of about n rows; starting points are its first rows by hash."""
    start = sample.orderBy(F.xxhash64("embedding"), "embedding").limit(max(lists, CODES)).toArrow().column(0).combine_chunks()  # bounded
    _, x = _entries(start if isinstance(start, pa.Array) else start.chunk(0), dim)
    if not len(x):
        return Trained(np.zeros((1, dim)), np.zeros((sub_vectors, 1, dim // sub_vectors)))
    c = x[:lists].copy()
    for _ in range(ROUNDS):
        def sums(b: pa.RecordBatch, c=c) -> np.ndarray:
            rows = _entries(b.column(0), dim)[1]
            return _counted(nearest(rows, c), rows, len(c))

        c = _moved(c, _merged(sample, sums, (len(c), dim + 1)))
    step = dim // sub_vectors
    r = (x - c[nearest(x, c)])[:CODES]
    books = np.stack([r[:, i * step : (i + 1) * step] for i in range(sub_vectors)])
    for _ in range(ROUNDS):
        def sums(b: pa.RecordBatch, books=books) -> np.ndarray:
            rows = _entries(b.column(0), dim)[1]
            rest = rows - c[nearest(rows, c)]
            return np.stack([_counted(nearest(p, book), p, len(book)) for p, book in zip(np.split(rest, len(books), 1), books, strict=True)])

        got = _merged(sample, sums, (sub_vectors, books.shape[1], step + 1))
        books = np.stack([_moved(b, s) for b, s in zip(books, got, strict=True)])
    return Trained(c, books)


# --- building ---------------------------------------------------------------------------------------


def _assign(box) -> Iterator[pa.RecordBatch]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = box.value.centroids
        for b in batches:
            at = np.full(b.num_rows, -1)
            rows, x = _entries(b.column(1), c.shape[1])
            at[rows] = nearest(x, c)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column(0), b.column(1)], ["list", "chunk_id", "embedding"])

    return run


def _code(box) -> Iterator[pa.RecordBatch]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, books = box.value
        for b in batches:
            at, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            rows, x = _entries(b.column(2), c.shape[1])
            codes = np.stack([nearest(p, book) for p, book in zip(np.split(x - c[at[rows]], len(books), 1), books, strict=True)], 1).astype(np.uint8)
            out = []
            for n in np.unique(at[rows]).tolist():
                own = np.flatnonzero(at[rows] == n)
                out += [(n, ids[rows[own[i : i + ROWS]]].tolist(), codes[own[i : i + ROWS]].tobytes()) for i in range(0, len(own), ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.list_(pa.int64()), pa.binary()))], ["list", "ids", "codes"])

    return run


def build(rows: DataFrame, path: str, lists: int | None = None, sub_vectors: int | None = None) -> Index:
    """Fit, assign and code `rows(chunk_id, embedding)`, write both tables and the configuration under `path`."""
    spark = rows.sparkSession
    kept = rows.select(F.col("chunk_id").cast("long"), F.col("embedding").cast("array<double>")).where("chunk_id IS NOT NULL AND embedding IS NOT NULL")
    size = kept.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    n, dim = size["n"], max(size["dim"] or 1, 1)
    lists = lists or max(min(n // 20, 256), 1)
    sub_vectors = max(s for s in range(1, min(sub_vectors or max(dim // 8, 1), dim) + 1) if dim % s == 0)
    bar = int(min(1.0, SAMPLE / max(n, 1)) * (1 << 32))
    sample = tables.written(kept.select("embedding").where(F.pmod(F.xxhash64("embedding", F.lit(7)), F.lit(1 << 32)) < bar), "ivf-sample")
    trained = fit(sample, n, dim, lists, sub_vectors)
    box = spark.sparkContext.broadcast(trained)
    placed = kept.mapInArrow(_assign(box), "list int, chunk_id long, embedding array<double>")
    placed.repartition("list", F.pmod(F.xxhash64("chunk_id"), F.lit(1 + n // 1_000_000))).sortWithinPartitions("list", "chunk_id").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
    written = spark.read.schema("list int, chunk_id long, embedding array<double>").parquet(f"{path}/vectors").select("list", "chunk_id", "embedding")
    written.where("list >= 0").mapInArrow(_code(box), "list int, ids array<long>, codes binary").write.mode("overwrite").partitionBy("list").parquet(f"{path}/codes")
    config = {"rows": n, "dim": dim, "lists": len(trained.centroids), "sub_vectors": sub_vectors, "probes": min(8, len(trained.centroids)), "candidates": 10}
    _write_config(spark, path, config, trained)
    return read(spark, path)


def _write_config(spark: SparkSession, path: str, config: dict, trained: Trained) -> None:
    row = (json.dumps(config), trained.centroids.tobytes(), trained.books.tobytes())
    spark.createDataFrame([row], "config string, centroids binary, books binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/trained")


def read(spark: SparkSession, path: str) -> Index:
    r = spark.read.parquet(f"{path}/trained").first()
    config = json.loads(r["config"])
    trained = Trained(np.frombuffer(r["centroids"]).reshape(-1, config["dim"]), np.frombuffer(r["books"]).reshape(config["sub_vectors"], -1, config["dim"] // config["sub_vectors"]))
    codes = spark.read.schema("ids array<long>, codes binary, list int").parquet(f"{path}/codes") if tables.exists(spark, f"{path}/codes/_SUCCESS") else None
    return Index(codes, spark.read.schema("chunk_id long, embedding array<double>, list int").parquet(f"{path}/vectors"), trained, config)


# --- searching --------------------------------------------------------------------------------------


def _probes(box, probes: int) -> Iterator[pa.RecordBatch]:
    """Blocks of unit query vectors for each list they probe, handed on by BATCH_BYTES: a query is repeated for all its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = box.value.centroids
        for b in batches:
            ids = b.column(0).to_numpy()
            rows, x = _entries(b.column(1), c.shape[1])
            at = np.argsort(-(x @ c.T), 1, kind="stable")[:, :probes]
            out, size = [], 0
            for n in np.unique(at).tolist():
                own = np.flatnonzero((at == n).any(1))
                for i in range(0, len(own), ROWS):
                    out.append((n, ids[rows[own[i : i + ROWS]]].tolist(), x[own[i : i + ROWS]].tobytes()))
                    size += len(out[-1][2])
                    if size > vectors.BATCH_BYTES:
                        yield _blocks(out, ["list", "q_ids", "q"])
                        out, size = [], 0
            yield _blocks(out, ["list", "q_ids", "q"])

    return run


def _blocks(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.list_(pa.int64()), pa.binary()))], names)


def _listed(dim: int) -> Iterator[pa.RecordBatch]:
    """Rows (list, chunk_id, embedding) packed into blocks of at most ROWS unit vectors of one list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, ids, out = b.column(0).to_numpy(), b.column(1).to_numpy(), []
            rows, x = _entries(b.column(2), dim)
            for n in np.unique(at[rows]).tolist():
                own = np.flatnonzero(at[rows] == n)
                out += [(n, ids[rows[own[i : i + ROWS]]].tolist(), x[own[i : i + ROWS]].tobytes()) for i in range(0, len(own), ROWS)]
            yield _blocks(out, ["list", "ids", "entries"])

    return run


def _estimate(box, k: int) -> Iterator[pa.RecordBatch]:
    """The k best candidates of a task for every query, by the dot product with the coded vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, books = box.value
        held, size = [], 0
        for b in batches:
            for n, ids, codes, q_ids, q in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                q = np.frombuffer(q).reshape(len(q_ids), -1)
                codes = np.frombuffer(codes, np.uint8).reshape(len(ids), -1)
                s = np.repeat((q @ c[n])[:, None], len(ids), 1)
                for m, part in enumerate(np.split(q, len(books), 1)):
                    s += (part @ books[m].T)[:, codes[:, m]]
                r, v = np.nonzero(s >= np.partition(s, len(ids) - k, 1)[:, [len(ids) - k]]) if len(ids) > k else np.nonzero(np.ones_like(s, bool))
                held.append(cut(np.array(q_ids)[r], np.array(ids)[v], s[r, v], k))
                size += len(held[-1][0])
                if size > vectors.HELD:
                    yield _rows(cut(*(np.concatenate(x) for x in zip(*held, strict=True)), k))
                    held, size = [], 0
        if held:
            yield _rows(cut(*(np.concatenate(x) for x in zip(*held, strict=True)), k))

    return run


def _rows(found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "chunk_id", "estimate"])


def _by_codes(index: Index, box, near: DataFrame, blocks: DataFrame, probed: Column, k: int, candidates: int) -> DataFrame:
    """The `candidates` times k best of every query by their codes, scored exactly."""
    pairs = index.codes.where(probed).select("list", "ids", "codes").join(blocks, "list")
    rough = pairs.select("list", "ids", "codes", "q_ids", "q").mapInArrow(_estimate(box, candidates * k), "query_id long, chunk_id long, estimate double")
    best = Window.partitionBy("query_id").orderBy(F.desc("estimate"), "chunk_id")
    chosen = rough.withColumn("pos", F.row_number().over(best)).where(F.col("pos") <= candidates * k).select("query_id", "chunk_id")
    exact = chosen.join(index.vectors.where(probed), "chunk_id").join(near, "query_id")
    return exact.select("query_id", "chunk_id", F.round(vectors.cosine(F.col("embedding"), F.col("query_vec")), 6).alias("score"), F.lit(0).alias("pos"))


def _by_vectors(index: Index, blocks: DataFrame, probed: Column, k: int) -> DataFrame:
    """The k best of each task for every query, from all vectors of the probed lists."""
    dim = F.lit(index.config["dim"])
    listed = index.vectors.where(probed).select("list", "chunk_id", "embedding").mapInArrow(_listed(index.config["dim"]), "list int, ids array<long>, entries binary")
    pairs = listed.join(blocks, "list").select("ids", dim.alias("dim"), "entries", "q_ids", dim.alias("q_dim"), "q")
    return pairs.mapInArrow(vectors._Best(k), "query_id long, chunk_id long, score double").withColumn("pos", F.lit(0))


def search(index: Index, queries: DataFrame, k: int = 20, probes: int | None = None, candidates: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, pos) of `queries(query_id, query_vec)`, as `vectors.top_k` gives them but for missed hits.

    `probes` lists a query are read and at least `candidates` times k of their vectors are scored exactly (default: what the last audit
    set). Queries of another length or without a direction meet every vector.
    """
    spark = index.vectors.sparkSession
    box = spark.sparkContext.broadcast(index.trained)
    probes, candidates = probes or index.config["probes"], candidates or index.config["candidates"]
    asked = queries.select(F.col("query_id").cast("long"), F.col("query_vec").cast("array<double>").alias("query_vec")).where("query_id IS NOT NULL AND query_vec IS NOT NULL")
    usable = (F.size("query_vec") == index.config["dim"]) & F.exists("query_vec", lambda x: x != 0) & F.forall("query_vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(usable, F.lit(False))
    near, odd = asked.where(usable), asked.where(~usable)
    out = [vectors.top_k(index.vectors.where("list = -1"), near, k)]
    if odd.take(1):
        out.append(vectors.top_k(index.vectors, odd, k))
    if index.codes is not None:
        asked_n = near.count()
        blocks = near.repartition(1 + asked_n // vectors.QUERY_BLOCK).mapInArrow(_probes(box, probes), "list int, q_ids array<long>, q binary")
        probed = F.col("list") >= 0
        if probes < index.config["lists"]:
            blocks = tables.written(blocks, "probes")
            probed = F.col("list").isin([r[0] for r in blocks.select("list").distinct().collect()])  # at most as many as the index has
        blocks = blocks.hint("merge")  # a query is repeated for every list it probes, which Spark's estimate of the blocks doesn't hold: never broadcast
        few = asked_n * candidates * k <= index.config["rows"]
        out.append(_by_codes(index, box, near, blocks, probed, k, candidates) if few else _by_vectors(index, blocks, probed, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def recall(got: DataFrame, exact: DataFrame) -> float:
    """Share of the exact hits' scores that the search reaches: a hit counts if its position's score isn't below the exact one (equal scores are interchangeable)."""
    both = exact.select("query_id", "pos", F.col("score").alias("want")).join(got.select("query_id", "pos", "score"), ["query_id", "pos"], "left")
    at = both.agg(F.count("*").alias("n"), F.count_if(F.col("score") >= F.col("want")).alias("hit")).first()
    return at["hit"] / at["n"] if at["n"] else 1.0


def shared(got: DataFrame, exact: DataFrame) -> float:
    """Share of the exact hits (query_id, chunk_id) that the search finds."""
    n = exact.count()
    return exact.join(got, ["query_id", "chunk_id"], "left_semi").count() / n if n else 1.0


def audit(index: Index, queries: DataFrame, path: str, k: int = 20, least: float = 0.95) -> dict:
    """Measure the search on `queries`, a small set, and double probes and candidates until `least` of the exact hits are found.

    The setting that meets it is stored as the index's default; returns it with the recall and the share of vectors in probed lists.
    """
    exact = tables.written(vectors.top_k(index.vectors, queries, k), "exact")
    probes, candidates = index.config["probes"], index.config["candidates"]
    while True:
        got = shared(search(index, queries, k, probes, candidates), exact)
        if got >= least or probes >= index.config["lists"] and candidates * k >= index.config["rows"]:
            break
        probes, candidates = min(2 * probes, index.config["lists"]), 2 * candidates
    config = index.config | {"probes": probes, "candidates": candidates, "recall": got}
    _write_config(index.vectors.sparkSession, path, config, index.trained)
    return config
