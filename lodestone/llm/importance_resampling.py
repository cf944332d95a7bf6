"""Operator 12, target-distribution importance resampling over hashed n-grams.

Features of a text are its runs of 1 to 2 words, counted in 10,000 hash buckets. A document's weight is the mean log ratio of its
buckets' shares in the target texts and in the corpus; adding Gumbel noise of its own and taking the greatest sums draws
without replacement in proportion to the weights.

Identical texts are grouped by their full text first (counted before the shuffle, so a text that a third of all rows
share is one row a task), their features are taken once and kept as buckets, and every bucket count is multiplied by the number of
copies. Weights go back to documents by the text's SHA-256, a join whose skewed partitions adaptive execution splits; noise
comes after it. Ranks need no sort of the corpus: scores are whole numbers in a fixed range (gains lie
within 1000 * ln(2^77), noise within 1000 * ln(2^33)), so a histogram of at most some 140,000 scores gives the number of documents above each
score, and only documents of the same score are ordered, by doc_id. The driver gets that histogram and 10,000 bucket
counts.

Defined results: null and empty texts have no features and weight 0; documents of fewer than MIN_WORDS words, and all
documents of an empty table, are never drawn; a null doc_id hashes as an empty string and comes last among ties; rows
of one doc_id with one text share noise and weight and take neighbouring ranks; an empty target has T = 0. Words of any length count whole. Other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm._shared import bounded_batches, discard, materialize, table, text_or_empty
from lodestone.llm._text import chunks, release, utf8

BUCKETS, SEED, MIN_WORDS, PERCENT = 10_000, "7", 20, 25

_BYTE = np.arange(256)
_WORD = (_BYTE >= 0x80) | ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE | 0x20 >= 0x61) & (_BYTE | 0x20 <= 0x7A) & (_BYTE >= 0x41))
_LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 0x20, _BYTE).astype(np.uint8)
_ALL = np.uint32(0xFFFFFFFF)
#: Words beyond this many bytes go through zlib one by one.
LONG = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def _step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _CRC[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


class _Words:
    """The words of adjoining lower-cased texts, longest first where their bytes are run through a CRC-32."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts = data, starts
        size = ends - starts
        self.long = [(int(i), data[starts[i] : ends[i]].tobytes()) for i in np.flatnonzero(size > LONG)]
        size = np.where(size > LONG, 0, size).astype(np.int16)
        self.order = np.argsort(-size, kind="stable")
        self.at_least = np.cumsum(np.bincount(size, minlength=LONG + 1)[::-1])[::-1]

    def crc(self, state: np.ndarray) -> np.ndarray:
        """Every word's bytes after `state` (a state a word)."""
        s, first = state[self.order], self.starts[self.order]
        for p in range(LONG):
            k = self.at_least[p + 1]
            if not k:
                break
            s[:k] = _step(s[:k], self.data[first[:k] + p])
        out = np.empty_like(s)
        out[self.order] = s
        for i, word in self.long:
            out[i] = np.uint32(zlib.crc32(word, int(state[i] ^ _ALL))) ^ _ALL
        return out


def text_buckets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts: the number of words of each, and the buckets of all their features, text by text."""
    data, offsets = utf8(column)
    for lo, hi in chunks(offsets):
        own = offsets[lo : hi + 1] - offsets[lo]
        part = _LOWER[data[offsets[lo] : offsets[hi]]]
        n = len(part)
        inside, edge = _WORD[part], np.zeros(n + 1, bool)
        edge[own] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        starts, ends = np.flatnonzero(inside & (~before | edge[:n])), np.flatnonzero(inside & (~after | edge[1:])) + 1
        first = np.searchsorted(starts, own)
        words = _Words(part, starts, ends)
        one = words.crc(np.full(len(starts), _ALL))
        left = np.r_[_ALL, one[:-1]] if len(one) else one
        two = words.crc(_step(left, np.full(len(one), 0x20, np.uint8)))
        pairs = np.stack([two, one], 1) ^ _ALL
        there = np.ones(pairs.shape, bool)
        count = np.diff(first)
        there[first[:-1][count > 0], 0] = False  # a text's first word ends no pair
        yield count, (pairs[there] % np.uint32(BUCKETS)).astype(np.uint16)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = list(text_buckets(b.column(2)))
        count = np.concatenate([c for c, _ in parts]) if parts else np.empty(0, np.int64)
        data = np.concatenate([x for _, x in parts]) if parts else np.empty(0, np.uint16)
        ends = np.r_[0, np.cumsum(np.maximum(2 * count - 1, 0))] * 2
        buckets = pa.Array.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(count, pa.int64()), buckets], ["digest", "copies", "n_words", "buckets"])
    release()


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text_or_empty(text), 256))


def distinct_features(docs: DataFrame) -> DataFrame:
    """One row a different text of `docs(text)`, written: digest, copies, n_words, buckets (two bytes a feature)."""
    texts = docs.select(text_or_empty(F.col("text")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    rows = texts.select(digest(F.col("text")).alias("digest"), "copies", "text")
    return materialize(rows.mapInArrow(_measure, "digest binary, copies long, n_words long, buckets binary"), "features")


def _buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] // 2
    all_ = np.frombuffer(data, np.uint16, count=int(ends[-1])) if data is not None and ends[-1] else np.empty(0, np.uint16)
    return all_[ends[0] :], ends - ends[0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        data, ends = _buckets(b.column(1))
        copies = np.repeat(b.column(0).to_numpy(), np.diff(ends))
        for c in np.unique(copies).tolist():
            total += c * np.bincount(data[copies == c] if (copies != c).any() else data, minlength=BUCKETS)
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], ["bucket", "n"])


def bucket_counts(features: DataFrame) -> np.ndarray:
    """Occurrences in every bucket over all rows of `distinct_features`, copies counted."""
    rows = features.select("copies", "buckets").mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of a bucket's smoothed share in the target and in the corpus, rounded down."""
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


class _Weigh:
    def __init__(self, box):
        self.box = box

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = self.box.value
        for b in batches:
            data, ends = _buckets(b.column(2))
            total, n = np.diff(np.r_[0, np.cumsum(gain[data])][ends]), np.diff(ends)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0), pa.int64())], ["digest", "n_words", "n_features", "weight"])


def noise(doc_id: Column) -> Column:
    """The document's own Gumbel noise, in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, digest, n_words, n_features, weight, score for every row of `docs(doc_id, text)` against `target(text)`; written."""
    spark = docs.sparkSession
    bounded_batches(spark)
    corpus, wanted = distinct_features(docs), distinct_features(target)
    box = spark.sparkContext.broadcast(gains(bucket_counts(corpus), bucket_counts(wanted)))
    weights = corpus.select("digest", "n_words", "buckets").mapInArrow(_Weigh(box), "digest binary, n_words long, n_features long, weight long")
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest")).join(weights, "digest")
    out = materialize(rows.select("doc_id", "digest", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"))).alias("score")), "importance")
    discard(corpus, wanted)
    return out


def ranked(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """`scored` with rank: 1, 2, ... by falling score, then doc_id, for the drawn rows; null for all others."""
    may = F.col("n_words") >= min_words
    hist = scored.where(may).groupBy("score").agg(F.count("*").alias("n")).toPandas().sort_values("score", ascending=False)
    hist["above"] = hist["n"].cumsum() - hist["n"]
    quota = int(hist["n"].sum()) * percent // 100
    drawn = hist[hist["above"] < quota]
    if drawn.empty:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    least = int(drawn["score"].min())
    high = may & (F.col("score") >= least)
    above = scored.sparkSession.createDataFrame(pd.DataFrame({"score": drawn["score"].astype("int64"), "above": drawn["above"].astype("int64")}))
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())
    rank = F.col("above") + F.row_number().over(order)
    top = scored.where(high).join(F.broadcast(above), "score").withColumn("rank", F.when(rank <= quota, rank)).drop("above")
    return top.unionByName(scored.where(~high).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """The drawn rows of `docs`, with its columns; rows that repeat a drawn doc_id and text are kept with it."""
    drawn = ranked(score(docs, target), percent, min_words).where("rank IS NOT NULL").select(F.col("doc_id").alias("r_id"), F.col("digest").alias("r_text")).distinct()
    return docs.join(drawn, F.col("doc_id").eqNullSafe(F.col("r_id")) & (digest(F.col("text")) == F.col("r_text")), "left_semi")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranked(scored).select("doc_id", "n_features", "weight", "score", "rank")


def oracle(docs: str = "documents", target: str = "benchmark") -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    both = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH tab AS MATERIALIZED (SELECT i AS k, list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) AS v FROM range(256) r(i)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, w, greatest(2 * len(w) - 1, 0)::BIGINT AS n_features FROM (SELECT doc_id, {words} AS w FROM {docs})),
df AS MATERIALIZED (SELECT r, f, count(*) AS n FROM (SELECT r, unnest({both}) AS f FROM d) GROUP BY ALL),
tf AS MATERIALIZED (SELECT f, count(*) AS n FROM (SELECT unnest({both}) AS f FROM (SELECT {words} AS w FROM {target})) GROUP BY ALL),
u AS MATERIALIZED (SELECT f, hex(f) AS x, strlen(f) AS m FROM (SELECT f FROM df UNION SELECT f FROM tf)),
crc AS (WITH RECURSIVE c AS (SELECT f, x, m, 0::BIGINT AS p, 4294967295::BIGINT AS s FROM u UNION ALL
  SELECT f, x, m, p + 1, xor(s >> 8, v) FROM c JOIN tab ON k = (xor(s, ('0x' || substr(x, 2 * p + 1, 2))::BIGINT) & 255) WHERE p < m)
  SELECT f, xor(s, 4294967295) % {BUCKETS} AS b FROM c WHERE p = m),
s AS (SELECT b, sum(n) AS n FROM df JOIN crc USING (f) GROUP BY b), t AS (SELECT b, sum(n) AS n FROM tf JOIN crc USING (f) GROUP BY b),
g AS (SELECT a.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM s), 0) + {BUCKETS})::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM (SELECT DISTINCT b FROM crc) a LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
w AS (SELECT r, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM df JOIN crc USING (f) JOIN g USING (b) GROUP BY r),
sc AS (SELECT doc_id, len(d.w) AS n_words, n_features, coalesce(weight, 0) AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM d LEFT JOIN w USING (r)),
rk AS (SELECT *, CASE WHEN n_words >= {MIN_WORDS} THEN row_number() OVER (PARTITION BY n_words >= {MIN_WORDS} ORDER BY score DESC, doc_id NULLS LAST) END AS k FROM sc)
SELECT doc_id, n_features, weight, score, (CASE WHEN k <= (SELECT count(*) FROM sc WHERE n_words >= {MIN_WORDS}) * {PERCENT} // 100 THEN k END)::BIGINT AS rank FROM rk"""


QUERIES = {"op12_importance_resampling": op12_importance_resampling}
ORACLES = {"op12_importance_resampling": oracle()}
