"""Operator 4, toxicity: maximum-scoring segments over token log-odds.

Training reads the labelled rows outside the held-out fold, at most `TRAIN_DOCS` of them (those with
the smallest hashes; a documented bound on the rows whose counts reach the driver), of which rows that share one of three minimal shingle hashes
count once, so groups of copies don't teach their topic. Tokens are words (A-Z lower-cased) and
the first 5, 6 and 7 bytes of longer words. A token's weight is its log-odds between toxic and other
documents under a Dirichlet prior proportional to its overall frequency, kept where the root of
its likelihood-ratio statistic reaches `Z` (at most `TOKENS` tokens). Scoring is one linear scan a document that finds all maximal
scoring segments; everything else scores `DRIFT`, so segments end. The best segments of
non-toxic training documents follow an extreme-value law with parameters lambda and K; a
document's evidence is the sum statistic of its best segments under that law, and a logistic curve turns it into a probability.
Law and curve are fitted on cross-fitted evidence: a training row is measured by weights that the other `FOLDS` - 1 parts taught.
`passages` returns the segments themselves, those whose own probability under the law is at most `ALPHA`, as byte ranges.

Defined results: null or empty texts get the score of a text without segments; repeated rows are
scored alike; without labels of both kinds every score is the base rate; an empty table gives an
empty result; null doc_ids are not held out; other columns are never read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._shared import materialize, table
from lodestone.llm._text import _BYTES, _POWERS, CHUNK, chunks, mixed, shingle_sets, utf8

TRAIN_DOCS, TOKENS, Z, DRIFT, PRIOR_DOCS, CUT = 30_000, 200_000, 4.5, -0.6, 10.0, 0.3
#: Parts of the cross-fit, and the probability under which a passage is significant.
FOLDS, ALPHA = 3, 0.01
#: Byte lengths of the word beginnings that are tokens besides the word.
PREFIXES = (5, 6, 7)
_APART = np.array([i < 48 or 57 < i < 65 or 90 < i < 97 or 122 < i < 128 for i in range(256)])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of the words of adjoining texts: (words x tokens, 0 where there is none; where each text's
    words begin; byte ranges of the words). Words are runs of ASCII letters and digits and of other characters' bytes."""
    n = len(data)
    up, down = _POWERS.get(max(n, CHUNK))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:n], out=total[1:])
    inside = ~_APART[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    out = np.zeros((len(starts), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = mixed((total[ends] - total[starts]) * down[starts]) | np.uint64(1)
    for k, size in enumerate(PREFIXES, 1):
        long = np.flatnonzero(ends - starts >= size)
        out[long, k] = mixed((total[starts[long] + size] - total[starts[long]]) * down[starts[long]] + np.uint64(size)) | np.uint64(1)
    return out, np.searchsorted(starts, offsets), np.stack([starts, ends], 1)


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the column, tokens of its words, byte ranges of its words)."""
    data, offsets = utf8(column)
    for lo, hi in chunks(offsets):
        own = offsets[lo : hi + 1]
        t, first, where = tokens(data[own[0] : own[-1]], own - own[0])
        for i in range(hi - lo):
            yield lo + i, t[first[i] : first[i + 1]], where[first[i] : first[i + 1]] - (own[i] - own[0])


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time (Ruzzo and Tompa's algorithm)."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    upto = np.r_[0.0, np.cumsum(scores)]
    found: list[tuple] = []  # start, end, total before, total after, the last earlier segment that begins lower
    for i in positive.tolist():  # the others only lower the running total
        start, low, high = i, float(upto[i]), float(upto[i + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append((start, i + 1, low, high, j))
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, hi - lo) for s, e, lo, hi, _ in found]


class Model:
    """Token weights (sorted hashes and their log-odds); lam, k: extreme-value parameters; a, b: logistic curve."""

    def __init__(self, weights: dict[int, float], lam: float = 1.0, k: float = 0.1, a: float = 0.0, b: float = 0.0):
        self.hashes = np.array(sorted(weights), np.uint64)
        self.weights = np.array([weights[h] for h in sorted(weights)], float)
        self.maybe = np.zeros(1 << 20, bool)  # most tokens have no weight
        self.maybe[self.hashes >> np.uint64(44)] = True
        self.lam, self.k, self.a, self.b = lam, k, a, b

    def word_scores(self, t: np.ndarray) -> np.ndarray:
        """The weight of each word's strongest token; words that say nothing score `DRIFT`."""
        out = np.full(len(t), DRIFT)
        r, c = np.nonzero(self.maybe[t >> np.uint64(44)]) if len(self.hashes) else ((), ())
        if len(r):
            h = t[r, c]
            i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            w = np.zeros(t.shape)
            w[r, c] = np.where(self.hashes[i] == h, self.weights[i], 0.0)
            best = np.take_along_axis(w, np.abs(w).argmax(1)[:, None], 1)[:, 0]
            out = np.where(best > 0, best, best + DRIFT)
        return out

    def chance(self, n: int, score: float) -> float:
        """Probability that a text of n words has a segment of that score by chance."""
        return -math.expm1(-self.k * max(n, 1) * math.exp(-max(-50.0, min(700.0, self.lam * score))))

    def passages(self, t: np.ndarray) -> list[tuple[int, int, float]]:
        """All maximal scoring segments: (first word, word after the last, score)."""
        return segments(self.word_scores(t))

    def evidence(self, n: int, scores: list[float]) -> float:
        """How sure it is that the best segments of a text of n words together aren't chance.

        For the r best segments, T = lambda * (their sum) - r ln(K n) + ln r! has the tail
        exp(-T) T^(r-1) / (r! (r-1)!) (Karlin and Altschul's sum statistic); the evidence is the
        largest -ln of that tail over r, or T itself where it is negative.
        """
        size = math.log(self.k * (n or 1))
        best, total = -5.0, 0.0
        for r, s in enumerate(sorted(scores, reverse=True), 1):
            total += self.lam * s - size
            t = total + math.lgamma(r + 1)
            best = max(best, t - (r - 1) * math.log(t) + math.lgamma(r + 1) + math.lgamma(r) - math.log(r) if t > 1 else min(t, 0.0))
        return best

    def score(self, n: int, scores: list[float]) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.a + self.b * self.evidence(n, scores)))))


def log_odds(counts: dict[int, tuple[int, int]], docs: tuple[int, int]) -> dict[int, float]:
    """Token -> log-odds of its share of toxic against other documents, under a Dirichlet prior; those whose
    likelihood ratio against equal shares has a signed root of `Z` or more."""
    every = (docs[0] + docs[1]) or 1
    out = {}
    for t, (yes, no) in counts.items():
        prior = PRIOR_DOCS * (yes + no) / every + 0.01
        toxic = math.log((yes + prior) / (docs[0] + PRIOR_DOCS - yes + 1))
        other = math.log((no + prior) / (docs[1] + PRIOR_DOCS - no + 1))
        cells = ((yes, docs[0]), (no, docs[1]), (docs[0] - yes, docs[0]), (docs[1] - no, docs[1]))
        share = (yes + no) / every
        g = 2 * sum(o * math.log(o / (n * q)) for (o, n), q in zip(cells, (share, share, 1 - share, 1 - share)) if o > 0 and q > 0)
        if g >= Z * Z:
            out[t] = toxic - other
    return dict(sorted(out.items(), key=lambda x: (-abs(x[1]), x[0]))[:TOKENS])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: documents that hold a token, by label and part (so long texts don't dominate); token 0 counts documents."""
    for b in batches:
        kind = 2 * b.column(2).to_numpy() + (b.column(1).to_numpy() > 0)
        held: list[list[np.ndarray]] = [[] for _ in range(2 * FOLDS)]
        for i, t, _ in _texts(b.column(0)):
            held[int(kind[i])].append(np.unique(np.r_[np.uint64(0), t.ravel()]))
        for k, found in enumerate(held):
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(n), k)), pa.array(n)], ["token", "kind", "n"])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        low = np.zeros((3, b.num_rows), np.uint64)
        for i, s in enumerate(shingle_sets(b.column(0))):
            if len(s):
                low[:, i] = [mixed(s * np.uint64(k)).min() for k in (3, 5, 7)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x.view(np.int64)) for x in low)], ["text", "label", "s0", "s1", "s2"])


def _measure(box):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = box.value
        for b in batches:
            part = b.column(2).to_numpy()
            rows = [(len(t), [s for _, _, s in models[part[i]].passages(t)]) for i, t, _ in _texts(b.column(0))]
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int64()), pa.array([n for n, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.list_(pa.float64()))], ["label", "n", "scores"])

    return run


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on rows of `labels` outside the held-out fold; only bounded tables reach the driver."""
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    rows = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(fold != 2).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("label").cast("long"))
    sample = materialize(sample.mapInArrow(_signed, "text string, label long, s0 long, s1 long, s2 long"), "toxic-train")
    kept = sample.select("label", "s0", "s1", "s2", F.xxhash64("text").alias("h"))
    for s in ("s0", "s1", "s2"):
        kept = kept.groupBy(s).agg(F.min(F.struct("h", "label", "s0", "s1", "s2")).alias("x")).select("x.*")
    sample = sample.withColumn("h", F.xxhash64("text")).join(F.broadcast(kept.select("h").distinct()), "h").dropDuplicates(["h"])
    sample = materialize(sample.select("text", "label", F.pmod("h", F.lit(FOLDS)).alias("part")), "toxic-train")
    kinds = range(2 * FOLDS)
    counts = sample.mapInArrow(_count, "token long, kind long, n long").groupBy("token").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in kinds])
    counts = counts.where("token = 0 OR " + " + ".join(f"n{k}" for k in kinds) + " >= 4").toArrow()
    n = np.stack([counts[f"n{k}"].to_numpy() for k in kinds], 1).reshape(-1, FOLDS, 2)  # token x part x label
    token = counts["token"].to_numpy().view(np.uint64)
    docs_by = n[token == 0].sum(0).reshape(FOLDS, 2)
    n, token = n[token != 0], token[token != 0]
    no, yes = (int(x) for x in docs_by.sum(0))
    if not yes or not no:
        rate = (yes + 1) / (yes + no + 2)
        return Model({}, a=math.log(rate / (1 - rate)))

    def taught(left_out: int | None) -> Model:
        parts = [p for p in range(FOLDS) if p != left_out]
        c, d = n[:, parts].sum(1), docs_by[parts].sum(0)
        return Model(log_odds({t: (y, x) for t, x, y in zip(token.tolist(), c[:, 0].tolist(), c[:, 1].tolist(), strict=True) if x + y >= 4}, (int(d[1]), int(d[0]))))

    model = taught(None)
    rows = sample.mapInArrow(_measure(spark.sparkContext.broadcast([taught(p) for p in range(FOLDS)])), "label long, n long, scores array<double>").toArrow()
    label, size, scores = rows["label"].to_numpy(), rows["n"].to_numpy(), rows["scores"].to_pylist()
    clean = label == 0
    model.lam, model.k = extreme_value(np.array([max(s, default=0.0) for s, ok in zip(scores, clean) if ok]), size[clean])
    x = np.array([model.evidence(m, s) for m, s in zip(size.tolist(), scores, strict=True)])
    model.a, model.b = logistic(x, (label > 0).astype(float))
    return model


def extreme_value(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """lambda and K of the best segments of texts of n words that aren't toxic, from quartiles, as
    mislabelled texts would carry moments away; lambda within 0.2 and 3."""
    if not len(best):
        return 1.0, 0.01
    low, high = np.quantile(best, [0.25, 0.75])
    lam = float(min(max(1.5725 / max(high - low, 0.5), 0.2), 3.0))
    return lam, math.exp(float(np.median(lam * best - np.log(np.maximum(n, 1)))) - 0.3665)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """One-variable logistic regression by Newton steps with a small ridge; the slope isn't negative."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    mid, wide = float(x.mean()), float(x.std()) or 1.0
    f = np.stack([np.ones_like(x), (x - mid) / wide])
    w = np.array([math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w @ f, -30, 30)))
        hess = (f * (p * (1 - p))) @ f.T + 1e-2 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, f @ (p - y) + 1e-2 * w), -1, 1)
    slope = max(float(w[1]) / wide, 0.0)
    return float(w[0]) - slope * mid, slope


def _score(box):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = box.value
        for b in batches:
            scores = [model.score(len(t), [s for _, _, s in model.passages(t)]) for _, t, _ in _texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`."""
    box = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(box), "doc_id long, score double")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def _passages(box):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = box.value
        for b in batches:
            ids, out = b.column(0).cast(pa.int64()).to_pylist(), []
            for i, t, where in _texts(b.column(1)):
                found = [(s, e, x, model.chance(len(t), x)) for s, e, x in model.passages(t)]
                out += [(ids[i], int(where[s, 0]), int(where[e - 1, 1]), x, p) for s, e, x, p in found if p <= ALPHA]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))], ["doc_id", "start", "end", "segment_score", "chance"])

    return run


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, start, end (bytes of UTF-8), segment_score and chance of every significant passage of `docs`."""
    box = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_passages(box), "doc_id long, start long, end long, segment_score double, chance double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
