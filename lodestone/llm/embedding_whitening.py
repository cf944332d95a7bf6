"""Operator 11, embedding whitening: a two-pass covariance and its eigenvectors.

Every entry c becomes the integer x = floor(1024 * c) + 100000. The first pass sums x exactly (two halves of 26 bits,
merged as whole numbers), so mean and order of rows don't matter; the second sums centred outer products, one
matrix product an Arrow batch and one matrix a task. Both meet by treeAggregate: the driver gets d sums and one
d x d matrix, whatever the number of vectors. LAPACK's symmetric solver gives the components; they are broadcast, and
every vector is projected where it lies. Nothing of the vectors is shuffled.

Defined results: vectors that are null or hold null, NaN or infinite entries are dropped. A vector shorter than the longest
kept one has 0 in the rest, an empty one everywhere. |1024 * c| beyond 2^52 counts as 2^52. Components whose
variance is 0 to double precision have no whitened value and are left out, so equal vectors, one vector and an
empty table give no rows. Repeated and null ids stand for themselves; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._shared import bounded_batches, materialize, table

SCALE, SHIFT, LIMIT = 1024, 100_000, 1 << 52
COMPONENTS = 8
#: Bits of the lower half of an integer that is summed or squared in halves.
HALF = 26


class Whitening(NamedTuple):
    """n vectors with sums S per dimension; unit `components` (a column each) with falling `variances`; `trace` is the sum of all variances."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float


def finite_rows(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the vectors that aren't null and hold finite entries only, their entries (0 behind a vector's end), and which entries exist."""
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    end = np.cumsum(np.maximum(length, 0))
    bad = np.r_[0, np.cumsum(~np.isfinite(values))]
    ok = (length >= 0) & (bad[end] == bad[end - np.maximum(length, 0)])
    rows = np.flatnonzero(ok)
    there = np.arange(max(length[rows], default=0) if dim is None else dim) < length[rows, None]
    out = np.zeros(there.shape)
    out[there] = values[np.repeat(ok, np.maximum(length, 0))]
    return rows, out, there


def quantised(c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(c * SCALE), -LIMIT, LIMIT).astype(np.int64) + SHIFT


# --- first pass: exact sums -------------------------------------------------------------------------


def _grown(a: np.ndarray, d: int) -> np.ndarray:
    return np.r_[a, np.zeros(d - len(a), a.dtype)] if len(a) < d else a


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: vectors, and for each dimension how many have it and the sums of the halves of their x."""
    n, parts = 0, np.zeros((3, 0), np.int64)
    for b in batches:
        rows, c, there = finite_rows(b.column(0))
        x = np.where(there, quantised(c), 0)
        d = max(parts.shape[1], x.shape[1])
        new = (there.sum(0), (x >> HALF).sum(0), (x & ((1 << HALF) - 1)).sum(0))
        n, parts = n + len(rows), np.stack([_grown(p, d) + _grown(q, d) for p, q in zip(parts, new, strict=True)])
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *[pa.array([p.tolist()], pa.list_(pa.int64())) for p in parts]], ["n", "present", "high", "low"])


def _plus(a: tuple[int, list[int], list[int]], b: tuple[int, list[int], list[int]]) -> tuple[int, list[int], list[int]]:
    long, short = sorted((a, b), key=lambda x: -len(x[1]))
    pad = [0] * (len(long[1]) - len(short[1]))
    return a[0] + b[0], *[[p + q for p, q in zip(x, y + pad, strict=True)] for x, y in zip(long[1:], short[1:], strict=True)]


def exact_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """n and the sums S of x per dimension, as whole numbers of any size."""
    tasks = vectors.select("embedding").mapInArrow(_sums, "n long, present array<long>, high array<long>, low array<long>")
    add = lambda a, r: _plus(a, (r["n"], r["present"], [h * (1 << HALF) + low for h, low in zip(r["high"], r["low"], strict=True)]))
    n, present, sums = tasks.rdd.treeAggregate((0, [], []), add, _plus)
    return n, [s + SHIFT * (n - p) for s, p in zip(sums, present, strict=True)]


# --- second pass: centred outer products ------------------------------------------------------------


class _Products:
    """One row a task: the sum of outer products of `centred(entries)`, as doubles."""

    def __init__(self, centred: Callable[[np.ndarray], np.ndarray], dim: int):
        self.centred, self.dim = centred, dim

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((self.dim, self.dim))
        for b in batches:
            c = self.centred(finite_rows(b.column(0), self.dim)[1])
            total += c.T @ c
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])


def products(vectors: DataFrame, column: str, centred: Callable[[np.ndarray], np.ndarray], dim: int) -> np.ndarray:
    """Sum of centred outer products over all rows, merged in a tree."""
    tasks = vectors.select(column).mapInArrow(_Products(centred, dim), "m binary")
    flat = tasks.rdd.treeAggregate(np.zeros(dim * dim), lambda a, r: a + np.frombuffer(r["m"]), np.add)
    return flat.reshape(dim, dim)


class _Centre:
    """x - S/n: the whole part of the mean is subtracted as an integer, only the rest as a double."""

    def __init__(self, n: int, sums: list[int]):
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n / n for s in sums])

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return (quantised(c) - self.whole) - self.rest


def fit(vectors: DataFrame, k: int | None = None) -> Whitening | None:
    """The whitening of `vectors(embedding)` by its k components of greatest variance (all: None); no vectors: None."""
    bounded_batches(vectors.sparkSession)
    n, sums = exact_sums(vectors)
    if not n or not sums:
        return None
    v = products(vectors, "embedding", _Centre(n, sums), len(sums)) / n
    e, u = np.linalg.eigh((v + v.T) / 2)
    e, u = e[::-1], u[:, ::-1]
    least = max(e[0], 0) * len(e) * np.finfo(float).eps
    k = min(len(e) if k is None else k, int((e > least).sum()))
    return Whitening(n, sums, u[:, :k].copy(), e[:k].copy(), float(e.sum()))


# --- projection -------------------------------------------------------------------------------------


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[Decimal | None]:
    """For every row, the sum over dimensions of (n * x - S)^2, exact; None where it has more than 38 digits."""
    whole, rest = np.array([s // n for s in sums], np.int64), [s % n for s in sums]
    off = x - whole
    if (int(np.abs(off).max(initial=0)) + 1) * n < 1 << 2 * HALF and x.shape[1] <= 1 << 10:  # each half's squares fit in 62 bits
        y = off * n - np.array(rest, np.int64)
        high, low = y >> HALF, y & ((1 << HALF) - 1)
        a, b, c = ((p * q).sum(1).tolist() for p, q in ((high, high), (high, low), (low, low)))
        out = [(p << 2 * HALF) + (q << HALF + 1) + r for p, q, r in zip(a, b, c, strict=True)]
    else:
        out = [sum((o * n - r) ** 2 for o, r in zip(row, rest, strict=True)) for row in off.tolist()]
    return [Decimal(v) if v < 10**38 else None for v in out]


class _Project:
    def __init__(self, box):
        self.box = box

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Whitening = self.box.value
        centre, scaled = _Centre(m.n, m.sums), m.components / np.sqrt(m.variances)
        for b in batches:
            rows, c, _ = finite_rows(b.column(1), len(m.sums))
            w = centre(c) @ scaled
            ends = pa.array(np.arange(len(rows) + 1) * w.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(deviations(quantised(c), m.n, m.sums), pa.decimal128(38, 0)), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], ["vec_id", "deviation", "whitened"])


def transform(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation decimal(38,0), whitened array<double> of every vector of finite entries in `vectors(vec_id, embedding)`."""
    bounded_batches(vectors.sparkSession)
    box = vectors.sparkSession.sparkContext.broadcast(model)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(_Project(box), f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


class _Minus:
    def __init__(self, mean: np.ndarray):
        self.mean = mean

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return c - self.mean


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of `whitened` minus the identity, again in two passes."""
    mean = np.array(whitened.agg(F.array(*[F.avg(F.col("whitened")[i]) for i in range(k)])).first()[0])
    return float(np.abs(products(whitened, "whitened", _Minus(mean), k) / n - np.eye(k)).max())


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, float | None]:
    """`transform` of the vectors by their own whitening, written once; the model; the measured identity error."""
    model = fit(vectors, k)
    if model is None or not len(model.variances):
        empty = vectors.sparkSession.createDataFrame([], "deviation decimal(38,0), whitened array<double>")
        return vectors.select("vec_id").limit(0).join(empty, F.lit(False)), None, None
    out = materialize(transform(vectors, model), "whitened")
    return out, model, identity_error(out, model.n, len(model.variances))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a remaining vector and component up to 8; a deviation beyond 64 bits is null (the operator has 38 digits)."""
    out, model, error = whiten(table(spark, sf_dir, "embeddings"))
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.variances]) if model else F.array().cast("array<double>")
    rows = out.select("vec_id", "deviation", F.posexplode("whitened").alias("p", "whitened"))
    return rows.select(
        "vec_id", (F.col("p") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened", F.get(explained, F.col("p")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


QUERIES = {"op11_embedding_whitening": op11_embedding_whitening}
ORACLES: dict[str, str] = {}
