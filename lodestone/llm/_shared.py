"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in every contract of this subpackage.
WS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"


#: Bytes of rows that go to a Python worker at a time; texts differ too much in length to be counted in rows.
ARROW_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so a worker's memory doesn't depend on the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a session in one process (local master, as in tests) gets one of its own where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write `df` to the shared folder and read it back. Row groups are small, as a task's writer holds one."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what `materialize` wrote, once everything that reads it is itself written."""
    for t in tables:
        path = getattr(t, "_table_path", None)
        if path:
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def bitmap_of(values: DataFrame, spark: SparkSession, size: int):
    """Broadcast bitmap of the low `size` bits of `values(v)`: of fixed size, whatever the input."""
    low = values.select(F.col("v").bitwiseAND((1 << size) - 1).alias("slot"))
    words = low.groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("v")).toArrow()
    bits = np.zeros(1 << (size - 6), np.int64)
    bits[words["w"].to_numpy()] = words["v"].to_numpy()
    return spark.sparkContext.broadcast(bits.view(np.uint8))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text_or_empty(text), WS), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- weak supervision -------------------------------------------------------------------------


class VoteModel:
    """Latent-class model of votes in {-1, 0, 1}; an abstention (0) says nothing about the class.

    `theta[k][c]` holds the probabilities of the votes -1 and 1 of labeler k, where it votes, under
    class c (0 bad, 1 good).
    """

    def __init__(self, names: list[str], prior: float, theta: list[list[list[float]]]):
        self.names, self.prior, self.theta = names, prior, theta

    def log_odds(self) -> Column:
        """Posterior log-odds of class 1 given the vote columns, as one Catalyst expression."""
        e = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, (bad, good) in zip(self.names, self.theta, strict=True):
            w = [math.log(g / b) for g, b in zip(good, bad, strict=True)]
            e = e + F.when(F.col(name) < 0, w[0]).when(F.col(name) > 0, w[1]).otherwise(0.0)
        return e

    def posterior(self) -> Column:
        return 1 / (1 + F.exp(-self.log_odds()))


#: Prior probabilities of the votes -1 and 1 for the bad and the good class.
PRIOR_VOTES = [[0.7, 0.3], [0.3, 0.7]]


def fit_votes(patterns: DataFrame, names: list[str], rounds: int = 12, strength: float = 0.05, table: list[list[float]] = PRIOR_VOTES) -> VoteModel:
    """Expectation-maximisation over the histogram of vote patterns (columns `names` and `n`).

    The histogram has at most 3^k rows whatever the corpus size, so it is collected once and the rounds
    run over its columns in the driver. A Dirichlet prior worth `strength` of all
    rows, centred on `table` (the vote probabilities of a typical labeler for the bad and the good
    class), keeps the classes from swapping. An empty histogram leaves the prior.
    """
    model = VoteModel(names, 0.5, [[list(table[0]), list(table[1])] for _ in names])
    rows = np.array(patterns.select(*names, F.col("n").cast("double")).orderBy(*names).collect(), float).reshape(-1, len(names) + 1)
    votes, count = rows[:, :-1], rows[:, -1]
    n = float(count.sum())
    if not n:
        return model
    s = strength * n
    for _ in range(rounds):
        odds = np.full(len(rows), math.log(model.prior / (1 - model.prior)))
        for k, (bad, good) in enumerate(model.theta):
            w = [math.log(g / b) for g, b in zip(good, bad, strict=True)]
            odds += np.where(votes[:, k] < 0, w[0], np.where(votes[:, k] > 0, w[1], 0.0))
        p = 1 / (1 + np.exp(-odds))
        weight = [count * (1 - p), count * p]
        theta = [[[float((weight[i][votes[:, k] == v].sum() + s * table[i][v > 0]) / (weight[i][votes[:, k] != 0].sum() + s)) for v in (-1, 1)] for i in (0, 1)] for k in range(len(names))]
        model = VoteModel(names, (float(weight[1].sum()) + s / 2) / (n + s), theta)
    return model


def fit_votes_sql(hist: str, names: list[str], rounds: int = 12, strength: float = 0.05, pt: list[list[float]] = PRIOR_VOTES) -> tuple[str, str, str]:
    """DuckDB form of `fit_votes`: (CTEs, log-odds expression over alias h and m, name of the last CTE)."""
    col = lambda c, k, v: f"{c}{k}_{v + 1}"
    first = ", ".join(f"{pt[i][v > 0]!r}::DOUBLE AS {col(c, k, v)}" for k in range(len(names)) for v in (-1, 1) for i, c in enumerate("bg"))
    odds = "ln(m.prior / (1 - m.prior))" + "".join(
        f" + CASE WHEN h.{x} < 0 THEN ln(m.{col('g', k, -1)} / m.{col('b', k, -1)}) WHEN h.{x} > 0 THEN ln(m.{col('g', k, 1)} / m.{col('b', k, 1)}) ELSE 0 END"
        for k, x in enumerate(names)
    )
    ctes = [f"m0 AS MATERIALIZED (SELECT 0.5::DOUBLE AS prior, {first})"]
    for r in range(rounds):
        sums = ", ".join(
            f"(sum(CASE WHEN {x} = {v} THEN n ELSE 0 END * {w}) + {strength!r} * sum(n) * {pt[i][v > 0]!r}) / (sum(CASE WHEN {x} <> 0 THEN n ELSE 0 END * {w}) + {strength!r} * sum(n)) AS {col(c, k, v)}"
            for k, x in enumerate(names)
            for v in (-1, 1)
            for i, (c, w) in enumerate((("b", "(1 - p)"), ("g", "p")))
        )
        ctes.append(f"m{r + 1} AS MATERIALIZED (SELECT (sum(n * p) + {strength!r} * sum(n) / 2) / (sum(n) + {strength!r} * sum(n)) AS prior, {sums} FROM (SELECT h.*, 1 / (1 + exp(-({odds}))) AS p FROM {hist} h, m{r} m))")
    return ",\n".join(ctes), odds, f"m{rounds}"


# --- connected components -----------------------------------------------------------------------


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of `edges(a, b)` by alternating large-star and small-star rounds.

    Every round is two keyed aggregations and joins, so a hub with many neighbours is summed before
    it is shuffled and a skewed join can be split; rounds are cut by a table in the shared folder.
    Returns (node, component): component is the smallest node reachable. Nodes without an edge to
    another node are absent.
    """
    state = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = materialize(e, f"{tag}-edges")
    before = state(e)
    while before["n"]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select("b", "m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        last, e = e, materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), f"{tag}-edges")
        discard(last)
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
