"""Operator 8, mixing sources to target weights: hash-threshold histograms.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share
`FACTOR` of all words; no target exceeds `CAP` times its source, the excess is reshared (water
filling, solved in closed form over one row per source). Every document of a source is taken
floor(target / size) times; what remains of the budget goes to the documents whose 60-bit hash lies
below a threshold. The threshold comes from nested histograms: words by source and leading hash
bits, then only the boundary bucket again by the next bits. Documents are never sorted and never
grouped; the hot source is summed before it is shuffled.

Defined results: null or empty texts have size 0 and take 0; a source of size 0 has target 0;
rows that share the boundary hash (repeats of one row) each take the same fraction of their words,
so reruns agree; a null source is a source of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm._shared import materialize, table, text_or_empty

WEIGHTS, FACTOR, CAP, SEED = (3, 1, 2), 1.5, 2, "mix-1"
#: Hash bits that each level of histograms resolves; 60 in all.
BITS = (12, 16, 16, 16)


def row_hash(doc_id: Column, text: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text_or_empty(text)))), 1, 15), 16, 10).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"m_size": F.regexp_count(text_or_empty(F.col("text")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), "m_hash": row_hash(F.col("doc_id"), F.col("text"))})


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> with `target`; one row per source, so the windows are small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("w", F.get(F.array(*[F.lit(x) for x in WEIGHTS]), (F.row_number().over(order) - 1) % len(WEIGHTS)))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after, every = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    s = s.withColumn("cap", CAP * F.col("source_size"))
    s = s.withColumn("level", (FACTOR * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after))
    # the level rises while sources saturate; it is final at the first source that stays below its cap
    s = s.withColumn("k", F.row_number().over(by)).withColumn("level", F.min_by(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level")), F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("k"))).over(every))
    return s.select("source", "source_size", F.when(F.col("level").isNull() | (F.col("cap") / F.col("w") <= F.col("level")), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("level")).alias("target"))


def thresholds(sized: DataFrame) -> DataFrame:
    """One row per source of `sized(source, m_size, m_hash)`: target, whole copies, `cut` and `part`.

    Documents with a hash below `cut` are taken once more, those at `cut` for `part` of their words.
    """
    plan = targets(sized.groupBy("source").agg(F.sum("m_size").alias("source_size")))
    plan = plan.withColumn("whole", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)))
    plan = materialize(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumns({"cut": F.lit(0).cast("long"), "below": F.lit(0).cast("long"), "at": F.lit(0).cast("long")}), "mix-plan")
    shift = sum(BITS)
    for bits in BITS:
        shift -= bits
        p = plan.alias("p")
        inside = sized.alias("d").join(p, F.col("d.source").eqNullSafe(F.col("p.source")) & (F.shiftright("d.m_hash", shift + bits) == F.col("p.cut")))
        hist = inside.groupBy(F.col("p.source").alias("source"), F.shiftright("m_hash", shift).alias("bucket")).agg(F.sum("m_size").alias("n"), F.first("below").alias("below"), F.first("rest").alias("rest"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        edge = hist.withColumn("upto", F.col("below") + F.sum("n").over(upto)).where("upto > rest").groupBy("source").agg(F.min(F.struct("bucket", "upto", "n")).alias("e"))
        plan = materialize(
            p.join(edge.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left").select(
                "p.source", "p.source_size", "p.target", "p.whole", "p.rest", F.coalesce("e.e.bucket", F.lit(-1)).alias("cut"), F.coalesce(F.col("e.e.upto") - F.col("e.e.n"), "p.below").alias("below"), F.coalesce("e.e.n", F.lit(0)).cast("long").alias("at")
            ),
            "mix-plan",
        )
    return plan.withColumn("part", F.coalesce(F.try_divide(F.col("rest") - F.col("below"), F.col("at")), F.lit(0.0)))


def taken_words() -> Column:
    return (F.col("whole") * F.col("m_size") + F.when(F.col("m_hash") < F.col("cut"), F.col("m_size")).when(F.col("m_hash") == F.col("cut"), F.floor(F.col("m_size") * F.col("part"))).otherwise(0)).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of `docs`."""
    sized = materialize(measured(docs.select("doc_id", "source", "text")).drop("text"), "mix-sizes")
    plan = thresholds(sized).alias("p")
    return sized.alias("d").join(plan, F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.doc_id", "d.source", F.col("m_size").alias("size"), "p.source_size", "p.target", taken_words().alias("taken"))


def resample(docs: DataFrame) -> DataFrame:
    """The mixed corpus with the columns of `docs`: each row as often as its taken words fill it.

    A document at the boundary hash is taken whole if at least half of its words are.
    """
    sized = measured(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("m_row"), "doc_id", "source", "text")).drop("text", "doc_id")
    plan = thresholds(materialize(measured(docs.select("doc_id", "source", "text")).drop("text"), "mix-sizes")).alias("p")
    copies = F.col("whole") + F.when(F.col("m_hash") < F.col("cut"), 1).when((F.col("m_hash") == F.col("cut")) & (F.col("part") >= 0.5), 1).otherwise(0)
    out = sized.alias("d").join(plan, F.col("d.source").eqNullSafe(F.col("p.source"))).select("m_row", F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int"))).alias("n"))
    return out.select("m_row", F.explode("n")).select("m_row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def oracle(docs: str = "documents") -> str:
    size = "length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 'a', 'g'), '[\\x20\\x09-\\x0D]+', '', 'g'))"
    return f"""
WITH d AS (SELECT doc_id, source, {size}::BIGINT AS size, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM {docs}),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS w, {CAP} * source_size AS cap FROM s0),
s2 AS (SELECT *, row_number() OVER o AS k, ({FACTOR}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1 WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
s3 AS (SELECT *, (SELECT arg_min(level, k) FROM s2 WHERE level <= cap / w) AS final FROM s2),
s AS (SELECT source, source_size, (CASE WHEN final IS NULL OR cap / w <= final THEN cap ELSE w * final END)::DOUBLE AS target FROM s3),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM s),
c AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS rest,
  sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS amt
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, size, source_size, target,
  (whole * size + CASE WHEN upto <= rest THEN size WHEN upto - amt <= rest AND amt > 0 THEN floor(size * ((rest - (upto - amt)) / amt)) ELSE 0 END)::BIGINT AS taken FROM c"""


QUERIES = {"op8_mixing": op8_mixing}
ORACLES = {"op8_mixing": oracle()}
