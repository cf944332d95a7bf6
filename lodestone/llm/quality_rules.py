"""Operator 1, quality rules: weak supervision instead of all-must-pass filtering.

Ten rules look at whole-text statistics and vote good (1), bad (-1) or abstain (0). The rules'
reliabilities are estimated by expectation-maximisation over the histogram of vote patterns
(at most 3^10 rows at any corpus size), and a document is kept if its posterior probability of
being good is at least `THRESHOLD` and it doesn't fail the two base rules. Everything is built from
DataFrame functions; no document leaves its task, so a hot source or a group of copies costs nothing.

Defined results: a null or empty text has no words, fails the base rules and is dropped; ties and
repeated rows are judged alike; an empty table gives an empty result; a null doc_id is returned as
null; other columns of the input are ignored by `judge` and passed through by `keep`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._shared import VoteModel, fit_votes, fit_votes_sql, materialize, table, text_or_empty, word_array

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW, THRESHOLD = 10, 20, 5, 0.5
#: Rule -> (vote bad if, vote good if), over the columns of `statistics`; neither: abstain.
RULES = {
    "v_symbols": ("n_symbols > 0.1 * n_words", "n_symbols < 0.02 * n_words"),
    "v_dup_lines": ("n_dup_lines > 0.3 * n_lines", "n_dup_lines = 0 AND n_lines >= 2"),
    "v_repeats": ("n_repeat_words > 0.1 * n_words", "n_repeat_words < 0.02 * n_words AND n_words >= 30"),
    "v_word_length": ("word_chars < 2 * n_words OR word_chars > 12 * n_words", "word_chars >= 3 * n_words AND word_chars <= 9 * n_words"),
    "v_capitals": ("n_upper > 0.3 * word_chars", "n_upper < 0.12 * word_chars"),
    "v_exclaim": ("n_exclaim > 0.2 * n_words", "n_exclaim < 0.02 * n_words"),
    "v_cells": ("n_cells > 0.1 * n_words", "n_cells < 0.01 * n_words AND n_words >= 30"),
    "v_line_ends": ("n_ended_lines < 0.3 * n_lines", "n_ended_lines >= 0.6 * n_lines AND n_lines >= 1"),
    "v_length": ("n_words < 12", "n_words >= 50"),
    "v_letters": ("n_letters < 0.7 * word_chars", "n_letters >= 0.85 * word_chars"),
}
NAMES = list(RULES)
#: A bad document breaks one or two rules and satisfies the rest, so a bad vote says more than a good one.
PRIOR = [[0.4, 0.6], [0.03, 0.97]]
BASE_FAILED = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the statistics that the rules read, all from the whole text."""
    d = docs.withColumn("q_t", text_or_empty(F.col(text)))
    d = d.withColumn("q_w", word_array(F.col("q_t"))).withColumn("q_l", F.filter(F.split("q_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("q_h", F.when(F.size("q_w") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("q_w") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("q_w"), i + k) for k in range(WINDOW)]))))
    d = d.withColumn("q_s", F.when(F.size(F.array_distinct("q_h")) < F.size("q_h"), F.sort_array(F.transform("q_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = lambda x, k: F.coalesce(F.get(F.col("q_s"), k)["h"] == x["h"], F.lit(False))
    at = F.sort_array(F.filter(F.transform("q_s", lambda x, k: F.when(again(x, k - 1) | again(x, k + 1), x["i"])), lambda i: i.isNotNull()))
    # each repeated window adds the words that the windows before it haven't covered
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - i)).alias("n"), (i + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    # runs between letters are far fewer than letters, and capitals are looked for among the letters only
    d = d.withColumn("q_a", F.regexp_replace("q_t", r"[^\p{L}]+", ""))
    without = lambda c: (F.length("q_t") - F.length(F.replace(F.col("q_t"), F.lit(c)))).cast("long")
    return d.select(
        *[c for c in docs.columns],
        F.size("q_w").cast("long").alias("n_words"),
        F.length(F.array_join("q_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("q_t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("q_l") - F.size(F.array_distinct("q_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("q_l").cast("long").alias("n_lines"),
        F.size(F.filter("q_l", lambda x: x.rlike(r"[.!?\"')][\x20\x09-\x0D]*$"))).cast("long").alias("n_ended_lines"),
        F.length(F.regexp_replace("q_a", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length("q_a").cast("long").alias("n_letters"),
        without("!").alias("n_exclaim"),
        without("|").alias("n_cells"),
    )


def votes(stats: DataFrame) -> DataFrame:
    for name, (bad, good) in RULES.items():
        stats = stats.withColumn(name, F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"))
    return stats.withColumn("base_failed", F.expr(BASE_FAILED))


def fit(voted: DataFrame) -> VoteModel:
    """Reliabilities of the rules over every document."""
    return fit_votes(voted.groupBy(*NAMES).agg(F.count("*").alias("n")), NAMES, table=PRIOR)


def verdict(voted: DataFrame, model: VoteModel) -> DataFrame:
    return voted.withColumn("quality", model.posterior()).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= THRESHOLD))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, statistics, votes, `quality` (posterior) and `kept`."""
    voted = materialize(votes(statistics(docs.select("doc_id", "text"))).drop("text"), "quality-stats")
    return verdict(voted, fit(voted))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that pass, with the columns of `docs`."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("q_row"), F.col("text"))
    voted = materialize(votes(statistics(rows)).drop("text"), "quality-votes")  # also keeps the filter from repeating the statistics
    return verdict(voted, fit(voted)).where("kept").select("q_row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 4).alias("quality"), *NAMES)


def oracle() -> str:
    ws = r"[\x20\x09-\x0D]+"
    ctes, odds, last = fit_votes_sql("hist", NAMES, pt=PRIOR)
    rule_sql = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS {name}" for name, (bad, good) in RULES.items())
    strip = lambda x: f"regexp_replace({x}, '{ws}', '', 'g')"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{ws}'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: length({strip('x')}) > 0) AS l FROM t),
pos AS (SELECT rid, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5),
win AS (SELECT rid, i, w[i:i+4] AS g FROM pos JOIN w USING (rid)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY rid),
s AS (SELECT w.rid, doc_id, len(w)::BIGINT AS n_words, length({strip('t')})::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '[.!?"'')][\\x20\\x09-\\x0D]*$')))::BIGINT AS n_ended_lines,
  (length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')))::BIGINT AS n_upper,
  (length(t) - length(regexp_replace(t, '\\p{{L}}', '', 'g')))::BIGINT AS n_letters,
  (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaim,
  (length(t) - length(replace(t, '|', '')))::BIGINT AS n_cells
  FROM w LEFT JOIN cov USING (rid)),
v AS MATERIALIZED (SELECT *, {rule_sql}, ({BASE_FAILED}) AS base_failed FROM s),
hist AS MATERIALIZED (SELECT {', '.join(NAMES)}, count(*)::DOUBLE AS n FROM v GROUP BY ALL),
{ctes},
f AS (SELECT h.*, 1 / (1 + exp(-({odds}))) AS q FROM v h, {last} m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND q >= {THRESHOLD} AS kept, round(q, 4) AS quality, {', '.join(NAMES)} FROM f"""


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": oracle()}
