"""Operator 6, personal data: labelers vote on spans, expectation-maximisation weighs them.

Patterns propose candidate spans in the whole text. Five labelers (format, gazetteer, context,
edges, variety) vote on each; their reliabilities come from expectation-maximisation over the
histogram of vote patterns (at most 3^5 rows), and the posteriors train the final classifier, a
naive Bayes model over bounded span features. Base spans always stay; other candidates stay where
the classifier's probability reaches `THRESHOLD` and they don't overlap a base span. Only DataFrame
functions are used: matches are marked in the text by two private-use characters, and offsets come
from the lengths between marks. A document never leaves its task.

Defined results: a null text is empty and has no spans; repeated rows are judged alike; an empty
table gives an empty result; null doc_ids pass through; other columns are ignored by `find` and
passed through by `redact`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._shared import VoteModel, fit_votes, materialize, table, text_or_empty

THRESHOLD = 0.5
OPEN, CLOSE = "\ue000", "\ue001"
KINDS = ["email", "ip", "card", "phone", "number", "ssn", "iban", "local", "name"]
BASE_KINDS = KINDS[:4]
GIVEN = "James|Mary|John|Patricia|Robert|Jennifer|Michael|Linda|David|Elizabeth|William|Barbara|Richard|Susan|Thomas|Sarah|Anna|Maria|Peter|Hans|Klaus|Petra|Jean|Pierre|Claire|Sophie|Carlos|Juan|Luis|Carmen|Pedro|Lucia"
TITLE = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora|Sr|Sra"
#: Java patterns. Possessive forms never recurse or retry, so long runs cost linear time; a run that
#: can't start a match is entered at its first character (or after a match) only.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "digits": r"[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Z0-9])",
    "local": r"(?<![0-9+(.-])(?<![0-9)] )\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])",  # not the end of a longer number
    "name": rf"\b(?:(?:{TITLE})\.? (?:(?:{GIVEN}) )?|(?:{GIVEN}) )\p{{Lu}}\p{{L}}+",
}
#: What a text must hold for a pattern to match at all; cheaper to look for than the pattern.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "digits": "[0-9]{2}|[0-9][ -][0-9]", "phone": r"\+[0-9]", "ssn": "[0-9]{3}-[0-9]{2}-[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "local": r"[0-9]{3}[.-][0-9]{4}", "name": rf"\b(?:{TITLE}|{GIVEN})\b"}
CUES = {
    "email": r"mail|contact|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|address|adresse",
    "card": r"card|karte|carte|tarjeta|visa|credit|pay",
    "number": r"card|karte|carte|tarjeta|visa|credit|pay",
    "phone": r"phone|tel|call|mobile|fax",
    "local": r"phone|tel|call|mobile|fax",
    "ssn": r"ssn|social|security",
    "iban": r"iban|bank|account|konto|compte|cuenta",
    "name": r"name|dear|contact|by|author|regards|sincerely",
}
COUNTER_CUES = r"isbn|order|invoice|serial|version|build|model|part no|ticket"
LABELERS = ["format", "gazetteer", "context", "edges", "variety"]
FEATURES = ["kind", "n_digits", "grouped", "first", "format", "gazetteer", "context", "edges", "variety"]


def with_matches(d: DataFrame, text: str) -> DataFrame:
    """`d` with `p_<name>`: all leftmost non-overlapping matches of each pattern in column `text`, as array<struct<s, e, m, l, r>>
    in code points. m is the match, l the 40 characters before it and r the character after it.

    `text` must not hold the two mark characters. Steps are columns of their own, as an expression used
    twice would search twice; a text without a match of the pattern's gate isn't searched.
    """
    t = F.col(text)
    opens = lambda k: t.contains(GATES[k]) if GATES[k] == "@" else t.rlike(GATES[k])
    d = d.withColumns({f"p_m_{k}": F.when(opens(k), F.regexp_replace(t, F.lit(f"({p})"), F.lit(f"{OPEN}$1{CLOSE}"))) for k, p in PATTERNS.items()})
    d = d.withColumns({f"p_s_{k}": F.when(F.col(f"p_m_{k}").contains(OPEN), F.split(f"p_m_{k}", f"[{OPEN}{CLOSE}]", -1)) for k in PATTERNS})
    return d.withColumns({f"p_{k}": _between_marks(t, F.col(f"p_s_{k}")) for k in PATTERNS})


def _between_marks(text: Column, parts: Column) -> Column:
    none = F.array().cast("array<struct<s:int,e:int>>")
    walk = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), none.alias("found")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x)).alias("at"),
            (~a["inside"]).alias("inside"),
            F.when(a["inside"], F.array_append(a["found"], F.struct(a["at"].alias("s"), (a["at"] + F.length(x)).alias("e")))).otherwise(a["found"]).alias("found"),
        ),
        lambda a: a["found"],
    )
    return F.transform(
        F.when(parts.isNotNull(), walk).otherwise(none),
        lambda x: F.struct(
            x["s"].alias("s"), x["e"].alias("e"), F.substring(text, x["s"] + 1, x["e"] - x["s"]).alias("m"),
            F.substring(text, F.greatest(x["s"] - 39, F.lit(1)), F.least(x["s"], F.lit(40))).alias("l"), F.substring(text, x["e"] + 1, F.lit(1)).alias("r"),
        ),
    )


def _digits(x: Column) -> Column:
    return F.regexp_replace(x["m"], "[^0-9]", "")


def _between(x: Column, lo: int, hi: int) -> Column:
    return (F.length(_digits(x)) >= lo) & (F.length(_digits(x)) <= hi)


def luhn(x: Column) -> Column:
    return F.call_function("luhn_check", _digits(x))


def _votes(kind: Column, x: Column) -> dict[str, Column]:
    m, digits = x["m"], _digits(x)
    vote = lambda good, bad=None: F.when(good, 1).when(F.lit(True) if bad is None else bad, -1).otherwise(0)
    left = F.lower(x["l"])
    cue = F.lit(False)
    for k, pattern in CUES.items():
        cue = cue | ((kind == k) & left.rlike(pattern))
    return {
        "format": F.when(kind == "email", vote(m.rlike(r"\.[A-Za-z]{2,10}$")))
        .when(kind == "ip", vote(~m.rlike(r"(^|\.)0[0-9]") & ~m.startswith("0.")))
        .when(kind.isin("card", "number"), vote(luhn(x)))
        .when(kind == "phone", vote(_between(x, 10, 13), F.lit(False)))
        .when(kind == "ssn", vote(~m.rlike("^(000|666|9)")))
        .when(kind == "iban", vote((F.length(F.translate(m, " ", "")) >= 15) & (F.length(digits) >= 8)))
        .when(kind == "name", vote(m.rlike(rf"^(?:{TITLE})\b"), F.lit(False)))
        .otherwise(0),
        "gazetteer": F.when(kind == "email", vote(m.rlike(r"@(gmail|yahoo|outlook|hotmail|gmx|web|example|mail)"), F.lit(False)))
        .when(kind == "ip", vote(~m.rlike(r"^(0|127|255)\.")))
        .when(kind.isin("card", "number"), vote(digits.rlike("^(4|5[1-5]|3[47]|6011|65|2[2-7])")))
        .when(kind == "phone", vote(digits.rlike("^(1|7|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")))
        .when(kind == "local", vote(digits.rlike("^[2-9]")))
        .when(kind == "iban", vote(m.rlike("^(AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)")))
        .when(kind == "name", vote(m.rlike(rf"\b(?:{GIVEN})\b"), F.lit(False)))
        .otherwise(0),
        "context": F.when(left.rlike(COUNTER_CUES), -1).when(cue, 1).otherwise(0),
        "edges": vote(~x["l"].rlike(r"[\p{L}\p{N}_]$") & ~x["r"].rlike(r"[\p{L}\p{N}_]")),
        "variety": vote(F.size(F.array_distinct(F.split(F.lower(m), ""))) >= 5),
    }


def _spans(kind: str, found: Column) -> Column:
    def one(x: Column) -> Column:
        k, digits = F.lit(kind), _digits(x)
        v = {name: e.cast("int") for name, e in _votes(k, x).items()}
        n = F.length(digits)
        return F.struct(
            k.alias("kind"), x["s"].alias("s"), x["e"].alias("e"), *[e.alias(name) for name, e in v.items()],
            F.when(n < 6, "0").when(n < 10, "6").when(n < 13, "10").when(n < 16, "13").when(n < 20, "16").otherwise("20").alias("n_digits"),
            x["m"].rlike(r"[ .()-]").cast("int").alias("grouped"),
            F.when(x["m"].rlike("^[0-9+(]"), F.substring(x["m"], 1, 1)).otherwise("a").alias("first"),
        )

    return F.transform(found, one)


def candidates(docs: DataFrame) -> DataFrame:
    """`docs` with `p_base` and `p_more`, arrays of base spans and of further candidates."""
    t = text_or_empty(F.col("text"))
    d = docs.withColumn("p_t", F.when(t.contains(OPEN) | t.contains(CLOSE), F.translate(t, OPEN + CLOSE, "\u00a0\u00a0")).otherwise(t))
    d = with_matches(d, "p_t")
    size_ok = lambda x: _between(x, 13, 19)
    base = {
        "email": F.col("p_email"),
        "ip": F.filter("p_ip", lambda x: F.forall(F.split(x["m"], r"\."), lambda o: (F.length(F.regexp_replace(o, "^0+", "")) <= 3) & (F.substring(F.concat(F.lit("0"), F.regexp_replace(o, "^0+", "")), 1, 4).cast("int") <= 255))),
        "card": F.filter("p_digits", lambda x: size_ok(x) & luhn(x)),
        "phone": F.filter("p_phone", lambda x: _between(x, 9, 15)),
    }
    more = {"number": F.filter("p_digits", lambda x: size_ok(x) & ~luhn(x)), "ssn": F.col("p_ssn"), "iban": F.col("p_iban"), "local": F.col("p_local"), "name": F.col("p_name")}
    d = d.withColumns({f"p_k_{k}": _spans(k, e) for k, e in {**base, **more}.items()})
    d = d.withColumn("p_base", F.concat(*[f"p_k_{k}" for k in base])).withColumn("p_more", F.filter(F.concat(*[f"p_k_{k}" for k in more]), lambda x: ~F.exists("p_base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))))
    return d.select(*[F.col(f"`{c}`") for c in docs.columns], "p_base", "p_more")


class SpanClassifier:
    """Naive Bayes over `FEATURES`, trained on posteriors of the vote model; a few hundred numbers."""

    def __init__(self, prior: float, weights: dict[str, dict[str, float]]):
        self.prior, self.weights = prior, weights

    def keeps(self, x: Column) -> Column:
        score = F.lit(self.prior)
        for name, values in self.weights.items():
            w = F.lit(0.0)
            for value, weight in values.items():
                w = F.when(x[name].cast("string") == value, weight).otherwise(w)
            score = score + w
        return score >= math.log(THRESHOLD / (1 - THRESHOLD))


def fit(found: DataFrame) -> SpanClassifier:
    """Vote reliabilities, then the classifier, over every candidate span of `found`."""
    rows = found.select(F.explode(F.concat("p_base", "p_more")).alias("x")).select("x.*")
    rows = materialize(rows.groupBy(*FEATURES).agg(F.count("*").alias("n")).coalesce(1), "pii-votes")  # bounded: every feature has few values
    model: VoteModel = fit_votes(rows.groupBy(*LABELERS).agg(F.sum("n").alias("n")), LABELERS)
    soft = rows.withColumn("p", model.posterior())
    counts = soft.select("n", "p", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in FEATURES])).alias("x"))
    sums = counts.groupBy("x.f", "x.v").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")).collect()
    yes, no = sum(r["yes"] for r in sums if r["f"] == "kind"), sum(r["no"] for r in sums if r["f"] == "kind")
    weights: dict[str, dict[str, float]] = {f: {} for f in FEATURES}
    for r in sums:
        weights[r["f"]][r["v"]] = math.log((r["yes"] + 1) / (yes + 2)) - math.log((r["no"] + 1) / (no + 2))
    return SpanClassifier(math.log((yes + 1) / (no + 1)), weights)


def judged(found: DataFrame, model: SpanClassifier) -> DataFrame:
    """`found` with `p_spans`: base spans and kept candidates by kind, then start."""
    return found.withColumn("p_spans", F.concat("p_base", F.filter("p_more", model.keeps)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, `p_base` and `p_spans` for every row of `docs`."""
    found = materialize(candidates(docs.select("doc_id", "text")).drop("text"), "pii-spans")
    return judged(found, fit(found))


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every found span replaced by its kind in brackets; other columns unchanged."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("p_row"), F.col("text"))
    found = materialize(candidates(rows).drop("text"), "pii-spans").withColumn("text", F.col("p_row.text"))
    d = judged(found, fit(found))
    d = d.withColumn("p_order", F.array_sort(F.transform("p_spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("k")))))
    cut = F.aggregate(
        "p_order",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(x["s"] < a["at"], F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(x["e"].alias("at"), F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, x["s"] - a["at"]), F.lit("["), x["k"], F.lit("]")).alias("out"))
        ),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))),
    )
    clean = d.withColumn("p_clean", F.when(F.size("p_order") > 0, cut).otherwise(F.col("text")))
    return clean.select(*[F.col("p_clean").alias("text") if c == "text" else F.col(f"p_row.`{c}`").alias(c) for c in docs.columns])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter(F.transform("p_base", lambda x: x["kind"]), F.lit(k).eqNullSafe)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("p_base")), 256).alias("base_sha256"), joined(F.col("p_spans")).alias("spans"))


QUERIES = {"op6_pii": op6_pii}
ORACLES: dict[str, str] = {}
