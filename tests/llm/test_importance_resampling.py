"""Importance resampling against plain Python, and on odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from lodestone.llm import importance_resampling as I

SCHEMA = "doc_id long, text string, digest string, copies long, score long, rank long"
RNG = np.random.default_rng(12)


def prose(n, letters="abcdefgh"):
    return " ".join("".join(RNG.choice(list(letters), RNG.integers(1, 4))) for _ in range(n))


LONG_WORD = "q" * 70 + "é" * 5000
TEXTS = [None, "", " \n--", "Two WORDS", "two words", "é日本 😀x1 A-b_c[d]^e", LONG_WORD + " " + prose(25), prose(3000), prose(19), prose(20), *["the same text again " * 6] * 30]
TEXTS += [prose(int(n)) for n in RNG.integers(20, 60, 40)] + [prose(30, "xyzabc") for _ in range(20)]
TARGET = [prose(40, "xyz") for _ in range(5)] + [None, ""]


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in [*w, *map(" ".join, zip(w, w[1:]))]]


def expected(rows, target):
    s, t = (Counter(b for text in texts for b in features(text)[1]) for texts in ([r[1] for r in rows], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out, may = [], []
    for i, text in rows:
        n, f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(f), weight, score))
        may += [(-score, math.inf if i is None else i)] if n >= 20 else []
    return out, sorted(may)[: len(may) * 25 // 100]


def test_equals_plain_python(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, prose(30, "xyz")), (7, TEXTS[7])]
    docs = spark.createDataFrame([(i, t, "d", 5, 6, 7) for i, t in rows], SCHEMA).repartition(5)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want, drawn = expected(rows, TARGET)
    got = I.op12_importance_resampling(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter(want)
    ranks = sorted((r["rank"], -r["score"], math.inf if r["doc_id"] is None else r["doc_id"]) for r in got if r["rank"] is not None)
    assert ranks == [(k + 1, *d) for k, d in enumerate(drawn)] and len(drawn) > 10
    kept = I.resample(docs, spark.createDataFrame([(t,) for t in TARGET], "text string"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {None if math.isinf(d[1]) else d[1] for d in drawn}


def test_buckets_of_words_of_any_bytes():
    texts = [bytes(RNG.integers(0, 256, 60).tolist()).decode("latin-1") for _ in range(300)] + ["a" * n for n in range(60, 70)] + [None, "", LONG_WORD + " x " + LONG_WORD]
    parts = list(I.text_buckets(pa.array(texts)))
    count, buckets = np.concatenate([c for c, _ in parts]), np.concatenate([b for _, b in parts])
    ends = np.r_[0, np.cumsum(np.maximum(2 * count - 1, 0))]
    for k, t in enumerate(texts):
        n, f = features(t)
        assert count[k] == n and Counter(buckets[ends[k] : ends[k + 1]].tolist()) == Counter(f)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, b"", 20, 1, 0, s) for i, s in [(5, 10), (3, 10), (9, 12), (1, 10), (None, 10), (2, 8), (4, 10), (8, 1)]]
    scored = spark.createDataFrame([(*r[:5], r[5]) for r in rows] + [(7, b"", 19, 1, 0, 99)], "doc_id long, digest binary, n_words long, n_features long, weight long, score long")
    got = {r["doc_id"]: r["rank"] for r in I.ranked(scored, 50).collect()}
    assert got == {9: 1, 1: 2, 3: 3, 4: 4, 5: None, None: None, 2: None, 8: None, 7: None}
    assert {r["rank"] for r in I.ranked(scored, 10).collect()} == {None}
    assert sum(r["rank"] is not None for r in I.ranked(scored, 100).collect()) == 8


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, prose(30), "d", 1, 1, 1)], SCHEMA)
    assert I.ranked(I.score(none, some)).count() == 0 and I.resample(none, none).columns == none.columns
    r = I.ranked(I.score(some, none)).collect()
    assert len(r) == 1 and r[0]["rank"] is None and r[0]["n_features"] == 59


def test_draws_move_towards_the_target(spark):
    rows = [(i, " ".join(RNG.choice(list("xyz" if i % 10 == 0 else "abcdef"), 40))) for i in range(600)]
    target = spark.createDataFrame([(" ".join(RNG.choice(list("xyz"), 200)),) for _ in range(10)], "text string")
    drawn = [r["doc_id"] for r in I.resample(spark.createDataFrame(rows, "doc_id long, text string"), target, 10).collect()]
    assert len(drawn) == 60 and sum(i % 10 == 0 for i in drawn) > 40
