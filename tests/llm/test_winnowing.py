"""Winnowing against plain Python, its match guarantee, neighbours over many ranges, and odd tables."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import winnowing as W

SCHEMA = "doc_id long, text string, n_chars string, fingerprint int, range int"
M = (1 << 64) - 1
RNG = np.random.default_rng(13)


def prose(n):
    return "".join(RNG.choice(list("abcdef ABC\n\té日😀"), n))


def mix(x):
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & M
    return x ^ (x >> 29)


def fold(t):
    return [ord(" ") if c in "\t\n\x0b\x0c\r" else ord(c) + 32 if "A" <= c <= "Z" else ord(c) for c in t]


def poly(codes):
    h, power = 0, 1
    for c in codes:
        h, power = (h + mix(((c + 1) * 0x9E3779B97F4A7C15) & M) * power) & M, power * 0x9E3779B97F4A7C15 & M
    return h


def brute(t):
    c = fold(t)
    if not c:
        return []
    if len(c) < W.GRAM:
        return [(mix(poly(c) ^ (0xC2B2AE3D27D4EB4F * len(c) & M)), 0)]
    h = [mix(poly(c[i : i + W.GRAM])) for i in range(len(c) - W.GRAM + 1)]
    w, kept = min(W.WINDOW, len(h)), {}
    for a in range(len(h) - w + 1):
        least = min(x >> 24 for x in h[a : a + w])
        p = max(i for i in range(a, a + w) if h[i] >> 24 == least)
        kept[p] = h[p]
    return sorted(((v, p) for p, v in kept.items()), key=lambda x: x[1])


def pairs(marks):
    return list(zip(marks[0].tolist(), marks[1].tolist(), strict=True))


def spell(marks):
    return ",".join(f"{h:016x}:{p}" for h, p in marks)


def likeness(a, b):
    x, y = {h for h, _ in a}, {h for h, _ in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def test_windows_equal_plain_python(monkeypatch):
    texts = ["", "a", "x" * 15, "x" * 16, "x" * 17, "x" * 400, "ab" * 100, *[prose(n) for n in (16, 40, 64, 65, 66, 130, 700)], "A b\tC", "a b c", "y" * 64]
    got = [pairs(m) for m in W.winnow(texts)]
    assert got == [brute(t) for t in texts]
    assert [pairs(W.winnow([t])[0]) for t in texts] == got
    assert got[5][-1][1] == 400 - 16 and len(got[5]) == 400 - 16 - 49 + 2  # all hashes equal: the rightmost of every window
    assert got[14][0][0] == got[15][0][0]
    long = prose(3000)
    whole = brute(long)
    monkeypatch.setattr(W, "CHUNK", 200)  # pieces that overlap by a window, and many runs of texts
    assert pairs(W.winnow([long])[0]) == whole and [pairs(m) for m in W.winnow([*texts, long])] == [*got, whole]


def test_shared_passages_are_found_and_gaps_bounded():
    for _ in range(60):
        passage = prose(W.GUARANTEE)
        a, b = (prose(int(RNG.integers(0, 300))) for _ in range(2))
        x, y = (pairs(m) for m in W.winnow([a + passage + prose(200), b + passage + prose(90)]))
        at = {(h, p - len(a)) for h, p in x if 0 <= p - len(a) <= len(passage) - W.GRAM}
        assert at & {(h, p - len(b)) for h, p in y}
        places = [p for _, p in x]
        assert max(np.diff(places)) <= W.WINDOW


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_neighbours_over_ranges(spark, parts):
    def listed(batches):
        for rows in W.neighbours(batches):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))], ["doc_id", "text", "next"])

    ids = [*range(-5, 60, 2), 1000, 1 << 40, None, None]
    rows = [(i, f"{i}-{k}" if i is not None else f"none {k}") for k, i in enumerate(ids)]
    out = W.ranges(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), parts)
    got = out.mapInArrow(listed, "doc_id long, text string, next string").collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter((*r, order[(k + 1) % len(order)][1]) for k, r in enumerate(order))
    assert Counter(tuple(r) for r in got) == want


def test_query_equals_brute_force(spark, tmp_path):
    texts = [None, "", "", "ab", prose(50), prose(2000), prose(2000), *[prose(int(n)) for n in RNG.integers(1, 500, 30)]]
    texts += [texts[5], texts[5]]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, prose(80)), (15, texts[5]), (15, "another text of the same id")]
    spark.createDataFrame([(*r, "n", 1, 2) for r in rows], SCHEMA).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = W.op13_document_fingerprints(spark, str(tmp_path)).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        follower, m = order[(k + 1) % len(order)][1], len(t) // 3
        new = t[: len(t) - m] + follower[:m]
        own, changed = brute(t), brute(new)
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), spell(own), spell(changed), likeness(own, changed), likeness(own, brute(follower))))
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert next(r["near_edited"] for r in got if r["doc_id"] == 18) > 0.4


def test_one_row_empty_table_and_columns(spark):
    one = W.with_next(spark.createDataFrame([(4, "some text of one row")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256(b"some text of osome t").hexdigest()
    assert W.with_next(spark.createDataFrame([], SCHEMA)).count() == 0
    assert W.with_next(spark.createDataFrame([(None, "a"), (None, None)], "doc_id long, text string")).count() == 2
    f = W.fingerprints(spark.createDataFrame([(1, "a b", "x", 1, 1), (2, None, "x", 1, 1), (3, prose(300), "x", 1, 1)], SCHEMA))
    assert {r["doc_id"]: (r["n_chars"], len(r["fingerprint"])) for r in f.collect()}[2] == (0, 0)
    both = f.alias("a").join(f.alias("b"), F.col("a.doc_id") == F.col("b.doc_id")).select(W.near(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("n"))
    assert {r["n"] for r in both.collect()} == {1.0}
