"""Operator 13, document fingerprints by winnowing.

Every run of GRAM code points (A-Z as a-z, each white-space character as a blank) gets a rolling 64-bit hash. Of every window of WINDOW
consecutive hashes the least is kept, by its leading 40 bits, the rightmost of equal ones, with its position.
Two texts that share GUARANTEE = GRAM + WINDOW - 1 code points in a row therefore share a hash, whatever surrounds them, and
no gap between kept positions exceeds WINDOW. A text of fewer code points than GRAM has one hash of all of them;
one of fewer hashes than WINDOW is one window. The likeness of two fingerprints is the Jaccard resemblance of their sets of hashes.

Neighbours in the order of ids (`with_next`) meet by a range partitioning of its own: cut points are ids of the table
(`percentile_approx`, merged sketches), so every range's first row is known by its id and is sent to the preceding range as well; one shuffle, sorted within
a task, streamed batch by batch. Nothing is numbered globally and no range needs another's rows.

Defined results: a null text is empty; an empty text has an empty fingerprint, which resembles an empty one by 1 and any other by 0; null ids
come last, rows of one id in the order of their texts (and in one task, a row at a time); a table of one row is its own
neighbour; an empty table gives no rows. Texts of any length count whole: windows run over pieces that overlap by a window. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._shared import bounded_batches, shuffle_parts, table, text_or_empty
from lodestone.llm._text import _POWERS, CHUNK, mixed, release

GRAM, WINDOW = 16, 49
GUARANTEE = GRAM + WINDOW - 1
#: Leading bits of a hash that decide the minimum; the rest of a 64-bit key holds the place within a piece.
_LOW = np.uint64((1 << 24) - 1)
_CODE, _SHORT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

Marks = tuple[np.ndarray, np.ndarray]


def _folded(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where((c >= 65) & (c <= 90), c + np.uint32(32), c)
    return np.where((c >= 9) & (c <= 13), np.uint32(32), c)


def _rolling(c: np.ndarray) -> np.ndarray:
    """Hash of the GRAM code points from every place of `c` that has as many."""
    n = len(c)
    up, down = _POWERS.get(max(n, CHUNK))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed((c.astype(np.uint64) + np.uint64(1)) * _CODE) * up[:n], out=total[1:])
    return mixed((total[GRAM:] - total[: n - GRAM + 1]) * down[: n - GRAM + 1])


def _least(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive keys, in log2(w) passes."""
    m, span = key, 1
    while 2 * span <= w:
        m, span = np.minimum(m[:-span], m[span:]), 2 * span
    return np.minimum(m[: len(key) - w + 1], m[w - span : len(key) - span + 1])


def _marks(text: str) -> Marks:
    """Kept hashes and their places of a text of at least GRAM code points, piece by piece."""
    grams = len(text) - GRAM + 1
    w, found = min(WINDOW, grams), []
    for at in range(0, grams - w + 1, max(CHUNK - w + 1, 1)):
        h = _rolling(_folded(text[at : at + CHUNK + GRAM - 1]))
        m = _least((h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64)), w)
        place = (_LOW - (m & _LOW)).astype(np.int64)
        place = place[np.r_[True, place[1:] != place[:-1]]]
        found.append((h[place], place + at))
    h, place = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.r_[True, place[1:] > place[:-1]]  # pieces that meet may both keep a place
    return h[new], place[new]


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK code points."""
    ends = np.cumsum([len(t) for t in texts])
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, "right")))
        yield lo, hi
        lo = hi


def _together(texts: list[str]) -> list[Marks]:
    """`_marks` of many texts of at least GRAM and together at most about CHUNK code points."""
    size = np.array([len(t) for t in texts])
    ends = np.cumsum(size)
    h = _rolling(_folded("".join(texts)))
    own = np.repeat(ends, size)[: len(h)] - np.arange(len(h)) >= GRAM
    h, grams = h[own], size - GRAM + 1
    last = np.cumsum(grams)
    key = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
    small = np.flatnonzero(grams < WINDOW)
    least = np.minimum.reduceat(key, last - grams)[small]
    if len(key) >= WINDOW:
        whole = np.repeat(last, grams)[: len(key) - WINDOW + 1] - np.arange(len(key) - WINDOW + 1) >= WINDOW
        least = np.r_[least, _least(key, WINDOW)[whole]]
    place = np.unique((_LOW - (least & _LOW)).astype(np.int64))
    cut = np.searchsorted(place, np.r_[0, last])
    return [(h[place[a:b]], place[a:b] - start) for a, b, start in zip(cut[:-1].tolist(), cut[1:].tolist(), (last - grams).tolist(), strict=True)]


def winnow(texts: list[str]) -> list[Marks]:
    """Kept hashes (64 bits) and their places (code points) of every text, in the order of places."""
    none = (np.empty(0, np.uint64), np.empty(0, np.int64))
    out: list[Marks] = [none] * len(texts)
    for i, t in enumerate(texts):
        if 0 < len(t) < GRAM:
            c = _folded(t).astype(np.uint64) + np.uint64(1)
            out[i] = mixed((mixed(c * _CODE) * _POWERS.get(CHUNK)[0][: len(c)]).sum(dtype=np.uint64, keepdims=True) ^ (_SHORT * np.array([len(c)], np.uint64))), np.zeros(1, np.int64)
    whole = [i for i, t in enumerate(texts) if len(t) >= GRAM]
    for lo, hi in _runs([texts[i] for i in whole]):
        part = [texts[i] for i in whole[lo:hi]]
        for i, m in zip(whole[lo:hi], _together(part) if len(part) > 1 else [_marks(part[0])], strict=True):
            out[i] = m
    return out


def resemblance(a: Marks, b: Marks) -> float:
    x, y = np.unique(a[0]), np.unique(b[0])
    both = len(np.intersect1d(x, y, assume_unique=True))
    every = len(x) + len(y) - both
    return both / every if every else 1.0


def near(a: Column, b: Column) -> Column:
    """`resemblance` of two columns of `fingerprints`, without Python."""
    x, y = F.array_distinct(a["hash"]), F.array_distinct(b["hash"])
    every = F.size(F.array_union(x, y))
    return F.when(every == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / every)


def _list_ends(marks: list[Marks]) -> pa.Array:
    return pa.array(np.r_[0, np.cumsum([len(h) for h, _ in marks])], pa.int32())


def _flat(marks: list[Marks]) -> Marks:
    return (np.concatenate([h for h, _ in marks]), np.concatenate([p for _, p in marks])) if marks else (np.empty(0, np.uint64), np.empty(0, np.int64))


_HEX = np.array([list(f"{b:02x}".encode()) for b in range(256)], np.uint8)


def spelled(marks: list[Marks]) -> pa.Array:
    """Every fingerprint as text: hash:place, the hash in 16 hexadecimal digits, joined by commas."""
    h, place = _flat(marks)
    digits = _HEX[h.astype(">u8").view(np.uint8)].ravel()
    hashes = pa.Array.from_buffers(pa.string(), len(h), [None, pa.py_buffer((np.arange(len(h) + 1) * 16).astype(np.int32)), pa.py_buffer(digits)])
    pairs = pc.binary_join_element_wise(hashes, pa.array(place).cast(pa.string()), ":")
    return pc.binary_join(pa.ListArray.from_arrays(_list_ends(marks), pairs), ",")


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = _texts(b.column(1))
        marks = winnow(texts)
        h, place = _flat(marks)
        pairs = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(place)], ["hash", "place"])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(_list_ends(marks), pairs)], ["doc_id", "n_chars", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint array<struct<hash, place>> of every row of `docs(doc_id, text)`; no shuffle."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprint, f"doc_id {kind}, n_chars long, fingerprint array<struct<hash: long, place: long>>")


# --- neighbours -------------------------------------------------------------------------------------


def ranges(docs: DataFrame, parts: int) -> DataFrame:
    """`docs(doc_id, text)` dealt to ranges of falling ids, one a task: range, guest, doc_id, text, sorted.

    Behind its own rows a range has, as guests, the rows of the next range's first id; the last range those of the first.
    """
    at = [i / parts for i in range(1, parts + 1)]
    cuts = docs.agg(F.percentile_approx("doc_id", at, max(10_000, 20 * parts)).alias("c"), F.max("doc_id").alias("m")).first()
    cuts = np.unique(np.array([*(cuts["c"] or []), *([] if cuts["m"] is None else [cuts["m"]])], np.int64))  # ids of the table; a range ends with one

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        i = ids.fillna(0).to_numpy().astype(np.int64)
        own = np.where(known, np.searchsorted(cuts, i), 0)
        first = known & (len(cuts) > 0)
        first[first] = cuts[own[first]] == i[first]
        return pd.Series([[k, -1 - (k + 1) % len(cuts)] if f else [k] for k, f in zip(own.tolist(), first.tolist(), strict=True)])

    rows = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"), F.explode(places("doc_id")).alias("p"))
    rows = rows.select(F.when(F.col("p") < 0, -1 - F.col("p")).otherwise(F.col("p")).alias("range"), (F.col("p") < 0).alias("guest"), "doc_id", "text")
    return rows.repartitionById(max(len(cuts), 1), F.col("range")).sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "text")


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """For every batch of `ranges`: (doc_id, text, next text) of the rows whose next row is known by its end."""
    held = first = None
    for b in batches:
        out = []
        for k, guest, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), _texts(b.column(3)), strict=True):
            if held:
                out.append((held[1], held[2], t if held[0] == k else first[2]))
            if first is None or first[0] != k:
                first = (k, i, t)
            held = None if guest else (k, i, t)
        yield out
    if held:
        yield [(held[1], held[2], first[2])]


def edited(text: str, follower: str) -> str:
    """The last third of the text replaced by the beginning of another."""
    m = len(text) // 3
    return text[: len(text) - m] + follower[:m]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in neighbours(batches):
        if not rows:
            continue
        texts, nexts = [r[1] for r in rows], [r[2] for r in rows]
        extra = [i for i, t in enumerate(nexts) if i + 1 == len(texts) or t is not texts[i + 1]]
        marks = winnow(texts + [nexts[i] for i in extra])
        following = marks[1 : len(texts) + 1]
        for k, i in enumerate(extra):
            following[i] = marks[len(texts) + k]
        own, changed = marks[: len(texts)], [edited(t, n) for t, n in zip(texts, nexts, strict=True)]
        new = winnow(changed)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                spelled(own), spelled(new), pa.array(map(resemblance, own, new), pa.float64()), pa.array(map(resemblance, own, following), pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )
    release()


def with_next(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint beside its edited text's, and its likeness to that and to the next document."""
    bounded_batches(docs.sparkSession)
    rows = ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shuffle_parts(docs.sparkSession))
    return rows.mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents"))


QUERIES = {"op13_document_fingerprints": op13_document_fingerprints}
ORACLES: dict[str, str] = {}
