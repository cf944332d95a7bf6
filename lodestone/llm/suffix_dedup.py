"""Operator 10, suffix-array dedup: common-prefix-aware distributed merge sort of sampled suffixes.

A byte goes if a `LENGTH`-byte string that covers it starts anywhere else. Every such string owns one
suffix, which begins at the least 8-byte hash among its first `WINDOW` positions: equal strings own equal
suffixes at equal offsets, so sampling loses nothing, and only about one suffix in a hundred is sorted.

1. Suffixes are counted by the hash of the bytes that all their strings share (`SHARED` bytes);
   those alone in the corpus are left out through a fixed-size bitmap (false positives only cost work).
2. Each batch sorts its remaining suffixes with their left contexts, front-codes them (common prefix
   length, tail) and sends one run a part. A part merges its runs in a loser tree that carries
   common-prefix lengths, so no known prefix is compared again, and the lengths between neighbours come
   out of the merge. Within a group of suffixes that share `SHARED` bytes they and the common left
   contexts tell for which strings another start exists.
3. Groups of more than `HOT` suffixes (a passage that a third of all documents share) would land in one
   task; their strings are counted by 64-bit hashes, summed before the shuffle, instead.
4. Passages of more than 50 words are often shorter than `LENGTH` bytes, so `n_passages` says, beside the bytes removed,
   how many sampled strings of `SIDE` words (A-Z lower-cased) start elsewhere too. Every `PASSAGE` words own a place, that of their least
   hash of `GRAM_WORDS` words, and the `SIDE` words that begin or end with it lie in the passage: none of `PASSAGE` words
   is missed, and none under `SIDE` words counts. Places whose hash is alone are left out by the same bitmap.
5. Spans return to their texts by 128-bit text hashes, so copies are computed alike; texts without a
   span never leave their task.

Defined results: null and empty texts have 0 bytes and nothing to remove; texts under `LENGTH` bytes
are kept whole; repeated rows remove each other; null doc_ids pass through; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._shared import bitmap_of, discard, materialize, shuffle_parts, table
from lodestone.llm._text import _BYTES, _POWERS, CHUNK, chunks, mixed, utf8, word_hashes

LENGTH, WINDOW, GRAM, HOT = 400, 256, 8, 2048
PASSAGE, SIDE, GRAM_WORDS, _WORDS = 51, 41, 31, np.uint64(0x5851F42D4C957F2D)
SHARED = LENGTH - WINDOW
#: Bytes of texts that a Python worker gathers before it hands rows on.
SLICE = 4 << 20
#: Log2 of the bits of the bitmaps (8 MB).
BITMAP = 26
_CASED = _BYTES.copy()
_CASED[65:91] = np.random.default_rng(7).integers(1, 1 << 63, 26, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_PLACE = np.uint64((1 << 28) - 1)


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For every place the place of the least hash among the `width` that begin there, the leftmost of equal ones."""
    h = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)  # hash above, place below
    rows = np.r_[h, np.full(-len(h) % width + width, ~np.uint64(0))].reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(behind[: len(h)], ahead[width - 1 : width - 1 + len(h)]) & _PLACE).astype(np.int64)


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + n[0] - 1, and so on."""
    return np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of adjoining texts: keys of the sampled places; and (text, key of its place, hash) of every string of `SIDE` words beside one."""
    w, first = word_hashes(data, offsets)
    n = np.diff(first) - PASSAGE + 1
    long = np.flatnonzero(n > 0)
    if not len(long):
        none = np.empty(0, np.uint64)
        return none, none.view(np.int64), none, none
    up, down = _POWERS.get(max(len(w), CHUNK))
    total = np.r_[np.uint64(0), np.cumsum(w * up[: len(w)], dtype=np.uint64)]
    of = lambda start, k: mixed((total[start + k] - total[start]) * down[start])
    grams = of(np.arange(len(w) - GRAM_WORDS + 1), GRAM_WORDS)
    at = np.unique(least_places(grams, PASSAGE - GRAM_WORDS + 1)[ranges(first[:-1][long], n[long])])
    key = grams[at] ^ _WORDS
    start, place = np.r_[at, at + GRAM_WORDS - SIDE], np.r_[np.arange(len(at)), np.arange(len(at))]
    text = np.searchsorted(first, at, "right") - 1
    ok = (start >= first[text[place]]) & (start + SIDE <= first[text[place] + 1])
    start, one = np.unique(start[ok], return_index=True)
    place = place[ok][one]
    return key, text[place], key[place], of(start, SIDE)


def sampled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, first, last): the sampled suffixes of adjoining texts and the range of string starts that own each."""
    size = np.diff(offsets)
    long = size >= LENGTH
    if not long.any():
        none = np.empty(0, np.int64)
        return none, none, none
    grams = np.ndarray((len(data) - GRAM + 1,), "<u8", data.tobytes(), 0, (1,))
    least = least_places(mixed(grams * np.uint64(0x9E3779B97F4A7C15)), WINDOW)
    starts = ranges(offsets[:-1][long], size[long] - LENGTH + 1)
    at = least[starts]
    cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[cut], starts[cut], starts[np.r_[cut[1:] - 1, len(starts) - 1]]


class Hasher:
    """Hashes of byte ranges of one chunk from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _POWERS.get(max(len(data), CHUNK))
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CASED[data] * up[: len(data)], out=self.total[1:])

    def of(self, start: np.ndarray, length: int) -> np.ndarray:
        return mixed((self.total[start + length] - self.total[start]) * self.down[start])


def _pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    data, offsets = utf8(column)
    for lo, hi in chunks(offsets):
        own = offsets[lo : hi + 1]
        yield data[own[0] : own[-1]], own - own[0], lo


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = []
        for d, o, _ in _pieces(b.column(0)):
            s = sampled(d, o)[0]
            if len(s):
                found.append(Hasher(d).of(s, SHARED))
            found.append(passages(d, o)[0])
        found = [x for x in found if len(x)]
        if found:
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])


def halves(x: bytes) -> tuple[int, int]:
    v = np.frombuffer(xxhash.xxh3_128_digest(x), np.int64)
    return int(v[0]), int(v[1])


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, of which `known` bytes are known to agree."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    lo, hi = known, n
    while hi - lo > 16:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    while a[lo] == b[lo]:
        lo += 1
    return lo


def encode_run(entries: list[tuple[bytes, bytes, int]]) -> bytes:
    """Front-coded run of sorted (suffix, left context, count)."""
    head, body, last = [], [], b""
    for right, left, n in entries:
        k = common(last, right)
        head += (k, len(right) - k, len(left), n)
        body += (right[k:], left)
        last = right
    return zstandard.compress(np.array([len(entries), *head], np.int32).tobytes() + b"".join(body), 1)


def decode_run(blob: bytes) -> Iterator[tuple[bytes, bytes, int, int]]:
    """(suffix, left context, count, common prefix with the suffix before) in order."""
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int32, 1)[0])
    head = np.frombuffer(raw, np.int32, 4 * n, 4).tolist()
    at, right = 4 + 16 * n, b""
    for i in range(0, 4 * n, 4):
        k, tail, left, count = head[i : i + 4]
        right = right[:k] + raw[at : at + tail]
        yield right, raw[at + tail : at + tail + left], count, k
        at += tail + left


def merge_runs(runs: list[Iterator[tuple[bytes, bytes, int, int]]]) -> Iterator[tuple[bytes, bytes, int, int]]:
    """Merge sorted runs in a loser tree. Every candidate carries the length it shares with the last winner,
    so of two candidates the one that shares more is smaller, and only equal lengths are compared further."""
    width = 1
    while width < max(len(runs), 1):
        width *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (width - len(runs))
    shared = [0] * width
    loser = [0] * width

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length is then with the winner."""
        if heads[a] is None:
            return b, a
        if heads[b] is None:
            return a, b
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = heads[a][0], heads[b][0]
        k = common(x, y, shared[a])
        if k == len(x) or (k < len(y) and x[k] < y[k]):
            shared[b] = k
            return a, b
        shared[a] = k
        return b, a

    def build(node: int) -> int:
        if node >= width:
            return node - width
        winner, loser[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    top = build(1) if width > 1 else 0
    while heads[top] is not None:
        right, left, n, _ = heads[top]
        yield right, left, n, shared[top]
        heads[top] = next(runs[top], None)
        # the run's own code tells what its next suffix shares with the one just written
        shared[top] = heads[top][3] if heads[top] is not None else 0
        node = (top + width) // 2
        while node:
            top, loser[node] = play(top, loser[node])
            node //= 2


def repeated_starts(group: list[tuple[bytes, bytes, int, int]]) -> Iterator[tuple[bytes, bytes, list[tuple[int, int]]]]:
    """For suffixes of a group (sorted, with neighbours' common prefixes): ranges of offsets whose string starts elsewhere too.

    The string at offset o covers o bytes left of the suffix and LENGTH - o of it. A suffix owns the
    offsets LENGTH - len(suffix) .. len(left).
    """
    merged: dict[tuple[bytes, bytes], int] = {}
    first: dict[tuple[bytes, bytes], int] = {}
    for i, (right, left, n, _) in enumerate(group):
        merged[right, left] = merged.get((right, left), 0) + n
        first.setdefault((right, left), i)
    keys = list(merged)
    at = np.array([first[k] for k in keys])
    if len(keys) > 1:
        lcp = np.array([g[3] for g in group])
        rights = np.zeros((len(keys), len(keys)), np.int16)
        for i in range(len(keys)):
            if i + 1 < len(keys):
                run = np.minimum.accumulate(lcp[at[i] + 1 : at[-1] + 1])
                rights[i, i + 1 :] = rights[i + 1 :, i] = run[at[i + 1 :] - at[i] - 1]
        back = [left[::-1] for _, left in keys]
        order = sorted(range(len(keys)), key=back.__getitem__)
        near = np.array([common(back[x], back[y]) for x, y in zip(order, order[1:])])
        lefts = np.zeros_like(rights)
        for i in range(len(keys) - 1):
            run = np.minimum.accumulate(near[i:])
            lefts[order[i], order[i + 1 :]] = run
            lefts[order[i + 1 :], order[i]] = run
    for i, (right, left) in enumerate(keys):
        lo, hi = LENGTH - len(right), len(left)
        if merged[right, left] > 1:
            yield right, left, [(lo, hi)]
        elif len(keys) > 1:
            a, b = np.maximum(LENGTH - rights[i], lo), np.minimum(lefts[i], hi)
            a, b = np.delete(a, i), np.delete(b, i)
            spans = sorted({(int(x), int(y)) for x, y in zip(a[a <= b], b[a <= b])})
            out: list[tuple[int, int]] = []
            for x, y in spans:
                if out and x <= out[-1][1] + 1:
                    out[-1] = (out[-1][0], max(out[-1][1], y))
                else:
                    out.append((x, y))
            if out:
                yield right, left, out


_FOUND = pa.schema([("part", pa.int64()), ("run", pa.binary()), ("c1", pa.int64()), ("c2", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("at", pa.int64()), ("low", pa.int32()), ("n", pa.int64()), ("hashes", pa.list_(pa.int64())), ("w", pa.int64())])
_FOUND_DDL = "part long, run binary, c1 long, c2 long, t1 long, t2 long, at long, low int, n long, hashes array<long>, w long"


class _Runs:
    """Rows of four kinds: sorted runs (part, run), places of contexts (c1, c2, t1, t2, at), hashes of hot contexts, strings of words (w, t1, n)."""

    def __init__(self, bitmap, hot, parts: int):
        self.bitmap, self.hot, self.parts = bitmap, hot, parts

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = self.bitmap.value, self.hot.value
        for b in batches:
            runs: dict[int, dict[tuple[bytes, bytes], int]] = {}
            places, counted, texts = [], {}, set()
            for d, o, _ in _pieces(b.column(0)):
                yield from self.strings(d, o, bits)
                s, first, last = sampled(d, o)
                if not len(s):
                    continue
                hasher, raw = Hasher(d), d.tobytes()
                key = hasher.of(s, SHARED)
                keep = self.set_in(bits, key)
                s, first, last, key = s[keep], first[keep], last[keep], key[keep]
                is_hot = np.isin(key, hot)
                owner = np.searchsorted(o, s, "right") - 1
                text, again = (-1, 0, 0), False
                for i, (x, f, e, w, k, h) in enumerate(zip(s.tolist(), first.tolist(), last.tolist(), owner.tolist(), key.tolist(), is_hot.tolist())):
                    if w != text[0]:
                        text = (w, *halves(raw[o[w] : o[w + 1]]))
                        again = text[1:] in texts
                        texts.add(text[1:])
                    left, right = raw[f:x], raw[x : e + LENGTH]
                    c = halves(left + b"\0" + right + len(left).to_bytes(2, "little"))
                    if not again:
                        places.append((*c, text[1], text[2], int(x - o[w])))
                    if h:
                        if c in counted:
                            counted[c][0] += 1
                        else:
                            counted[c] = [1, x - e, hasher.of(np.arange(e, f - 1, -1), LENGTH).view(np.int64)]
                    else:
                        run = runs.setdefault(k % self.parts, {})
                        run[right, left] = run.get((right, left), 0) + 1
            yield from self.rows(runs, counted, places)

    def strings(self, d: np.ndarray, o: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, text, key, w = passages(d, o)
        keep = self.set_in(bits, key)
        text, w = text[keep], w[keep]
        if not len(text):
            return
        raw, t = d.tobytes(), np.zeros(len(o), np.int64)
        for i in np.unique(text).tolist():
            t[i] = halves(raw[o[i] : o[i + 1]])[0]
        w, t = w.view(np.int64), t[text]
        _, one, n = np.unique(mixed(w.view(np.uint64) + t.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
        cols = {"w": pa.array(w[one]), "t1": pa.array(t[one]), "n": pa.array(n)}
        yield pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(len(one), f.type)) for f in _FOUND], schema=_FOUND)

    @staticmethod
    def set_in(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
        slot = key & np.uint64((1 << BITMAP) - 1)
        return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def rows(self, runs: dict, counted: dict, places: list) -> Iterator[pa.RecordBatch]:
        empty = lambda n, name: pa.nulls(n, _FOUND.field(name).type)
        batch = lambda rows, **c: pa.RecordBatch.from_arrays([c.get(f.name, empty(rows, f.name)) for f in _FOUND], schema=_FOUND)
        for p, run in runs.items():
            blob = encode_run(sorted((r, left, n) for (r, left), n in run.items()))
            yield batch(1, part=pa.array([p], pa.int64()), run=pa.array([blob], pa.binary()))
        items = list(counted.items())
        for lo in range(0, len(items), 2000):
            some = items[lo : lo + 2000]
            size = np.r_[0, np.cumsum([len(h) for _, (_, _, h) in some])].astype(np.int32)
            hashes = pa.ListArray.from_arrays(pa.array(size), pa.array(np.concatenate([h for _, (_, _, h) in some])))
            c1, c2 = (pa.array([c[k] for c, _ in some], pa.int64()) for k in (0, 1))
            yield batch(len(some), c1=c1, c2=c2, low=pa.array([x[1] for _, x in some], pa.int32()), n=pa.array([x[0] for _, x in some], pa.int64()), hashes=hashes)
        if places:
            c1, c2, t1, t2, at = (pa.array(x, pa.int64()) for x in zip(*places))
            yield batch(len(places), c1=c1, c2=c2, t1=t1, t2=t2, at=at)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by part -> (c1, c2, lo, hi): offsets of a context's strings that start elsewhere too."""

    def solve(blobs: list[bytes]) -> list[tuple[int, int, int, int]]:
        out: list[tuple[int, int, int, int]] = []

        def close(group: list) -> None:
            if len(group) > 1 or group and group[0][2] > 1:
                for right, left, spans in repeated_starts(group):
                    c = halves(left + b"\0" + right + len(left).to_bytes(2, "little"))
                    out.extend((*c, lo, hi) for lo, hi in spans)

        group: list = []
        for entry in merge_runs([decode_run(x) for x in blobs]):
            if group and entry[3] < SHARED:
                close(group)
                group = []
            group.append(entry)
        close(group)
        return out

    def rows(found: list) -> pa.RecordBatch:
        c1, c2, lo, hi = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["c1", "c2", "lo", "hi"])

    part, blobs = None, []
    for b in batches:
        for p, run in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if p != part and blobs:
                if found := solve(blobs):
                    yield rows(found)
                blobs = []
            part = p
            blobs.append(run)
    if blobs and (found := solve(blobs)):
        yield rows(found)


class _Whole:
    """(doc_id, n_bytes, t1, t2, sha, body): the digest of texts without spans, the bytes of the others."""

    def __init__(self, bitmap):
        self.bitmap = bitmap

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = self.bitmap.value
        for b in batches:
            out, held = [], 0
            for i, (doc_id, text) in enumerate(zip(b.column(0), b.column(1)), 1):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                t1, t2 = halves(raw)
                slot = t1 & ((1 << BITMAP) - 1)
                flagged = len(raw) >= LENGTH and bits[slot >> 3] >> (slot & 7) & 1
                out.append((doc_id.as_py(), len(raw), t1, t2, None if flagged else hashlib.sha256(raw).hexdigest(), raw if flagged else None))
                held += len(raw) if flagged else 0
                if held > SLICE or i == b.num_rows:
                    doc, n, t1, t2, sha, body = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(sha, pa.string()), pa.array(body, pa.binary())], ["doc_id", "n_bytes", "t1", "t2", "sha", "body"])
                    out, held = [], 0


def cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """`raw` without the spans, the bytes removed, and the maximal runs removed."""
    kept, at, removed, runs, end = [], 0, 0, 0, -1
    for s, e in sorted(spans):
        if s > end:
            runs += 1
        s = max(s, at)
        if e > s:
            kept.append(raw[at:s])
            removed += e - s
            at = e
        end = max(end, e)
    kept.append(raw[at:])
    return b"".join(kept), removed, runs


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for i, (doc_id, n, body, spans, t1) in enumerate(zip(*b.columns), 1):
                kept, removed, runs = cut(body.as_py(), [(x["s"], x["e"]) for x in spans.as_py() or []])
                out.append((doc_id.as_py(), n.as_py(), removed, runs, hashlib.sha256(kept).hexdigest(), kept if with_text else None, t1.as_py()))
                held += len(kept) if with_text else 0
                if held > SLICE or i == b.num_rows:
                    doc, n, removed, runs, sha, kept, t1 = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()), pa.array(t1, pa.int64())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "t1"])
                    out, held = [], 0

    return run


def joined_ranges(ranges: Column) -> Column:
    """Ranges (lo, hi) of whole offsets with overlapping and adjoining ones joined."""
    pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(pair(last["lo"], F.greatest(last["hi"], x["hi"]))))
        return F.when(x["lo"] <= last["hi"] + 1, longer).otherwise(F.array_append(done, x))

    ordered = F.array_sort(ranges)
    return F.aggregate(F.slice(ordered, 2, 1 << 30), F.slice(ordered, 1, 1), add)


def repeated(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(t1, t2, spans): byte ranges to remove, by 128-bit hash of the whole text, and (t1, n_passages). `text` has one string column."""
    spark = text.sparkSession
    shared = materialize(text.mapInArrow(_count_shared, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "suffix-shared")
    hot_rows = shared.where(F.col("n") > HOT).orderBy(F.desc("n"), "h").limit(1 << 20).select("h").toArrow()
    hot = spark.sparkContext.broadcast(np.sort(hot_rows["h"].to_numpy().view(np.uint64)))
    total = shared.agg(F.sum("n")).first()[0] or 0
    parts = max(shuffle_parts(spark), total // 20_000 + 1)
    found = materialize(text.mapInArrow(_Runs(bitmap_of(shared.select(F.col("h").alias("v")), spark, BITMAP), hot, parts), _FOUND_DDL), "suffix-runs")
    cold = found.where("run IS NOT NULL").select("part", "run").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_merge, "c1 long, c2 long, lo int, hi int")
    strings = found.where("hashes IS NOT NULL").groupBy("c1", "c2").agg(F.sum("n").alias("n"), F.first("low").alias("low"), F.first("hashes").alias("hashes"))
    strings = strings.select("c1", "c2", "n", "low", F.posexplode("hashes").alias("i", "h"))
    twice = strings.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    warm = strings.join(twice, "h", "left_semi").select("c1", "c2", (F.col("low") + F.col("i")).alias("lo"), (F.col("low") + F.col("i")).alias("hi"))
    spans = cold.unionByName(warm).groupBy("c1", "c2").agg(joined_ranges(F.collect_list(F.struct("lo", "hi"))).alias("x"))  # at most WINDOW offsets
    places = found.where("at IS NOT NULL").select("c1", "c2", "t1", "t2", "at").distinct()
    placed = places.join(spans, ["c1", "c2"]).select("t1", "t2", F.explode(F.transform("x", lambda x: F.struct((F.col("at") - x["hi"]).alias("s"), (F.col("at") - x["lo"] + LENGTH).alias("e")))).alias("x"))
    made = materialize(placed.groupBy("t1", "t2").agg(F.collect_list("x").alias("spans")), "suffix-spans")
    windows = found.where("w IS NOT NULL").groupBy("w", "t1").agg(F.sum("n").alias("n"))
    often = windows.groupBy("w").agg(F.sum("n").alias("m")).where("m > 1").select("w")
    per_text = windows.join(often, "w", "left_semi").groupBy("t1").agg(F.count("*").alias("n_passages"))
    per_text = materialize(per_text, "suffix-passages")
    discard(shared, found)
    return made, per_text


def remove(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages and kept of every row of `docs`.

    n_passages counts different sampled strings of `SIDE` words of the text that start elsewhere too. kept holds the remaining bytes; it is null where nothing goes, and everywhere unless `with_text`.
    """
    spark = docs.sparkSession
    spans, passages = repeated(docs.select("text"))
    bitmap = bitmap_of(spans.select(F.col("t1").alias("v")), spark, BITMAP)
    rows = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_Whole(bitmap), "doc_id long, n_bytes long, t1 long, t2 long, sha string, body binary"), "suffix-rows")
    whole = rows.where("body IS NULL").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"), "t1")
    cut_rows = rows.where("body IS NOT NULL").join(spans, ["t1", "t2"], "left").select("doc_id", "n_bytes", "body", "spans", "t1")
    every = whole.unionByName(cut_rows.mapInArrow(_cut(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, t1 long"))
    return every.join(passages, "t1", "left").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"), "kept")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
ORACLES: dict[str, str] = {}
