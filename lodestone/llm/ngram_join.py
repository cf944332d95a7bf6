"""Operator 2, n-gram Jaccard join: count-vector R-trees over lossless blocks.

A document's set is its distinct 5-word shingles; documents link when 100 * |A & B| >= 75 * |A | B|.
A prefix filter bounds the work and the R-tree's bound prunes what meets; both lose no link.

1. `sketch`: one pass yields each document's size, class id (hash of the whole set; equal sets are
   one class from here on), count vector (shingles by hash group), `HUB_KEYS` minimal hashes, and the shingles of
   one class in `SAMPLED`, by which shingles are ordered by rarity. The order decides what work is done, never a result.
2. Hubs: classes that share a minimal hash meet the least class of that key. Pairs whose bound (the summed
   coordinate minima of the count vectors) reaches the overlap needed are verified on whole sets and
   joined into components, so a group of near copies costs a few pairs a member.
3. `blocks`: sets that link share a shingle among the first s - ceil(0.75 s) + 1 of the rarity order and
   two among one more. Classes meet in blocks by those shingles, and by pairs of them where the first is
   held by more than `HOT` classes, so no shingle gathers all its holders. Blocks with equal members are one.
4. Only blocks whose members still lie in different components are searched: their count vectors are
   bulk-loaded into an R-tree, whose bounds (and components) rule out pairs of nodes. Each member's best
   pair is verified first; then, where components are left apart, all pairs that the tree lets through.
   The bound never underestimates, so no link between components is lost.
5. Verified links are joined into components; copies follow their class.

Hubs are salted by their number of members, group copies are collapsed before any pair, joins are left to
adaptive skew splitting, and only the table of frequent shingles (at most `FREQUENT` rows) and a fixed-size bitmap of
classes are broadcast. The bitmap only saves work; a join follows it. A block in one task is a stream of
slices of its tree, but its points (some 100 bytes each) are held together.

Defined results: null texts and texts without words have n_shingles 0 and are linked with nothing;
repeated rows share their component; a null doc_id keeps its row; an empty table gives an empty
result; further columns are ignored by `link` and passed through by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm._shared import bitmap_of, components, discard, materialize, shuffle_parts, table
from lodestone.llm._text import mixed, shingle_sets

FREQUENT, SAMPLED, HOT, LEAF, GROUP_BITS = 1 << 18, 32, 4096, 32, 6
GROUPS = 1 << GROUP_BITS
#: Minimal hashes of a set by which it meets a hub, as odd multipliers.
HUB_KEYS = (3, 5, 7)
#: Members of one hub that a task compares at once, and rows of pairs looked at together.
SLOT, SLICE = 4096, 16_384
#: Least blocks of a class that its rows carry, and rows of blocks that are searched together.
FIRSTS, MEMBERS = 6, 4096
#: Log2 of the bits of the class bitmap (4 MB).
BITMAP = 25
_WIDE = np.uint64(16)


def class_id(s: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(s.tobytes()), np.uint64).view(np.int64))


def group_counts(s: np.ndarray) -> bytes:
    """The set's point: shingles by hash group, two bits each. Groups are the power of two next to the set's size
    (`GROUPS` at least), so the bound is sharp for texts of any length; coarser points are sums of finer.
    A count over 3 is written as 3; the point's last coordinate is what all groups hold beyond that."""
    bits = max(GROUP_BITS, (len(s) - 1).bit_length())
    x = np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 3).astype(np.uint8).reshape(-1, 4)
    return (x[:, 0] << 6 | x[:, 1] << 4 | x[:, 2] << 2 | x[:, 3]).tobytes()


def point(counts: bytes, n: int) -> np.ndarray:
    """The point of a set of n shingles as fine as it is: counts by group, then the rest."""
    x = np.frombuffer(counts, np.uint8)
    x = np.stack([x >> 6, x >> 4 & 3, x >> 2 & 3, x & 3], 1).ravel().astype(np.int32)
    return np.r_[x, n - x.sum()].astype(np.int32)


def coarser(x: np.ndarray, groups: int) -> np.ndarray:
    return x if len(x) == groups + 1 else np.r_[x[:-1].reshape(groups, -1).sum(1), x[-1]]


def bound_of(x: np.ndarray, y: np.ndarray) -> int:
    """An overlap that two sets can't exceed: the summed coordinate minima of their points at the coarser grouping of the two."""
    g = min(len(x), len(y)) - 1
    return int(np.minimum(coarser(x, g), coarser(y, g)).sum())


def prefix_length(n: int) -> int:
    return n - (75 * n + 99) // 100 + 1


def packed(s: np.ndarray) -> bytes:
    """The upper 48 bits of sorted shingle hashes, by which sets are compared."""
    return np.ascontiguousarray((s >> _WIDE).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(x: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view(np.uint64)[:, 0]


_SKETCH = "doc_id long, t1 long, t2 long, n long, cls long, counts binary, keys array<long>, sampled array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, cls, counts, keys, sampled = [], [], [], [], []
        for s in shingle_sets(b.column(3)):
            c = class_id(s) if len(s) else None
            n.append(len(s))
            cls.append(c)
            counts.append(group_counts(s) if len(s) else None)
            keys.append([int(mixed(s * np.uint64(k)).min().view(np.int64)) for k in HUB_KEYS] if len(s) else None)
            sampled.append(s.view(np.int64) if c is not None and c % SAMPLED == 0 else None)
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:3], pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(counts, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sampled, pa.list_(pa.int64()))],
            ["doc_id", "t1", "t2", "n", "cls", "counts", "keys", "sampled"],
        )


class _Prefixes:
    """Yields (block key, class) for the rarest shingles of every set, and for pairs that begin with a hot one."""

    def __init__(self, frequent):
        self.frequent = frequent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = self.frequent.value
        for b in batches:
            keys, owners, held = [], [], 0
            for s in shingle_sets(b.column(0)):
                if len(s) < 3:  # no other set reaches 0.75 of a set this small
                    continue
                cls = class_id(s)
                freq = np.zeros(len(s), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    freq = np.where(known[at] == s, counts[at], 0)
                p = prefix_length(len(s))
                pick = np.lexsort((s, freq))[: p + 1]
                s, freq = s[pick], freq[pick]
                k = min(int(np.searchsorted(freq, HOT, "right")), p)  # sorted: hot shingles are last
                mine = s[:k]
                if k < p:
                    x, y = np.triu_indices(p + 1 - k, 1)
                    mine = np.r_[mine, mixed(s[k + x] * np.uint64(0x9E3779B97F4A7C15) + mixed(s[k + y]))]
                keys.append(mine)
                owners.append(np.full(len(mine), cls, np.int64))
                held += len(mine)
                if held > 500_000:
                    yield self.batch(keys, owners)
                    keys, owners, held = [], [], 0
            if keys:
                yield self.batch(keys, owners)

    @staticmethod
    def batch(keys: list, owners: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], ["key", "cls"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by (key, cls) -> (block, cls) of keys with two or more classes, equal blocks once a batch."""

    def blocks(key: np.ndarray, cls: np.ndarray) -> Iterator[pa.RecordBatch]:
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        key, cls = key[fresh], cls[fresh]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.r_[start, len(key)])
        start, length = start[length > 1], length[length > 1]
        if not len(start):
            return
        total = np.r_[np.uint64(0), np.cumsum(mixed(cls.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)]
        block, one = np.unique((total[start + length] - total[start]) + length.astype(np.uint64), return_index=True)
        s, n = start[one], length[one]
        rows = np.repeat(s - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(block, n).view(np.int64)), pa.array(cls[rows])], ["block", "cls"])

    held: list[tuple[np.ndarray, np.ndarray]] = []  # the key that the last batch ended with
    for b in batches:
        if not b.num_rows:
            continue
        key, cls = b.column(0).to_numpy(), b.column(1).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if last == 0 and (not held or held[0][0][0] == key[0]):
            held.append((key, cls))
            continue
        parts = [*held, (key[:last], cls[:last])]
        yield from blocks(*(np.concatenate(x) for x in zip(*parts)))
        held = [(key[last:], cls[last:])]
    if held:
        yield from blocks(*(np.concatenate(x) for x in zip(*held)))


class _Sets:
    """Rows (t1, text) -> (cls, n, body) of the classes whose bit is set, once per split; only texts whose t1 has its bit set are cut into shingles."""

    def __init__(self, bitmap, texts):
        self.bitmap, self.texts = bitmap, texts

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = self.bitmap.value, set()
        for b in batches:
            slot = b.column(0).to_numpy() & ((1 << BITMAP) - 1)
            wanted = self.texts.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1
            if not wanted.any():
                continue
            out, held = [], 0
            for s in shingle_sets(b.column(1).take(pa.array(np.flatnonzero(wanted)))):
                if not len(s):
                    continue
                cls = class_id(s)
                slot = cls & ((1 << BITMAP) - 1)
                if cls not in seen and bits[slot >> 3] >> (slot & 7) & 1:
                    seen.add(cls)
                    out.append((cls, len(s), packed(s)))
                    held += len(s)
                    if held > 500_000:
                        yield self.batch(out)
                        out, held = [], 0
            if out:
                yield self.batch(out)

    @staticmethod
    def batch(out: list) -> pa.RecordBatch:
        cls, n, body = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(body, pa.binary())], ["cls", "n", "body"])


class RTree:
    """Bulk-loaded R-trees over count vectors, one for each block of `block` (ascending; by default all are one). Nodes keep upper corners, the range of sizes and that of
    components, as the overlap bound is the sum of coordinate minima of upper corners. The trees grow and are searched together, so blocks of a few members cost no calls of their own."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, comp: np.ndarray | None = None, block: np.ndarray | None = None):
        comp = np.arange(len(sizes)) if comp is None else comp
        block = np.zeros(len(sizes), np.int64) if block is None else block
        self.order = np.lexsort((counts.argmax(1), sizes, comp, block))
        n, c, own = sizes[self.order], comp[self.order], block[self.order]
        self.levels = [(counts[self.order], n, n, c, c)]
        self.children: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        trees = len(np.unique(own))
        while len(own) > trees:
            hi, least, most, lo_c, hi_c = self.levels[-1]
            start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            cut = np.flatnonzero((np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)]))) % LEAF == 0)
            self.levels.append((np.maximum.reduceat(hi, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut), np.minimum.reduceat(lo_c, cut), np.maximum.reduceat(hi_c, cut)))
            self.children.append((cut, np.diff(np.r_[cut, len(own)])))
            own = own[cut]

    def slices(self) -> Iterator[np.ndarray]:
        """All pairs (i, j) of indices from different components of a block whose bound reaches the overlap that a link needs."""
        roots = np.arange(len(self.levels[-1][0]))
        todo = [(len(self.levels) - 1, np.stack([roots, roots], 1))] if len(roots) else []
        while todo:
            depth, front = todo.pop()
            hi, least, most, lo_c, hi_c = self.levels[depth]
            i, j = front[:, 0], front[:, 1]
            ok = (4 * most[i] >= 3 * least[j]) & (4 * most[j] >= 3 * least[i])
            ok &= (lo_c[i] != hi_c[i]) | (lo_c[j] != hi_c[j]) | (lo_c[i] != lo_c[j])
            if not depth:
                ok &= i < j
            front = front[ok]
            i, j = front[:, 0], front[:, 1]
            front = front[7 * np.minimum(hi[i], hi[j]).sum(1, dtype=np.int64) >= 3 * (least[i] + least[j])]
            if not depth:
                if len(front):
                    yield self.order[front]
                continue
            first, many = self.children[depth]
            total = np.cumsum(many[front[:, 0]] * many[front[:, 1]])
            lo = 0
            while lo < len(front):
                upto = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SLICE, "right")))
                f = front[lo:upto]
                n, m = many[f[:, 0]] * many[f[:, 1]], many[f[:, 1]]
                at, pair = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(np.arange(len(f)), n)
                i, j = first[f[pair, 0]] + at // m[pair], first[f[pair, 1]] + at % m[pair]
                ok = i <= j
                todo.append((depth - 1, np.stack([i[ok], j[ok]], 1)))
                lo = upto

    def pairs(self) -> np.ndarray:
        return np.concatenate([np.empty((0, 2), np.int64), *self.slices()])


#: By byte: the sum of its four counts.
_FOUR = np.array([(x >> 6) + (x >> 4 & 3) + (x >> 2 & 3) + (x & 3) for x in range(256)], np.uint8)


def coarse_points(counts: pa.Array, n: np.ndarray) -> np.ndarray:
    """The points of sets of n shingles at `GROUPS` groups, a row a set: `coarser(point(...), GROUPS)`."""
    _, offsets, data = counts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[counts.offset : counts.offset + len(counts) + 1]
    data, length = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), np.diff(offsets)
    out = np.zeros((len(n), GROUPS + 1), np.int32 if len(n) and n.max() >= 1 << 15 else np.int16)
    for size in np.unique(length).tolist():
        rows = np.flatnonzero(length == size)
        x = data[offsets[rows][:, None] + np.arange(size)]
        x = _FOUR[x] if size >= GROUPS else np.stack([x >> 6, x >> 4 & 3, x >> 2 & 3, x & 3], 2)
        out[rows, :-1] = x.reshape(len(rows), GROUPS, -1).sum(2, dtype=out.dtype)
    out[:, -1] = n - out[:, :-1].sum(1, dtype=np.int64)
    return out


class _Search:
    """Rows (block, cls, n, counts, comp, firsts) sorted by block -> pairs of members of different components that the
    R-tree lets through: "all" of them, or each member's best-bounded one ("nearest").

    `firsts` are the class's `FIRSTS` least blocks. Of the blocks in which two classes meet only the least looks at
    them, as far as these lists tell: a least common block in both lists is the least of all. Blocks are searched some `MEMBERS` rows together.
    """

    def __init__(self, mode: str):
        self.mode = mode

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        self.points: dict[int, np.ndarray] = {}
        self.sent: set[tuple[int, int]] = set()
        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows < MEMBERS and sum(x.nbytes for x in held) < 4 << 20:
                continue
            t = pa.Table.from_batches(held)
            block = t.column(0).to_numpy()
            last = int(np.searchsorted(block[::-1] != block[-1], True)) if block[0] != block[-1] else len(block)  # rows of the block that may go on
            if last < len(block):
                yield from self.rows(self.solve(t.slice(0, len(block) - last)))
            held, rows = t.slice(len(block) - last).to_batches(), last
        if held:
            yield from self.rows(self.solve(pa.Table.from_batches(held)))

    def rows(self, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Pairs not sent lately, the greater class first."""
        for x, y in found:
            pairs = [p for p in zip(np.maximum(x, y).tolist(), np.minimum(x, y).tolist()) if p not in self.sent]
            if len(self.sent) > 200_000:
                self.sent.clear()
            self.sent.update(pairs)
            if pairs:
                a, b = zip(*dict.fromkeys(pairs))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def point(self, cls: int, n: int, counts: pa.Scalar) -> np.ndarray:
        """The class's point as fine as it is, kept for the next pairs."""
        x = self.points.get(cls)
        if x is None:
            if len(self.points) > 10_000:
                self.points.clear()
            fine = point(counts.as_py(), n)
            x = self.points[cls] = fine.astype(np.int16) if n < 1 << 15 else fine
        return x

    def solve(self, t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        block, cls, n, counts, comp, firsts = (c.chunk(0) for c in t.combine_chunks().columns)
        block, cls, n, comp = (c.to_numpy() for c in (block, cls, n, comp))
        length = firsts.value_lengths().to_numpy()
        first = (np.cumsum(length) - length)[:, None]
        seen = firsts.flatten().to_numpy()[first + np.where(np.arange(FIRSTS) < length[:, None], np.arange(FIRSTS), 0)]
        best, mate = np.zeros(len(cls)), np.full(len(cls), -1)
        for p in RTree(coarse_points(counts, n), n, comp, block).slices():
            i, j = p[:, 0], p[:, 1]
            both = (seen[i][:, :, None] == seen[j][:, None, :]).any(2)
            least = np.where(both, seen[i], np.iinfo(np.int64).max).min(1)
            p = p[~both.any(1) | (least == block[i])]
            fine = {x: self.point(int(cls[x]), int(n[x]), counts[x]) for x in np.unique(p).tolist()}
            share = np.array([bound_of(fine[i], fine[j]) for i, j in p.tolist()]) / np.maximum(n[p[:, 0]] + n[p[:, 1]], 1)
            ok = 7 * share >= 3 - 1e-9
            p, share = p[ok], share[ok]
            if self.mode == "all":
                yield cls[p[:, 0]], cls[p[:, 1]]
                continue
            for k in (0, 1):
                order = np.argsort(share, kind="stable")  # the greatest share is written last
                i, j, x = p[order, k], p[order, 1 - k], share[order]
                better = x > best[i]
                best[i[better]], mate[i[better]] = x[better], j[better]
        has = np.flatnonzero(mate >= 0)
        yield cls[has], cls[mate[has]]


class _Compare:
    """Rows (hub, slot, side, cls, n, body) sorted so that a hub comes before its members -> pairs (a, b) that `test` passes."""

    def __init__(self, test: Callable, read: Callable):
        self.test, self.read = test, read

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, size, mine = None, 0, None
        for b in batches:
            a, c = [], []
            for h, side, cls, n, body in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), b.column(5)):
                if side == 0:
                    hub, size, mine = h, n, self.read(body.as_py(), n)
                elif h == hub and self.test(mine, size, self.read(body.as_py(), n), n):
                    a.append(cls)
                    c.append(h)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])


def _bound_passes(x: np.ndarray, nx: int, y: np.ndarray, ny: int) -> bool:
    return 7 * bound_of(x, y) >= 3 * (nx + ny)


def _linked(x: np.ndarray, nx: int, y: np.ndarray, ny: int) -> bool:
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    return 7 * int((x[at] == y).sum()) >= 3 * (nx + ny)


def compared(pairs: DataFrame, bodies: DataFrame, test: Callable, read: Callable) -> DataFrame:
    """The pairs (a, b) that `test` passes, given `bodies(cls, n, body)`. Members travel to their hub b, dealt
    to one copy of it per `SLOT` members, so a hub of any size fills no task."""
    members = pairs.groupBy("b").agg(F.count("*").alias("m")).withColumn("slots", F.ceil(F.col("m") / SLOT).cast("int"))
    asked = pairs.join(members, "b").select(F.col("a").alias("cls"), F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), "slots").cast("int").alias("slot"), F.lit(1).alias("side"))
    own = members.select(F.col("b").alias("cls"), F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(0).alias("side"))
    sent = asked.unionByName(own).join(bodies, "cls").select("hub", "slot", "side", "cls", "n", "body")
    return sent.repartition(shuffle_parts(pairs.sparkSession), "hub", "slot").sortWithinPartitions("hub", "slot", "side").mapInArrow(_Compare(test, read), "a long, b long")


def verified(pairs: DataFrame, text: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by the whole sets of their classes, which are made again from `text(t1, text)`: from those texts alone that stand for
    a class of a pair in `points(cls, t1)`."""
    spark = text.sparkSession
    asked = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    bitmap = bitmap_of(asked.withColumnRenamed("cls", "v"), spark, BITMAP)
    texts = bitmap_of(points.join(asked, "cls", "left_semi").select(F.col("t1").alias("v")), spark, BITMAP)
    sets = text.mapInArrow(_Sets(bitmap, texts), "cls long, n long, body binary").groupBy("cls").agg(F.first("n").alias("n"), F.first("body").alias("body"))
    return materialize(compared(pairs, sets, _linked, unpacked), "ngram-links")


def in_split_blocks(blocks: DataFrame, comp: DataFrame, least: int) -> DataFrame:
    """(block, cls, comp) of blocks with `least` members or more in more than one component."""
    by = Window.partitionBy("block")
    labelled = blocks.join(comp, F.col("cls") == F.col("node"), "left").select("block", "cls", F.coalesce("component", "cls").alias("comp"))
    labelled = labelled.withColumns({"lo": F.min("comp").over(by), "hi": F.max("comp").over(by), "m": F.count("*").over(by)})
    return materialize(labelled.where(f"lo < hi AND m >= {least}").select("block", "cls", "comp"), "ngram-split")


def placed_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, n, comp) for every row of `docs`: two hashes of its text, its set's size and the component of its class (null: no words)."""
    spark = docs.sparkSession
    text = docs.select("text")
    keyed = docs.select(F.col("doc_id").cast("long"), *text_keys(F.col("text")), "text")
    known_text = keyed.select("t1", "text")
    sketched = materialize(keyed.mapInArrow(_sketch, _SKETCH), "ngram-sketch")
    sample = sketched.where("sampled IS NOT NULL").groupBy("cls").agg(F.first("sampled").alias("sampled")).select(F.explode("sampled").alias("h"))
    top = sample.groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    known = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    frequent = spark.sparkContext.broadcast((known[order], top["n"].to_numpy()[order] * SAMPLED))
    points = materialize(sketched.where("cls IS NOT NULL").groupBy("cls").agg(*[F.first(c).alias(c) for c in ("n", "counts", "keys")], F.min("t1").alias("t1")), "ngram-points")

    met = points.select("cls", "n", F.posexplode("keys").alias("k", "key"))
    hubs = met.groupBy("k", "key").agg(F.min(F.struct("cls", "n")).alias("hub"), F.count("*").alias("m")).where("m > 1")
    near = met.join(hubs, ["k", "key"]).where("cls <> hub.cls AND 4 * n >= 3 * hub.n AND 4 * hub.n >= 3 * n")
    bodies = points.select("cls", "n", F.col("counts").alias("body"))
    pairs = materialize(compared(near.select(F.col("cls").alias("a"), F.col("hub.cls").alias("b")).distinct(), bodies, _bound_passes, point), "ngram-pairs")
    links, tested, scratch = verified(pairs, known_text, points), pairs, [sketched, points, pairs]
    scratch.append(links)
    comp = components(links, "ngram")

    total = points.agg(F.sum("n")).first()[0] or 0
    parts = max(shuffle_parts(spark), int(total * 0.26 / 500_000) + 1)
    postings = text.mapInArrow(_Prefixes(frequent), "key long, cls long").repartition(parts, "key").sortWithinPartitions("key", "cls")
    blocks = postings.mapInArrow(_meet, "block long, cls long").distinct()
    for mode, least in (("nearest", 2), ("all", 3)):  # a block of two is done by its members' best pairs
        blocks = in_split_blocks(blocks, comp, least)
        firsts = blocks.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list("block")), 1, FIRSTS).alias("firsts"))  # as many as a prefix at most
        left = blocks.join(firsts.join(bodies, "cls"), "cls").select("block", "cls", "n", F.col("body").alias("counts"), "comp", "firsts")
        found = left.repartition(parts, "block").sortWithinPartitions("block", "cls").mapInArrow(_Search(mode), "a long, b long").distinct()
        pairs = materialize(found.join(tested, ["a", "b"], "left_anti"), "ngram-pairs")
        scratch += [blocks, pairs]
        blocks = blocks.drop("comp")
        if pairs.isEmpty():
            continue
        more = verified(pairs, known_text, points)
        links, tested = links.unionByName(more), tested.unionByName(pairs)
        scratch.append(more)
        comp = components(links, "ngram")
    out = materialize(sketched.join(comp, F.col("cls") == F.col("node"), "left").select("doc_id", "t1", "t2", "n", F.coalesce("component", "cls").alias("comp")), "ngram-placed")
    discard(*scratch)
    return out


def text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(k), text).alias(f"t{k}") for k in (1, 2)]


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`."""
    placed = placed_rows(docs)
    smallest = placed.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("first_id"))
    return placed.join(smallest, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each component: of those with the smallest doc_id (null last) the one whose text's hash
    is least; repeated rows collapse. Rows without words stay, each. Documents that share a doc_id
    but don't link are documents of their own."""
    placed = placed_rows(docs).where("comp IS NOT NULL")
    first = placed.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")).alias("x"))
    keep = first.select(F.col("x.doc_id").alias("g_id"), "x.t1", "x.t2")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("g_row"), F.col("doc_id").cast("long").alias("g_id"), *text_keys(F.col("text")), F.col("text").alias("g_text"))
    worded = F.coalesce(F.col("g_text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    some = rows.where(worded).drop("g_text").join(keep.withColumnRenamed("g_id", "k_id"), ["t1", "t2"]).where(F.col("g_id").eqNullSafe(F.col("k_id"))).dropDuplicates(["t1", "t2"])
    return some.select("g_row").unionByName(rows.where(~worded).select("g_row")).select("g_row.*")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


QUERIES = {"op2_ngram_join": op2_ngram_join}
ORACLES: dict[str, str] = {}
