"""Operator 3, SentencePiece encoding and decoding with Gumbel top-k sampling without replacement.

Encoding is the library's own, applied to the distinct units of a batch (no piece of the model spans a
blank inside or a line break, which `Pieces` verifies, so units encode independently). Sampling searches the lattice of all
segmentations of the whole text top-down: every prefix carries its log-probability phi and the
maximum G of the perturbed log-probabilities below it; a node's children get Gumbel values conditioned
on their maximum being the parent's, so the best child continues the path and its siblings wait with
exact values. The k completed paths with the greatest G are k distinct segmentations sampled without
replacement; the next value, kappa, gives their inclusion scores 1 - exp(-exp(phi - kappa)).
Piece weights are rank^-`SHARPNESS` by the model's order of pieces. Random numbers are hashes of the
row key, the place in the text and the sample, and log-probabilities are sums of whole multiples of 2^-32, so reruns and other partitionings agree to the last digit. Work is
vectorised across the units of a block of texts, whose lattices are made again only for units that aren't
among the worker's `KNOWN_UNITS` most widespread ones; rows never leave their task.

Defined results: null and empty texts have no tokens, decode to the empty text and have one
segmentation, the empty one, with inclusion 1; a text with fewer than k segmentations emits them all;
rows with equal key and text are sampled alike; a null key counts as 0; an empty table gives an empty
result; further columns are ignored. U+2581 stands for a blank in the model, so a text with
it decodes to one with a blank and `round_trip` is false.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._shared import bounded_batches, table
from lodestone.llm._text import _powers, mixed, release

MODEL, SAMPLES, SHARPNESS, BLOCK_CHARS, SAMPLE_UNITS = "/opt/tokenizers/piece_bpe_32k.model", 2, 1.0, 1_500_000, 30_000
#: Units whose encodings and lattices a worker keeps, and the blocks in which it looks for them.
KNOWN_UNITS, LEARN_BLOCKS = 100_000, 5
#: Log-probabilities are multiples of 1 / UNIT_LOG, edges' shares of a node multiples of 1 / UNIT_P.
UNIT_LOG, UNIT_P = float(1 << 32), float(1 << 40)
UNIT = re.compile(r"\n+| *[^ \n]+| +")
_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LONG = np.int64


class Pieces:
    """The model's vocabulary as a sorted hash table; loaded once a worker."""

    _loaded: dict[str, "Pieces"] = {}

    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.vocab_size()
        names = [self.sp.id_to_piece(i).replace("▁", " ") for i in range(n)]
        special = np.array([self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i) for i in range(n)])
        self.bytes = {int(self.sp.id_to_piece(i)[3:5], 16): i for i in range(n) if self.sp.is_byte(i)}
        ids = [i for i in range(n) if not special[i] and names[i]]
        if any(" " in names[i].lstrip(" ") or "\n" in names[i] for i in ids):
            raise ValueError("a piece spans units; encode whole texts instead")
        order = sorted(ids, key=lambda i: -self.sp.get_score(i))
        weight = np.zeros(n)
        weight[order] = -SHARPNESS * np.log(np.arange(2, len(order) + 2))
        self.byte_weight = -SHARPNESS * np.log(len(order) + 2.0)
        self.longest = max(len(names[i]) for i in ids)
        hashes = self._hashes([names[i] for i in ids])
        by = np.argsort(hashes)
        self.hashes, self.ids = hashes[by], np.array(ids)[by]
        self.weights = weight[self.ids]
        # open addressing by the hash's top bits; -1 is a free slot
        self.slots, self.probes = np.full((1 << 20) + 64, -1, np.int32), 1
        for i, h in enumerate(self.hashes.tolist()):
            at = first = h >> 44
            while self.slots[at] >= 0:
                at += 1
            self.slots[at] = i
            self.probes = max(self.probes, at - first + 1)
        # which hashes begin a longer piece; false hits only cost a look
        self.begins = np.zeros(1 << 22, bool)
        prefixes = {names[i][:k] for i in ids for k in range(1, len(names[i]))}
        self.begins[self._hashes(list(prefixes)) >> np.uint64(42)] = True
        self.names = names
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(self.bytes.values())] = True
        self.blank = int(self.sp.piece_to_id("▁"))
        self.length = np.array([len(x) for x in self.names])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h that are pieces, ascending; their index)."""
        at, todo = (h >> np.uint64(44)).astype(np.int32), np.arange(len(h))
        out = np.full(len(h), -1, np.int32)
        for step in range(self.probes):
            i = self.slots[at[todo] + step]
            used = i >= 0
            todo, i = todo[used], i[used]
            same = self.hashes[i] == h[todo]
            out[todo[same]] = i[same]
            todo = todo[~same]
            if not len(todo):
                break
        hit = np.flatnonzero(out >= 0)
        return hit, out[hit]

    @classmethod
    def load(cls, path: str) -> "Pieces":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    @staticmethod
    def _hashes(names: list[str]) -> np.ndarray:
        chars = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
        end = np.cumsum(np.fromiter(map(len, names), _LONG, len(names)))
        total = np.r_[np.uint64(0), np.cumsum(mixed(chars.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(chars))[:-1], dtype=np.uint64)]
        start = np.r_[0, end[:-1]]
        return (total[end] - total[start]) * _powers(_INV, len(chars))[start]

    def encode_unit(self, units: list[str]) -> list[list[int]]:
        """The library's ids of units cut from a text with its leading blank."""
        blank = [u[1:] if u[0] == " " else "\n" + u for u in units]
        out = self.sp.encode(blank, num_threads=1)
        return [[self.blank] if u == " " else ids if u[0] == " " else ids[2:] for u, ids in zip(units, out)]

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)

    def spells(self, ids: list[int], unit: str) -> bool:
        """Whether the ids of a unit decode to it."""
        if "".join([self.names[i] for i in ids]) == unit:
            return True
        return self.decode([self.blank, *ids]) == unit


    def all_spelled(self, flat: np.ndarray, at: np.ndarray, units: list[str]) -> np.ndarray:
        """`spells` of units with ids flat[at[i]:at[i + 1]]: whole runs at once where the pieces' names are the text."""
        out = np.ones(len(units), bool)
        size = np.fromiter(map(len, units), _LONG, len(units))
        odd = np.r_[0, np.cumsum(self.is_byte[flat])]
        total = np.r_[0, np.cumsum(self.length[flat])]
        sure = (odd[at[1:]] == odd[at[:-1]]) & (total[at[1:]] - total[at[:-1]] == size)
        keep = np.repeat(sure, np.diff(at))
        name = self.names.__getitem__
        if "".join(map(name, flat[keep].tolist())) != "".join(u for u, ok in zip(units, sure.tolist()) if ok):
            sure[:] = False
        for i in np.flatnonzero(~sure).tolist():
            out[i] = self.spells(flat[at[i] : at[i + 1]].tolist(), units[i])
        return out


class Index(dict):
    """Numbers keys in the order they come."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Lattices:
    """Edge arrays of the lattices of distinct units: nodes are positions, edges pieces, grouped by node."""

    def __init__(self, units: list[str], pieces: Pieces):
        chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, units), _LONG, len(units))
        first = np.r_[0, np.cumsum(size)]
        n = len(chars)
        end = np.repeat(first[1:], size)
        up, down = _powers(_P, n), _powers(_INV, n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(chars.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        src, dst, edge_id, weight = [], [], [], []
        at = np.arange(n)
        for k in range(1, pieces.longest + 1):
            if not len(at):
                break
            h = (total[at + k] - total[at]) * down[at]
            hit, i = pieces.find(h)
            src.append(at[hit])
            dst.append(at[hit] + k)
            edge_id.append(pieces.ids[i])
            weight.append(pieces.weights[i])
            at = at[pieces.begins[h >> np.uint64(42)]]
            at = at[at + k < end[at]]
        single = np.zeros(n, bool)
        single[src[0]] = True
        rest = np.flatnonzero(~single)  # characters without a piece fall back to their bytes
        utf8 = 1 + (chars[rest] > 0x7F) + (chars[rest] > 0x7FF) + (chars[rest] > 0xFFFF)
        src.append(rest)
        dst.append(rest + 1)
        edge_id.append(-1 - chars[rest].astype(_LONG))
        weight.append(pieces.byte_weight * utf8)
        # edges lie by node; a node's longest pieces, which are likeliest, come first
        per_node = np.zeros(n, _LONG)
        for at in src:  # a list has a node once
            per_node[at] += 1
        self.begin = np.r_[0, np.cumsum(per_node)]
        m = int(self.begin[-1])
        small = np.int32 if n < 1 << 30 else _LONG
        self.src, self.dst, self.id, w = np.repeat(np.arange(n, dtype=small), per_node), np.empty(m, small), np.empty(m, np.int32), np.empty(m)
        free = self.begin[:-1].copy()
        for s, d, i, x in zip(src[::-1], dst[::-1], edge_id[::-1], weight[::-1]):
            at = free[s]
            self.dst[at], self.id[at], w[at] = d, i, x
            free[s] += 1
        self.first, self.end = first[:-1], first[1:]
        # backward log-sums by distance from the unit's start, the farthest first
        beta = np.zeros(n + 1)
        local = np.arange(n) - np.repeat(self.first, size)
        far = int(size.max()) - local
        by = np.argsort(far.astype(np.uint16) if size.max() < 1 << 16 else far, kind="stable")  # 16 bits sort by radix
        cuts = np.flatnonzero(np.r_[True, np.diff(local[by]) != 0])
        is_end = np.zeros(n + 1, bool)
        is_end[first] = True
        score = np.empty(len(w))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), n]):
            nodes = by[lo:hi]  # ascending, as the sort is stable
            count = self.begin[nodes + 1] - self.begin[nodes]
            e = np.repeat(self.begin[nodes] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            to = self.dst[e]
            # a unit's end is the next unit's first node, whose own sum doesn't count here
            score[e] = w[e] + np.where(is_end[to], 0.0, beta[to])
            beta[nodes] = np.logaddexp.reduceat(score[e], np.r_[0, np.cumsum(count)[:-1]])
        # whole numbers: their running sums are exact, whatever lies before them
        logp = score - beta[self.src]
        self.logp = np.rint(logp * UNIT_LOG).astype(_LONG)
        run = np.r_[np.uint64(0), np.cumsum((np.exp(logp) * UNIT_P).astype(np.uint64), dtype=np.uint64)]
        self.cum = np.minimum((run[1:] - run[self.begin[self.src]]) / UNIT_P, 1.0)
        self.cum[self.begin[1:] - 1] = 1.0

    def followed_by(self, other: "Lattices") -> "Lattices":
        """The lattices of both, this one's units first."""
        out, n, m = Lattices.__new__(Lattices), len(self.begin) - 1, len(self.src)
        out.begin = np.concatenate([self.begin, other.begin[1:] + m])
        for name, shift in (("src", n), ("dst", n), ("first", n), ("end", n), ("id", 0), ("logp", 0), ("cum", 0)):
            x = getattr(other, name)
            setattr(out, name, np.concatenate([getattr(self, name), x + x.dtype.type(shift) if shift else x]))
        return out

    def descend(self, types: np.ndarray, pos: np.ndarray, random) -> tuple[np.ndarray, np.ndarray]:
        """Sample a path through every unit from node `pos`: (unit, edge) of all edges taken, in text order."""
        unit, edge, steps = [], [], []
        live = np.flatnonzero(pos < self.end[types])
        step = 0
        while len(live):
            node = pos[live]
            e, goal = self.begin[node], random(live, step)
            more = np.flatnonzero(self.cum[e] < goal)  # the last edge of a node closes at node + 1
            while len(more):
                e[more] += 1
                more = more[self.cum[e[more]] < goal[more]]
            unit.append(live)
            edge.append(e)
            steps.append(np.full(len(live), step))
            pos = pos.copy() if step == 0 else pos
            pos[live] = self.dst[e]
            live = live[pos[live] < self.end[types[live]]]
            step += 1
        if not unit:
            none = np.empty(0, _LONG)
            return none, none
        unit, edge, steps = np.concatenate(unit), np.concatenate(edge), np.concatenate(steps)
        count = np.bincount(unit, minlength=len(types))
        at = (np.cumsum(count) - count)[unit] + steps  # a unit's steps are numbered from 0
        out = np.empty(len(at), _LONG)
        out[at] = edge
        return np.repeat(np.arange(len(types)), count), out


#: -ln u of the greatest u is 2^-54: no Gumbel value exceeds its phi by more.
GUMBEL_MOST = 37.5
#: Siblings whose prefix is less likely than this are looked at only if they could matter.
FAR = -100.0


def salted(seed: np.ndarray, salt: int) -> np.ndarray:
    return mixed(seed + np.uint64(salt) * np.uint64(0x165667B19E3779F9))


def uniform(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes of the row's salted seed and the place."""
    h = mixed(seed ^ (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((h >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def _per_doc_max(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(max or -inf, its index or -1) by doc; doc is sorted."""
    best, at = np.full(n, -np.inf), np.full(n, -1)
    if len(doc):
        cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        top = np.maximum.reduceat(value, cuts)
        best[doc[cuts]] = top
        size = np.diff(np.r_[cuts, len(doc)])
        hit = np.flatnonzero((value == np.repeat(top, size)) & (value > -np.inf))
        at[doc[hit[::-1]]] = hit[::-1]
    return best, at


def sample(lat: Lattices, types: np.ndarray, doc: np.ndarray, n_docs: int, seed: np.ndarray, k: int, far: float = FAR) -> tuple[list[dict], np.ndarray, np.ndarray]:
    """k segmentations without replacement for every text, kappa, and the texts to do again with a lower `far`.

    A sibling below a prefix with a log-probability under `far` has a value of at most far + GUMBEL_MOST;
    where every value chosen lies above that, leaving them out changes nothing.

    types: lattice of every unit; doc: its text, sorted. Each sample is a dict with per-text
    `phi`, `g` (-inf where the text has no further segmentation) and the path's (doc, edge) arrays.
    """
    start = np.searchsorted(doc, np.arange(n_docs + 1))
    within = np.arange(len(doc)) - start[doc] if len(doc) else np.empty(0, _LONG)
    g = -np.log(-np.log(uniform(salted(seed, 0), np.zeros(n_docs, _LONG))))
    paths: list[dict] = []
    queue: list[dict] = []
    branch_unit = np.zeros(n_docs, _LONG)
    least, left_out = np.full(n_docs, np.inf), np.zeros(n_docs, bool)
    pos = lat.first[types].copy()
    prefix = None
    for j in range(k):
        active = np.isfinite(g)
        own = salted(seed, 2 * j + 1)[doc]
        rnd = lambda live, step, own=own: uniform(own[live], (within[live] << 32) + step)
        unit, edge = lat.descend(types, np.where(active[doc] if len(doc) else False, pos, lat.end[types]), rnd)
        fresh = np.ones(len(unit), bool)
        if prefix is not None:
            unit, edge, fresh = np.r_[prefix[0], unit], np.r_[prefix[1], edge], np.r_[np.zeros(len(prefix[0]), bool), fresh]
            order = np.argsort(unit, kind="stable")
            unit, edge, fresh = unit[order], edge[order], fresh[order]
        d = doc[unit]
        run = np.r_[0, np.cumsum(lat.logp[edge])]
        first_visit = np.searchsorted(d, np.arange(n_docs + 1))
        before = (run[:-1] - run[first_visit[d]]) / UNIT_LOG if len(d) else np.empty(0)
        phi = (run[first_visit[1:]] - run[first_visit[:-1]]) / UNIT_LOG
        paths.append({"phi": phi, "g": g, "doc": d, "unit": unit, "edge": edge})
        # siblings of the edges taken after the branch, conditioned on being less than the path's value
        near = before >= far
        left_out[d[fresh & ~near]] = True
        v = np.flatnonzero(fresh & near)
        node = lat.src[edge[v]]
        count = lat.begin[node + 1] - lat.begin[node]
        visit = np.repeat(v, count)
        e = np.repeat(lat.begin[node] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum()) if len(v) else np.empty(0, _LONG)
        other = e != edge[visit]
        visit, e = visit[other], e[other]
        sd = d[visit]
        loc = before[visit] + lat.logp[e] / UNIT_LOG
        u = uniform(salted(seed, 2 * j + 2)[sd], (visit - first_visit[sd]) * 64 + (e - lat.begin[lat.src[e]]))
        value = loc - np.log(np.exp(np.minimum(loc - g[sd], 700)) - np.log(u))
        queue.append({"doc": sd, "value": value, "visit": visit, "edge": e, "path": j})
        best, who = np.full(n_docs, -np.inf), np.full(n_docs, -1)
        where = np.full(n_docs, -1)
        for q, item in enumerate(queue):
            top, at = _per_doc_max(item["doc"], item["value"], n_docs)
            better = top > best
            best[better], who[better], where[better] = top[better], q, at[better]
        g = best
        least = np.minimum(least, g)
        if j == k - 1:
            break
        # the next path of each text: its prefix up to the branch, the sibling, then a fresh descent
        keep_unit, keep_edge = [], []
        pos = lat.first[types].copy()
        for q, item in enumerate(queue):
            docs_q = np.flatnonzero(who == q)
            if not len(docs_q):
                continue
            at = where[docs_q]
            visit, e = item["visit"][at], item["edge"][at]
            item["value"][at] = -np.inf
            p = paths[item["path"]]
            bound = np.full(n_docs, -1)
            bound[docs_q] = visit
            idx = np.arange(len(p["doc"]))
            keep = idx < bound[p["doc"]]
            keep_unit.append(p["unit"][keep])
            keep_edge.append(p["edge"][keep])
            at_unit = p["unit"][visit]
            keep_unit.append(at_unit)
            keep_edge.append(e)
            branch_unit[docs_q] = at_unit
            pos[at_unit] = lat.dst[e]
        # units before the branch are done
        done = np.arange(len(types)) < branch_unit[doc] if len(doc) else np.empty(0, bool)
        pos = np.where(done, lat.end[types], pos)
        ku, ke = (np.concatenate(x) if x else np.empty(0, _LONG) for x in (keep_unit, keep_edge))
        order = np.argsort(ku, kind="stable")
        prefix = (ku[order], ke[order])
    return paths, g, np.flatnonzero(left_out & (least < far + GUMBEL_MOST))


def _edge_ids(lat: Lattices, edges: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the edges, bytes for characters without a piece, and where each edge's ids begin."""
    ids = lat.id[edges]
    char = -1 - ids
    size = np.where(ids >= 0, 1, 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF))
    begin = np.r_[0, np.cumsum(size)]
    out = np.repeat(ids, size)
    for c in np.unique(char[ids < 0]).tolist():
        at = begin[:-1][char == c]
        for k, x in enumerate(chr(c).encode("utf-8", "surrogatepass")):
            out[at + k] = pieces.bytes[x]
    return out.astype(np.int32), begin


class Coded:
    """Encodings and lattices of units: ids flat[at[i]:at[i + 1]], their number, and whether they decode to the unit."""

    def __init__(self, units: list[str], pieces: Pieces):
        coded = pieces.encode_unit(units)
        self.length = np.fromiter(map(len, coded), _LONG, len(units))
        self.flat, self.at = np.fromiter(chain.from_iterable(coded), np.int32, int(self.length.sum())), np.r_[0, np.cumsum(self.length)]
        self.whole, self.lat = pieces.all_spelled(self.flat, self.at, units), Lattices(units, pieces)

    def followed_by(self, other: "Coded") -> "Coded":
        out = Coded.__new__(Coded)
        out.length, out.flat, out.whole = (np.concatenate([getattr(self, x), getattr(other, x)]) for x in ("length", "flat", "whole"))
        out.at, out.lat = np.r_[0, np.cumsum(out.length)], self.lat.followed_by(other.lat)
        return out


class Known:
    """Units that a worker has seen in most of its first `LEARN_BLOCKS` blocks, with what was made of them. It saves work only."""

    _loaded: dict[str, "Known"] = {}

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.made: Coded | None = None
        self.blocks, self.seen = 0, Counter()

    @classmethod
    def load(cls, path: str) -> "Known":
        return cls._loaded.setdefault(path, cls())

    def learn(self, units: dict[str, int], pieces: Pieces) -> None:
        if self.blocks >= LEARN_BLOCKS:
            return
        self.blocks += 1
        self.seen.update(units.keys())
        if self.blocks == LEARN_BLOCKS:
            kept = [u for u, n in self.seen.most_common(KNOWN_UNITS) if n > 1 and len(u) < 64]
            if kept:
                self.index, self.made = {u: i for i, u in enumerate(kept)}, Coded(kept, pieces)
            self.seen.clear()


def _encode(path: str, k: int, with_ids: bool):
    def draw(lat: Lattices, types: np.ndarray, doc: np.ndarray, n: int, seed: np.ndarray, pieces: Pieces, far: float = FAR) -> list[tuple]:
        """(samples, log-probabilities, inclusion scores) of every text."""
        paths, kappa, again = sample(lat, types, doc, n, seed, k, far)
        cuts = [np.searchsorted(p["doc"], np.arange(n + 1)) for p in paths]
        made = [_edge_ids(lat, p["edge"], pieces) for p in paths]
        out = []
        for i in range(n):
            some = [(p, c, m) for p, c, m in zip(paths, cuts, made) if np.isfinite(p["g"][i])]
            seqs = [seq[begin[c[i]] : begin[c[i + 1]]] for _, c, (seq, begin) in some]
            phis = [float(p["phi"][i]) for p, _, _ in some]
            # a text with at most k segmentations is sampled whole: kappa is -inf and every inclusion 1
            out.append((seqs, phis, [float(-np.expm1(-np.exp(np.clip(x - kappa[i], -700, 700)))) if np.isfinite(kappa[i]) else 1.0 for x in phis]))
        for i in again.tolist():
            mine = doc == i
            out[i] = draw(lat, types[mine], np.zeros(int(mine.sum()), _LONG), 1, seed[i : i + 1], pieces, -np.inf)[0]
        return out

    def block(keys: list, texts: list[str], pieces: Pieces) -> list[tuple]:
        clean = [t.replace("▁", " ") for t in texts]
        known = Known.load(path)
        index = Index(known.index)
        per_doc = [list(map(index.__getitem__, UNIT.findall(" " + t))) if t else [] for t in clean]
        n = len(texts)
        if not any(per_doc):
            return [(key, [], True, [[]], [0.0], [1.0]) for key in keys]
        made = known.made
        if len(index) > len(known.index):
            new = Coded(list(islice(index, len(known.index), None)), pieces)
            made = new if made is None else made.followed_by(new)
        known.learn(index, pieces)
        flat, at, length, whole, lat = made.flat, made.at, made.length, made.whole, made.lat
        size = np.fromiter(map(len, per_doc), _LONG, n)
        types = np.fromiter(chain.from_iterable(per_doc), _LONG, int(size.sum()))
        doc = np.repeat(np.arange(n), size)
        seed = mixed(np.array([(0 if key is None else key) & ((1 << 64) - 1) for key in keys], np.uint64) + np.uint64(0x5851F42D4C957F2D))
        token = np.r_[0, np.cumsum(length[types])]
        ids_all = flat[np.repeat(at[types] - token[:-1], length[types]) + np.arange(token[-1])]
        first = np.r_[0, np.cumsum(size)]
        good = np.r_[0, np.cumsum(whole[types])]
        sampled: list[tuple] = []
        lo = 0
        while lo < n:  # texts of about SAMPLE_UNITS units at a time, over the same lattices
            hi = max(lo + 1, int(np.searchsorted(first, first[lo] + SAMPLE_UNITS, "right")) - 1)
            sampled += draw(lat, types[first[lo] : first[hi]], doc[first[lo] : first[hi]] - lo, hi - lo, seed[lo:hi], pieces)
            lo = hi
        out = []
        for i in range(n):
            lo, hi = first[i], first[i + 1]
            out.append((keys[i], ids_all[token[lo] : token[hi]], bool(good[hi] - good[lo] == hi - lo) and clean[i] == texts[i], *sampled[i]))
        return out

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        ids = lambda x: np.asarray(x, np.int32)
        sha = lambda x: hashlib.sha256(ids(x).tobytes()).hexdigest()
        cols = {
            "doc_id": pa.array([r[0] for r in rows], pa.int64()),
            "n_tokens": pa.array([len(r[1]) for r in rows], pa.int64()),
            "ids_sha256": pa.array([sha(r[1]) for r in rows]),
            "round_trip": pa.array([bool(r[2]) for r in rows]),
            "sample_tokens": pa.array([[len(s) for s in r[3]] for r in rows], pa.list_(pa.int64())),
            "sample_sha256": pa.array([[sha(s) for s in r[3]] for r in rows], pa.list_(pa.string())),
            "sample_log_prob": pa.array([r[4] for r in rows], pa.list_(pa.float64())),
            "inclusion": pa.array([r[5] for r in rows], pa.list_(pa.float64())),
        }
        if with_ids:
            cols["ids"] = pa.array([ids(r[1]) for r in rows], pa.list_(pa.int32()))
            cols["samples"] = pa.array([[ids(s) for s in r[3]] for r in rows], pa.list_(pa.list_(pa.int32())))
        return pa.RecordBatch.from_pydict(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(path)
        keys, texts, held = [], [], 0
        for b in batches:
            for key, text in zip(b.column(0), b.column(1)):
                keys.append(key.as_py())
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held > BLOCK_CHARS or len(keys) == 10_000:
                    yield emit(block(keys, texts, pieces))
                    keys, texts, held = [], [], 0
        if keys:
            yield emit(block(keys, texts, pieces))
        keys, texts = [], []
        release()

    return run


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean, sample_tokens array<long>, sample_sha256 array<string>, sample_log_prob array<double>, inclusion array<double>"


def encode(docs: DataFrame, model: str = MODEL, k: int = SAMPLES, with_ids: bool = True) -> DataFrame:
    """Per row: the encoding, k sampled segmentations with log-probabilities and inclusion scores, digests, and (`with_ids`) ids and samples.

    `model` must be readable at that path on every executor.
    """
    schema = DIGESTS + (", ids array<int>, samples array<array<int>>" if with_ids else "")
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode(model, k, with_ids), schema)


def decode(encoded: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """`encoded` with the text that `ids` decode to, as (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pieces.decode(x) if x else "" for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", ids).mapInArrow(run, "doc_id long, text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False)


QUERIES = {"op3_sentencepiece": op3_sentencepiece}
ORACLES: dict[str, str] = {}
