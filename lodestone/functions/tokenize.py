"""Tokenisation. The default splits lower-cased text at anything but letters and digits; a dictionary
tokenizer segments by maximum probability and is used where a vocabulary is given."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Characters that are segmented together.
CHARACTERS = 1 << 18
#: The longest pieces of a batch whose paths are found by themselves, and places of one that are looked at together.
FEW, LOOK = 16, 1 << 14
TOKENS = pa.list_(pa.string())
#: Children up to which nodes of a trie are placed together.
CHILDREN = 32
#: Whether a code point is white space; the last entry stands for all above.
WHITE = np.array([chr(i).isspace() for i in range(0x3002)])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class Tokenizer(Protocol):
    def __call__(self, text: Column) -> Column: ...


def regex_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_tokens(text: Column, stop: list[str] = (), tokenizer: Tokenizer = regex_tokens) -> Column:
    """Distinct tokens without stop words, in order (query side)."""
    return F.array_except(F.array_distinct(tokenizer(text)), F.array(*[F.lit(s) for s in stop]).cast("array<string>"))


def index_tokens(text: Column, stop: list[str] = (), tokenizer: Tokenizer = regex_tokens) -> Column:
    """All tokens without stop words (index side)."""
    return F.filter(tokenizer(text), lambda t: ~t.isin(list(stop))) if stop else tokenizer(text)


class DoubleArray:
    """A trie in two arrays: from state s, code c leads to t = base[s] + c if check[t] = s. Codes are dense numbers of the words' characters."""

    def __init__(self, words: dict[str, float]):
        keys = sorted(words)
        length, points = np.array([len(k) for k in keys], np.int64), _points("".join(keys))
        self.alphabet = np.unique(points)
        coded, head = np.searchsorted(self.alphabet, points) + 1, np.cumsum(length) - length
        values = np.array([words[k] for k in keys], float)
        # nodes by levels: the words are sorted, so those of one prefix are neighbours
        node, live, nodes, depth = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1, 0
        parents, labels = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(live := live[length[live] > depth]):
            up, c = node[live], coded[head[live] + depth]
            new = np.r_[True, (up[1:] != up[:-1]) | (c[1:] != c[:-1])]
            parents.append(up[new])
            labels.append(c[new])
            node[live] = nodes + np.cumsum(new) - 1
            nodes, depth = nodes + int(new.sum()), depth + 1
        parent, label = np.concatenate(parents), np.concatenate(labels)  # the edge to node i + 1
        base = self._placed(parent, label, nodes)
        place = np.zeros(nodes, np.int64)
        place[1:] = base[parent] + label
        used = int(place.max()) + 2  # what travels to the tasks: 16 bytes a place, and a free one that `matches` falls back to
        self.base, self.check, self.value = np.zeros(used, np.int32), np.full(used, -1, np.int32), np.full(used, np.nan)
        self.base[place], self.check[place[1:]], self.value[place[node]] = base, place[parent], values
        self.check[0] = 0

    def _placed(self, parent: np.ndarray, label: np.ndarray, nodes: int) -> np.ndarray:
        """The base of every node, so that no two edges share a place. Nodes with most children first; all of similar size are tried at once, at
        places drawn by a fixed seed, and those that meet a taken one are drawn again; single children fill the places left."""
        base, rng, widest = np.zeros(nodes, np.int64), np.random.default_rng(1), len(self.alphabet) + 1
        first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]][: len(parent)])
        many = np.diff(np.r_[first, len(parent)])
        taken = np.zeros(len(parent) + len(parent) // 8 + 2 * widest + 16, bool)
        taken[0] = True
        top = 0
        for g in np.flatnonzero(many > CHILDREN)[np.argsort(-many[many > CHILDREN], kind="stable")].tolist():
            own = label[first[g] : first[g] + many[g]]
            tried = np.r_[rng.integers(1, max(top, 1) + 1, 16), top + 1]  # behind all places taken there is always room
            tried = tried[-1:] if not top else tried
            taken = np.r_[taken, np.zeros(max(top + 2 * widest - len(taken), 0), bool)]
            at = int(tried[np.argmin(taken[tried[:, None] + own].any(1))])
            base[parent[first[g]]], taken[at + own] = at, True
            top = max(top, at + int(own[-1]))
        size, owner = CHILDREN, np.zeros(len(taken), np.int64)
        while size >= 2:
            left, tries = np.flatnonzero((many <= size) & (many > size // 2) & (many > 1)), 0
            while len(left):
                tries += 1
                if tries % 32 == 0:
                    taken = np.r_[taken, np.zeros(len(taken) // 8 + 1, bool)]
                if len(owner) < len(taken):
                    owner = np.zeros(len(taken), np.int64)
                m = many[left]
                head = np.cumsum(m) - m
                rows = np.arange(int(m.sum())) + np.repeat(first[left] - head, m)
                at = rng.integers(1, len(taken) - widest, len(left))
                places, who = np.repeat(at, m) + label[rows], np.repeat(np.arange(len(left)), m)
                free = ~np.logical_or.reduceat(taken[places], head)
                mine = free[who]
                owner[places[mine]] = who[mine]
                won = free & np.logical_and.reduceat(owner[places] == who, head)
                base[parent[first[left[won]]]] = at[won]
                taken[places[won[who]]] = True
                left = left[~won]
            size //= 2
        single = first[many == 1]
        free = np.flatnonzero(~taken[widest:]) + widest
        free = np.r_[free, len(taken) + np.arange(max(len(single) - len(free), 0))][: len(single)]
        base[parent[single]] = free - label[single]
        return base

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Codes of code points; 0 for a character of no word."""
        if not len(self.alphabet):
            return np.zeros(len(points), np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, 0)

    def matches(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, starts, values) of all words in `codes`, every start stepped at once; 0 ends a word."""
        at, state, length = np.flatnonzero(codes), None, 0
        state = np.zeros(len(at), np.int64)
        while len(at):
            length += 1
            there = at + length - 1 < len(codes)
            at, state = at[there], state[there]
            c = codes[at + length - 1]
            to = np.minimum(self.base[state] + c, len(self.check) - 1)
            ok = (c > 0) & (self.base[state] > 0) & (self.check[to] == state)
            at, state = at[ok], to[ok]
            word = ~np.isnan(self.value[state])
            if word.any():
                yield length, at[word], self.value[state[word]]


class DictionaryTokenizer:
    """Segmentation of greatest probability over a word -> frequency dictionary; of equal ones the longer first word.

    Characters outside every word stand alone, white space is dropped, and neighbouring single letters a-z and digits that no word
    claims form one token. Texts are cut where no word crosses, and the paths of all pieces of a batch are found together, one step from
    the right for all. The dictionary is a parameter of bounded size (MAX_WORDS) and travels with the function.
    """

    MAX_WORDS = 5_000_000

    def __init__(self, words: dict[str, int]):
        words = {w.lower(): f for w, f in words.items() if w}
        if len(words) > self.MAX_WORDS:
            raise ValueError(f"more than {self.MAX_WORDS} words")
        self.total = math.log(max(sum(words.values()), 1))
        self.trie = DoubleArray({w: math.log(f) - self.total for w, f in words.items() if f > 0})

    @classmethod
    def of(cls, vocabulary: DataFrame) -> DictionaryTokenizer:
        """From a table (word, frequency); of a repeated word the greatest frequency."""
        t = vocabulary.where("word IS NOT NULL AND frequency > 0").groupBy(F.lower("word").alias("word")).agg(F.max("frequency").alias("frequency")).limit(cls.MAX_WORDS + 1).toArrow()
        return cls(dict(zip(t.column("word").to_pylist(), map(int, t.column("frequency").to_pylist()), strict=True)))

    def ends(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Whether a token ends behind each code point of adjoining texts, which end at `bounds`."""
        n, out = len(points), np.zeros(len(points), bool)
        codes = np.zeros(n + len(bounds), np.int64)  # a 0 behind every text, so that no word crosses
        place = np.arange(n) + np.repeat(np.arange(len(bounds)), np.diff(np.r_[0, bounds]))
        codes[place] = self.trie.codes(points)
        back = np.full(len(codes), -1)
        back[place] = np.arange(n)
        found = [(length, back[at], v) for length, at, v in self.trie.matches(codes)]
        cover = np.zeros(n + 1, np.int64)  # words that cross from a place to the next
        for length, at, _ in found:  # words of one length start and end at different places
            cover[at] += 1
            cover[at + length - 1] -= 1
        alone = np.cumsum(cover)[:n] == 0
        ends = np.flatnonzero(alone)
        size = np.diff(np.r_[-1, ends])
        out[ends[size == 1]] = True  # a piece of one character has one path; the places of the others are numbered anew
        inside = ~alone
        inside[ends[size > 1]] = True
        places = np.flatnonzero(inside)
        if not len(places):
            return out
        n, number = len(places), np.cumsum(inside) - 1
        found = [(length, number[at[own]], v[own]) for length, at, v in found for own in [inside[at]]]
        alone = alone[places]
        many = np.ones(n, np.int64)  # a character of no word counts as a word of frequency 1
        for length, at, _ in found:
            if length > 1:
                many[at] += 1
        first = np.r_[0, np.cumsum(many)]  # where a place's words begin, short ones first
        words, worth, seen = np.ones(first[-1], np.int32), np.full(first[-1], -self.total), first[:-1] + 1
        for length, at, v in found:
            row = first[at] if length == 1 else seen[at]
            words[row], worth[row] = length, v
            if length > 1:
                seen[at] += 1
        last = np.flatnonzero(alone)  # where a piece ends
        size = np.diff(np.r_[-1, last])
        order = np.argsort(-size, kind="stable")
        last, size = last[order], size[order]
        best, step = np.zeros(n + 1), np.ones(n, np.int64)
        together = int(size[FEW]) if len(size) > FEW else 0
        for back_by in range(together):
            stop = last[: np.searchsorted(-size, -back_by, "left")]
            at = stop - back_by
            many = first[at + 1] - first[at]
            owner = np.repeat(np.arange(len(at)), many)
            head = np.cumsum(many) - many
            rows = np.arange(len(owner)) + (first[at] - head)[owner]
            behind = at[owner] + words[rows]
            total = worth[rows] + np.where(behind > stop[owner], 0.0, best[behind])
            best[at] = np.maximum.reduceat(total, head)
            equal = np.flatnonzero(total == best[at][owner])
            pick = np.zeros(len(at), np.int64)
            pick[owner[equal]] = rows[equal]  # the longest of equal ones is written last
            step[at] = words[pick]
        for k in range(min(FEW, len(size)) if n else 0):
            self._walk(int(last[k]) - together, int(last[k]) - int(size[k]) + 1, int(last[k]), first, words, worth, best, step)
        at = last - size + 1
        while len(at):  # all pieces walk their paths together
            end = at + step[at] - 1
            out[places[end]] = True
            going = end < last
            at, last = end[going] + 1, last[going]
        return out

    @staticmethod
    def _walk(hi: int, lo: int, stop: int, first: np.ndarray, words: np.ndarray, worth: np.ndarray, best: np.ndarray, step: np.ndarray) -> None:
        """The best paths from the places hi, hi - 1, ... lo of the piece that ends at `stop`, one after another: the few longest pieces
        of a batch would make the steps of all pieces together mostly empty."""
        ahead = best[hi + 1 : stop + 1][:LOOK].tolist()[::-1]  # of the places behind, the nearest last
        while hi >= lo:
            low = max(lo, hi - LOOK + 1)
            at, w, v = (first[low : hi + 2] - first[low]).tolist(), words[first[low] : first[hi + 1]].tolist(), worth[first[low] : first[hi + 1]].tolist()
            length = [1] * (hi - low + 1)
            for i in range(hi, low - 1, -1):
                top, pick = -math.inf, 1
                for r in range(at[i - low], at[i - low + 1]):
                    t = v[r] + 0.0 if i + w[r] > stop else v[r] + (ahead[-w[r]] if w[r] <= len(ahead) else float(best[i + w[r]]))
                    if t >= top:
                        top, pick = t, w[r]
                ahead.append(top)
                length[i - low] = pick
            best[low : hi + 1], step[low : hi + 1] = ahead[: -(hi - low + 2) : -1], length
            ahead, hi = ahead[-LOOK:], low - 1

    def cut_all(self, texts: list[str]) -> list[list[str]]:
        return self.segmented(texts).to_pylist()

    def segmented(self, texts: list[str]) -> pa.ListArray:
        """The tokens of every text as an Arrow array, made of offsets; no token becomes a Python string."""
        low = [t.lower() for t in texts]
        bounds = np.cumsum([len(t) for t in low], dtype=np.int64)
        points = _points("".join(low))
        out = self.ends(points, bounds)
        plain = ((points >= 97) & (points <= 122)) | ((points >= 48) & (points <= 57))
        single = out & np.r_[True, out[:-1]][: len(out)]
        edge = np.zeros(len(points) + 1, bool)
        edge[bounds] = True
        merged = single & plain & ~edge[1:]
        merged[:-1] &= (single & plain)[1:]
        if len(merged):
            merged[-1] = False
        stops = np.flatnonzero(out & ~merged) + 1
        n, white = len(points), WHITE[np.minimum(points, len(WHITE) - 1)]
        a = np.minimum.accumulate(np.where(white, n, np.arange(n))[::-1])[::-1][np.r_[0, stops][:-1]]  # without the white space around
        b = np.maximum.accumulate(np.where(white, -1, np.arange(n)))[stops - 1] + 1
        kept = a < b
        before = np.r_[0, np.cumsum(kept)][np.searchsorted(stops, np.r_[0, bounds], "right")]
        cover = np.zeros(n + 1, np.int64)
        cover[a[kept]] += 1
        cover[b[kept]] -= 1
        own = np.cumsum(cover)[:n] > 0
        size = np.where(own, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), 0)
        ends = np.cumsum(size)
        letters = points[own].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        offsets = np.r_[0, ends[b[kept] - 1]].astype(np.int32)
        words = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(letters))
        return pa.ListArray.from_arrays(pa.array(before, pa.int32()), words)

    def cut(self, text: str) -> list[str]:
        return self.cut_all([text])[0]

    def __call__(self, text: Column) -> Column:
        segmented, most = self.segmented, CHARACTERS

        @F.arrow_udf("array<string>")
        def segment(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for b in batches:
                texts, out, lo = [t or "" for t in b.to_pylist()], [pa.array([], TOKENS)], 0
                ends = np.cumsum([len(t) for t in texts])
                while lo < len(texts):  # of very long texts fewer at a time
                    hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
                    out.append(segmented(texts[lo:hi]))
                    lo = hi
                yield pa.concat_arrays(out)

        return segment(text)
