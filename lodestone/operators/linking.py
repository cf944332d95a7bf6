"""Entity links and contexts inside texts. Rewrites are sequential in a text, so they run in Arrow batches.
`annotate_joined` looks up each text's own names, whatever the dictionary's size; `annotate` tries all of
a list of names, and `load_names` refuses a dictionary beyond its bound."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources import tables

MAX_NAMES = 200_000
#: Characters of a name beside its run that belong to its anchor, so that a name of short runs isn't sought in every text.
SIDE = 4
_LINKED = re.compile(r"\[\[[^\]]*\]\]")
_RUN = re.compile(r"[A-Za-z0-9_]+")


def load_names(entries: DataFrame) -> list[str]:
    """Names for linking: longest first, then by name; empty ones dropped."""
    rows = entries.where("name <> ''").select("name").distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names; link with annotate_joined instead")
    return sorted((r["name"] for r in rows), key=lambda n: (-len(n), n))


def pattern_of(names: list[str]) -> re.Pattern | None:
    """One alternation, longest first; names with ASCII word characters at an edge need a boundary there."""
    word = lambda c: c.isascii() and (c.isalnum() or c == "_")
    parts = [(r"(?<![A-Za-z0-9_])" if word(n[0]) else "") + re.escape(n) + (r"(?![A-Za-z0-9_])" if word(n[-1]) else "") for n in names]
    return re.compile("|".join(parts)) if parts else None


class Hit(NamedTuple):
    begin: int
    finish: int
    name: str

    def group(self) -> str:
        return self.name


class Names:
    """Finds names as `pattern_of` does (leftmost, then longest, not overlapping), in one pass of an Aho-Corasick automaton whatever their number."""

    def __init__(self, names: Iterable[str]):
        self.machine = ahocorasick.Automaton()
        for n in names:
            if n:
                self.machine.add_word(n, n)
        if len(self.machine):
            self.machine.make_automaton()

    def finditer(self, text: str) -> list[Hit]:
        if not len(self.machine) or not text:
            return []
        word = lambda c: c.isascii() and (c.isalnum() or c == "_")
        found = []
        for last, n in self.machine.iter(text):
            begin, end = last - len(n) + 1, last + 1
            if not (word(n[0]) and begin and word(text[begin - 1])) and not (word(n[-1]) and end < len(text) and word(text[end])):
                found.append((begin, -end, n))
        out, at = [], 0
        for begin, end, n in sorted(found):
            if begin >= at:
                out.append(Hit(begin, -end, n))
                at = -end
        return out

    def sub(self, wrap: Callable[[Hit], str], text: str) -> str:
        parts, at = [], 0
        for h in self.finditer(text):
            parts += [text[at : h.begin], wrap(h)]
            at = h.finish
        return "".join(parts) + text[at:]


def annotate_text(text: str, pattern: re.Pattern | Names | None) -> tuple[str, int]:
    """`text` with every name outside a link wrapped in `[[ ]]`, and the number of distinct names wrapped."""
    if not text or pattern is None:
        return text or "", 0
    found: set[str] = set()

    def wrap(m: re.Match) -> str:
        found.add(m.group())
        return f"[[{m.group()}]]"

    out, at = [], 0
    for link in _LINKED.finditer(text):
        out += [pattern.sub(wrap, text[at : link.start()]), link.group()]
        at = link.end()
    out.append(pattern.sub(wrap, text[at:]))
    return "".join(out), len(found)


def missing_in_text(text: str, pattern: re.Pattern | Names | None) -> list[str]:
    """Names that occur outside all links, once each, in order."""
    if not text or pattern is None:
        return []
    return list(dict.fromkeys(m.group() for m in pattern.finditer(_LINKED.sub(lambda m: "\0" * len(m.group()), text))))


def context_of(text: str, names: list[str], size: int = 200, most: int = 3) -> str:
    """Passages of `size` characters around up to `most` places of each name, joined where they touch; without any, the beginning."""
    spans = []
    for n in names:
        for k, m in enumerate(re.finditer(re.escape(n), text, re.IGNORECASE)):
            if k == most:
                break
            spans.append((max(0, m.start() - size), min(len(text), m.end() + size)))
    return "\n".join(text[s:e] for s, e in islands(spans)) if spans else text[: 2 * size]


def islands(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans; touching ones join."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def snippets_of(text: str, names: list[str], tokens: int = 200, most: int = 3, cn: float = 1.5, en: float = 4.0) -> list[dict]:
    """The `most` passages with the densest mentions, in text order: start, end, mentions."""
    if not names:
        return []
    hits = [m.span() for m in re.finditer("|".join(map(re.escape, sorted(names, key=len, reverse=True))), text, re.IGNORECASE)]
    wide = math.ceil(tokens * (cn + en) / 2)
    rows = []
    for s, e in islands([(max(0, a - wide), min(len(text), b + wide)) for a, b in hits]):
        n = sum(1 for a, b in hits if a >= s and b <= e)
        rows.append({"start": s, "end": e, "mentions": n, "text": text[s:e].strip()})
    best = sorted(rows, key=lambda r: -r["mentions"] / max(r["end"] - r["start"], 1))[:most]
    return sorted(best, key=lambda r: r["start"])


def annotate(chunks: DataFrame, names: list[str]) -> DataFrame:
    """`chunks` with linked content and `n_linked`."""
    box = chunks.sparkSession.sparkContext.broadcast(names)

    @F.pandas_udf("content string, n_linked int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Names(box.value)
        for s in batches:
            yield pd.DataFrame([annotate_text(t, known) for t in s], columns=["content", "n_linked"])

    return chunks.withColumn("x", run("content")).withColumns({"content": F.col("x.content"), "n_linked": F.col("x.n_linked")}).drop("x")


def with_anchors(entries: DataFrame) -> DataFrame:
    """(name, anchor, n, l, r): the longest run of ASCII word characters, which `pattern_of` only lets occur whole, with up to SIDE characters of
    the name before (l) and after it (r); n is the run's length. A name without a run is its own anchor, with n 0."""
    runs = F.transform(F.regexp_extract_all("name", F.lit(f"({_RUN.pattern})"), F.lit(1)), lambda r: F.struct(F.length(r).alias("n"), r.alias("run")))
    best = entries.where("name <> ''").select("name").distinct().withColumn("run", F.coalesce(F.array_max(runs)["run"], F.lit("")))
    at, n = F.instr("name", F.col("run")), F.length("run")  # none is longer, so its first place is a whole run
    side = best.select("name", n.alias("n"), at.alias("at"), F.when(n > 0, F.least(at - 1, F.lit(SIDE))).otherwise(0).alias("l"), F.when(n > 0, F.least(F.length("name") - at + 1 - n, F.lit(SIDE))).otherwise(0).alias("r"))
    return side.select("name", F.when(F.col("n") > 0, F.substring("name", F.col("at") - F.col("l"), F.col("l") + F.col("n") + F.col("r"))).otherwise(F.col("name")).alias("anchor"), "n", "l", "r")


class Anchors:
    """Finds the anchors of all names that may occur in a text, from the shapes (n, l, r) of the names' anchors, the characters beside their runs, and the
    lengths of anchors without a run (windows). A run has at most (SIDE + 1)^2 shapes, and only those with l or r 0 where its neighbour is beside no name's run."""

    def __init__(self, shapes: Iterable[tuple[int, int, int]], windows: Iterable[int], before: Iterable[str], after: Iterable[str]):
        self.windows, self.before, self.after = sorted(windows), frozenset(before), frozenset(after)
        self.plain: set[int] = set()
        self.shapes: dict[int, list[list[tuple[int, int]]]] = {}  # by length of the run: before, after, both
        for n, left, right in shapes:
            if left or right:
                self.shapes.setdefault(n, [[], [], []])[bool(left) + 2 * bool(right) - 1].append((left, right))
            else:
                self.plain.add(n)
        beside = "".join(map(re.escape, sorted(self.before | self.after)))
        #: Stretches of runs and such neighbours that hold a neighbour; the rest of a text has no anchor but plain runs and windows.
        self.sided = re.compile(rf"(?<![A-Za-z0-9_])[A-Za-z0-9_]*+[{beside}][A-Za-z0-9_{beside}]*+") if beside else None

    @classmethod
    def of(cls, names: DataFrame) -> Anchors:
        """From `with_anchors`; the driver gets the shapes and characters that occur, not the names."""
        rows = names.select("n", "l", "r", F.when(F.col("n") == 0, F.length("anchor")).alias("w")).distinct().collect()
        beside = lambda cond, at: [r[0] for r in names.where(cond).select(F.substring("anchor", at, F.lit(1))).distinct().collect()]
        return cls([(r["n"], r["l"], r["r"]) for r in rows if r["n"]], {r["w"] for r in rows if not r["n"]}, beside("l > 0", F.col("l")), beside("r > 0", F.col("l") + F.col("n") + 1))

    def __call__(self, text: str | None) -> set[str]:
        text = text or ""
        out = {w for w in set(_RUN.findall(text)) if len(w) in self.plain} if self.plain else set()
        for stretch in self.sided.finditer(text) if self.sided else ():
            for m in _RUN.finditer(text, *stretch.span()):
                i, end = m.span()
                shapes = self.shapes.get(end - i)
                if shapes:
                    beside = (bool(i) and text[i - 1] in self.before) + 2 * (end < len(text) and text[end] in self.after)
                    for kind in (1, 2, 3):
                        if kind & beside == kind:
                            out.update(text[i - left : end + right] for left, right in shapes[kind - 1] if i >= left and end + right <= len(text))
        for gap in _RUN.split(text) if self.windows else ():
            if len(gap) >= self.windows[0]:
                for n in self.windows:
                    out.update(gap[i : i + n] for i in range(len(gap) - n + 1))
        return out


def annotate_joined(chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """`annotate` with every name of `entries(name)`.

    Up to MAX_NAMES names are broadcast as one automaton; more are joined with the texts' anchors, and each chunk gets its own.
    """
    tables.small_batches(chunks.sparkSession)
    names = with_anchors(entries)
    rows = names.select("name").limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        return _annotate_beyond(chunks, names)
    return annotate(chunks, [r["name"] for r in rows])


def _annotate_beyond(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """Anchors of texts meet those of names by their hashes (two numbers a row); names that only share a hash aren't found in the text. A text is shuffled once, to its names."""
    find = Anchors.of(names)

    @F.pandas_udf("array<string>")
    def anchors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: list(find(t)))

    @F.pandas_udf("content string, n_linked int")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, keys in batches:
            yield pd.DataFrame([annotate_text(t, Names(k if k is not None else [])) for t, k in zip(texts, keys)], columns=["content", "n_linked"])

    sought = chunks.select("chunk_id", F.explode(anchors("content")).alias("anchor")).select("chunk_id", F.xxhash64("anchor").alias("anchor"))
    found = sought.join(names.select("name", F.xxhash64("anchor").alias("anchor")), "anchor")
    own = found.groupBy(F.col("chunk_id").alias("own_id")).agg(F.collect_list("name").alias("names"))
    joined = chunks.join(own, chunks["chunk_id"].eqNullSafe(own["own_id"]), "left").drop("own_id")
    return joined.withColumn("x", run("content", "names")).withColumns({"content": F.col("x.content"), "n_linked": F.col("x.n_linked")}).drop("x", "names")


def missing_names(chunks: DataFrame, names: list[str]) -> Column:
    """The names that stand in a chunk's content without a link."""
    box = chunks.sparkSession.sparkContext.broadcast(names)

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Names(box.value)
        for s in batches:
            yield s.map(lambda t: missing_in_text(t, known))

    return run("content")


def missing_links(chunks: DataFrame, names: list[str]) -> DataFrame:
    """(chunk_id, name) of names that stand in a chunk without a link."""
    return chunks.select("chunk_id", F.explode(missing_names(chunks, names)).alias("name"))


def contexts(content: Column, names: Column) -> Column:
    @F.pandas_udf("string")
    def run(text: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([context_of(t or "", list(k) if k is not None else []) for t, k in zip(text, keys)])

    return run(content, names)


def snippets(content: Column, names: Column) -> Column:
    @F.pandas_udf("array<struct<start:int,end:int,mentions:int,text:string>>")
    def run(text: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([snippets_of(t or "", list(k) if k is not None else []) for t, k in zip(text, keys)])

    return run(content, names)
