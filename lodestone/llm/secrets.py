"""Operator 7, secret scans: probabilistic automata inferred from labelled credentials.

Patterns find the base spans. Credentials they label (a sample of at most `SAMPLE` distinct values of up to `TEACHES` symbols a
kind, the ones with the smallest hashes) train one probabilistic automaton a kind: a prefix tree of
symbol classes whose statistically compatible states are merged (Hoeffding bound, red-blue order).
Candidates outside the base spans (at most `SAMPLE`, chosen likewise, without those that look like credentials beside
the other half of them) train the background automaton. Every
candidate string of every text (12 symbols or more of the alphabet that labelled values have) is then scored by the log-likelihood
ratio of the best format against the background, and kept as kind `learned` where that exceeds `MARGIN` a symbol and it
doesn't overlap a base span. Scans are per document; only the samples and automata reach the driver.

Defined results: a null text is empty; ties and repeated rows are judged alike; an empty table or a
corpus without credentials adds nothing; null doc_ids pass through; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._shared import materialize, table

KINDS = ["assign", "access", "hex", "learned"]
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is entered at its first character, as a whole
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{10,}[A-Za-z0-9+/_=-]")  # dots inside, as at an end they close a sentence
KEYWORD = re.compile(r"(?ai:passw|secret|token|api)")
SAMPLE, MARGIN, ALPHA, TEACHES, ROUNDS, REMEMBERED = 1500, 0.35, 0.05, 128, 3, 200_000


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed; matches that fail are dropped."""
    out = []
    if KEYWORD.search(text):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _class(c: str) -> str:
    if "0" <= c <= "9":
        return "d"
    if "a" <= c <= "f":
        return "h"
    if "A" <= c <= "F":
        return "H"
    return "l" if "g" <= c <= "z" else "U" if "G" <= c <= "Z" else c


_CLASSES = {chr(i): _class(chr(i)) for i in range(128)}


def symbols(value: str) -> list[str]:
    return [_CLASSES.get(c, "?") for c in value]


class Automaton:
    """Probabilistic automaton: per state the visits, the endings, and symbol -> (next state, count)."""

    ALPHABET = 16

    def __init__(self) -> None:
        self.visits, self.ends, self.next = [0], [0], [{}]

    def add(self, word: list[str]) -> None:
        s = 0
        self.visits[0] += 1
        for c in word:
            to, n = self.next[s].get(c, (None, 0))
            if to is None:
                to = len(self.visits)
                self.visits.append(0)
                self.ends.append(0)
                self.next.append({})
            self.next[s][c] = (to, n + 1)
            s = to
            self.visits[s] += 1
        self.ends[s] += 1

    def compiled(self) -> list[tuple[float, float, dict[str, tuple[int, float]]]]:
        """Per state: log-probability of an unseen symbol, of ending, and of each symbol with the next state."""
        out = []
        for n, ends, nxt in zip(self.visits, self.ends, self.next):
            all_ = math.log(n + 0.05 * (self.ALPHABET + 1))
            out.append((math.log(0.05) - all_, math.log(ends + 0.05) - all_, {c: (to, math.log(k + 0.05) - all_) for c, (to, k) in nxt.items()}))
        return out

    @staticmethod
    def log_likelihood(table: list, word: list[str]) -> float:
        s, total, unknown = 0, 0.0, -math.log(Automaton.ALPHABET + 1)
        for i, c in enumerate(word):
            step = table[s][2].get(c)
            if step is None:
                return total + table[s][0] + unknown * (len(word) - i - 1)
            s = step[0]
            total += step[1]
        return total + table[s][1]


def infer(values: list[str], alpha: float = ALPHA) -> Automaton:
    """Merge compatible states of the values' prefix tree, nearest to the root first."""
    a = Automaton()
    for v in values:
        a.add(symbols(v))
    visits, ends, nxt = a.visits, a.ends, a.next
    root = math.sqrt(0.5 * math.log(2 / alpha))
    differ = lambda f1, n1, f2, n2: n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > root * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(p: int, q: int) -> bool:
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            if differ(ends[p], visits[p], ends[q], visits[q]):
                return False
            for c in nxt[p].keys() | nxt[q].keys():
                (x, n), (y, m) = nxt[p].get(c, (None, 0)), nxt[q].get(c, (None, 0))
                if differ(n, visits[p], m, visits[q]):
                    return False
                if x is not None and y is not None and x != p:
                    stack.append((x, y))
        return True

    def fold(p: int, q: int) -> None:
        """Add the tree below q to p."""
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            visits[p] += visits[q]
            ends[p] += ends[q]
            for c, (y, m) in nxt[q].items():
                if c in nxt[p]:
                    x, n = nxt[p][c]
                    nxt[p][c] = (x, n + m)
                    stack.append((x, y))
                else:
                    nxt[p][c] = (y, m)

    red, blue = [0], [(0, c) for c in sorted(nxt[0])]
    while blue:
        blue.sort(key=lambda e: -visits[nxt[e[0]][e[1]][0]])
        p, c = blue.pop(0)
        q, n = nxt[p][c]
        if q in red:
            continue
        for r in red:
            if compatible(r, q):
                nxt[p][c] = (r, n)
                fold(r, q)
                break
        else:
            red.append(q)
        blue = [(r, x) for r in red for x in sorted(nxt[r]) if nxt[r][x][0] not in red]
    return a


class Formats:
    """The kinds' automata and the background; `score` is the best log-likelihood ratio a symbol."""

    def __init__(self, formats: dict[str, Automaton], background: Automaton):
        self.formats, self.background = [a.compiled() for a in formats.values()], background.compiled()
        self.known: dict[str, float] = {}

    def score(self, value: str) -> float:
        if not self.formats:
            return -math.inf
        got = self.known.get(value)
        if got is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            w = symbols(value)
            got = (max(Automaton.log_likelihood(a, w) for a in self.formats) - Automaton.log_likelihood(self.background, w)) / (len(w) + 1)
            if len(value) < 64:
                self.known[value] = got
        return got


def outside(text: str, spans: list[tuple[str, int, int]]) -> Iterator[re.Match]:
    """Candidates that overlap none of the spans, which are sorted by start; one pass over both."""
    i, reach = 0, 0
    for m in CANDIDATE.finditer(text):
        while i < len(spans) and spans[i][1] < m.end():
            reach = max(reach, spans[i][2])
            i += 1
        if reach <= m.start():
            yield m


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, value, h): per split the `SAMPLE` values of each kind, and of the other candidates, with the smallest hashes."""
    kept: dict[str, dict[str, int]] = {k: {} for k in ("assign", "access", "hex", "word")}

    def offer(kind: str, value: str) -> None:
        mine = kept[kind]
        if value not in mine and len(value) <= TEACHES:
            mine[value] = xxhash.xxh3_64_intdigest(value.encode()) >> 1
            if len(mine) > 4 * SAMPLE:
                kept[kind] = dict(heapq.nsmallest(SAMPLE, mine.items(), key=lambda x: x[1]))

    for b in batches:
        for text in b.column(0).to_pylist():
            text = text or ""
            spans = base_spans(text)
            for kind, s, e in spans:
                offer(kind, (ASSIGN.match(text, s)[1] if kind == "assign" else text[s:e]))
            for m in outside(text, spans):
                offer("word", m[0])
    rows = [(k, v, h) for k, mine in kept.items() for v, h in heapq.nsmallest(SAMPLE, mine.items(), key=lambda x: x[1])]
    if rows:
        k, v, h = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(v), pa.array(h, pa.int64())], ["kind", "value", "h"])


def either_case(values: list[str]) -> list[str]:
    """Words in capitals are as ordinary as words are."""
    return values + [v.upper() for v in values if v.isalpha()]


def train(docs: DataFrame) -> Formats:
    found = materialize(docs.select("text").mapInArrow(_labelled, "kind string, value string, h long"), "secret-samples")
    sample = {k: [r["value"] for r in found.where(F.col("kind") == k).dropDuplicates(["value"]).orderBy("h", "value").limit(SAMPLE).collect()] for k in ("assign", "access", "hex", "word")}
    formats = {k: infer(v) for k, v in sample.items() if k != "word" and v}
    # credentials among the candidates must not teach what is ordinary: each half is judged beside what is left of the other
    halves = [sample["word"][0::2], sample["word"][1::2]]
    left = halves
    for _ in range(ROUNDS):
        rough = [Formats(formats, infer(either_case(left[1 - k]))) for k in (0, 1)]
        left = [[w for w in halves[k] if rough[k].score(w) <= 0] for k in (0, 1)]
    return Formats(formats, infer(either_case(left[0] + left[1])))


def scan(text: str, formats: Formats) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans by start, then kind."""
    base = base_spans(text)
    more = [("learned", *m.span()) for m in outside(text, base) if formats.score(m[0]) > MARGIN]
    return base, sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0])))


def _scan(box):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formats = box.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64())]))
        for b in batches:
            base, every = [], []
            for text in b.column(1).to_pylist():
                x, y = scan(text or "", formats)
                base.append([{"kind": k, "s": s, "e": e} for k, s, e in x])
                every.append([{"kind": k, "s": s, "e": e} for k, s, e in y])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(base, kind), pa.array(every, kind)], ["doc_id", "base", "spans"])

    return run


def find(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """doc_id, base and spans (arrays of kind, s, e) for every row of `docs`."""
    box = docs.sparkSession.sparkContext.broadcast(formats or train(docs))
    spans = "array<struct<kind:string,s:bigint,e:bigint>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan(box), f"doc_id long, base {spans}, spans {spans}")


def joined(spans: str):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter(F.transform("base", lambda x: x["kind"]), F.lit(k).eqNullSafe)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return out.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op7_secrets": op7_secrets}
ORACLES: dict[str, str] = {}
