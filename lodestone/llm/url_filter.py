"""Operator 9, URL filters: Bloom filter cascade over the corpus's complete key universe.

Keys are tested, never joined: level 1 encodes the listed keys, level 2 the unlisted keys of the
corpus that level 1 passes by mistake, level 3 the listed keys that level 2 passes, and so on until
a level makes no mistake. As the universe holds every key that can be asked, membership is exact.
Every level mixes a key's two hashes with its own number, so keys that collide on one level part on the next.
Each level is built from DataFrame aggregates (one row per 64-bit word of the filter) and only the
filters themselves are broadcast. A level has enough bits to pass no more keys by mistake than it holds, so the next one is no larger: with L
listed keys among U all filters together take about 1.44 L log2(U / L) bits. More than `MAX_LISTED` keys in a level
aren't broadcast but joined.

Two cascades serve `judge`: one holds the rules' (host, path) keys, the other the listed hosts
(the table `blocked(host)`, or, without one, hosts of the corpus with a label from `BLOCKED_WORDS`).
A rule fits its host and all subdomains if the path starts with the rule's; the longest key (host
and path together, then host) wins. Without a rule, a host in the second cascade is blocked, any
other allowed.

Defined results: a null url or one without `://` has empty host and path, no rule, and is allowed;
repeated urls are judged alike; an empty table gives an empty result; an empty list passes nothing;
null page_ids and further columns pass through `judge`; columns named as its results give way to them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._shared import materialize, table

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: A host is listed if one of its labels, split at hyphens, is among these.
BLOCKED_WORDS = ["casino", "bets", "poker", "porn", "xxx", "pills", "loan", "win"]
MAX_LISTED, MAX_LEVELS = 50_000_000, 64


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit of the input moves every bit of the output."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def salted(h1: np.ndarray, h2: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """A key's hashes on one level. Each depends on all bits of both, so only keys equal in both collide on every level."""
    a, b = (np.uint64((2 * level + i) * 0x9E3779B97F4A7C15 % 2**64) for i in (1, 2))
    return _mixed(h1 ^ _mixed(h2 + a)), _mixed(h2 ^ _mixed(h1 + b)) | np.uint64(1)


class Bloom:
    """The filter of level number `level`: `bits` is a power of two, `hashes` positions per key by double hashing."""

    def __init__(self, words: np.ndarray, hashes: int, level: int):
        self.words, self.hashes, self.level = words, hashes, level

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        h1, h2 = salted(h1, h2, self.level)
        size = np.uint64(len(self.words) * 64)
        out = np.ones(len(h1), bool)
        for k in range(self.hashes):
            p = (h1 + np.uint64(k) * h2) % size
            out &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


class Cascade:
    """Exact membership for every key of the universe it was built over."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The first level that rejects a key decides: an odd level rejects unlisted keys, an even one listed keys."""
        if not self.levels:
            return np.zeros(len(h1), bool)
        inside = np.full(len(h1), len(self.levels) % 2 == 1)
        undecided = np.arange(len(h1))
        for depth, level in enumerate(self.levels):
            passed = level.holds(h1[undecided], h2[undecided])
            inside[undecided[~passed]] = depth % 2 == 1
            undecided = undecided[passed]
        return inside


def hashed(key: Column, salt: int) -> list[Column]:
    return [F.xxhash64(F.lit(f"a{salt}"), key), F.xxhash64(F.lit(f"b{salt}"), key).bitwiseOR(F.lit(1))]


def _salt(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = salted(*(b.column(k).to_numpy().view(np.uint64) for k in (0, 1)), level)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in h], ["h1", "h2"])

    return run


def build_level(keys: DataFrame, n: int, others: int, level: int) -> Bloom:
    """Bloom filter of `keys(h1, h2)` for a level that is asked for `others` more: distributed OR of words, then the words alone reach the driver."""
    k = min(max(math.ceil(math.log2(max(others, 1) / n)) if others > n else 0, 7), 40)
    size = 1 << max(10, math.ceil(math.log2(n * k / math.log(2))))
    spots = keys.mapInArrow(_salt(level), "h1 long, h2 long").select(F.explode(F.array(*[_low_bits(F.col("h1"), F.col("h2"), i, size) for i in range(k)])).alias("p"))
    words = spots.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words["w"].to_numpy()] = words["v"].to_numpy()
    return Bloom(out.view(np.uint64), k, level)


def _low_bits(h1: Column, h2: Column, i: int, size: int) -> Column:
    """(h1 + i * h2) mod 2^64 mod size; size is a power of two, so the low bits decide and can't overflow."""
    return (h1.bitwiseAND(size - 1) + F.lit(i) * h2.bitwiseAND(size - 1)).bitwiseAND(size - 1)


def _probe(level_box):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = level_box.value
        for b in batches:
            h1, h2 = (b.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            yield b.filter(pa.array(level.holds(h1, h2)))

    return run


def cascade(listed: DataFrame, universe: DataFrame, tag: str) -> Cascade | None:
    """Cascade over `universe(key)`; `listed(key)` names the keys it holds. Both may repeat keys. None if a level would pass `MAX_LISTED` keys."""
    spark = universe.sparkSession
    keyed = lambda d: d.select("key").distinct().select(*[c.alias(n) for c, n in zip(hashed(F.col("key"), 0), ("h1", "h2"), strict=True)])
    yes = materialize(keyed(listed), f"{tag}-yes")
    no = materialize(keyed(universe.select("key").distinct().join(listed.select("key").distinct(), "key", "left_anti")), f"{tag}-no")
    levels: list[Bloom] = []
    inside, outside = yes, no
    n, others = inside.count(), outside.count()
    while n and len(levels) < MAX_LEVELS:
        if n > MAX_LISTED:
            return None
        levels.append(build_level(inside, n, others, len(levels)))
        box = spark.sparkContext.broadcast(levels[-1])
        wrong = materialize(outside.mapInArrow(_probe(box), "h1 long, h2 long"), f"{tag}-level")
        inside, outside, others = wrong, inside, n
        n = inside.count()
    if n:
        raise ValueError("keys with equal 128-bit hashes on both sides")
    return Cascade(levels)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and all its parent domains, longest first."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))


def rule_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """All (suffix + path prefix) keys that a rule could have, the longest first."""
    prefixes = F.filter(F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: F.when(F.length(path) >= n, F.substring(path, F.lit(1), n))), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(suffixes(host), lambda s: F.transform(prefixes, lambda p: F.struct(F.length(F.concat(s, p)).alias("n"), F.length(s).alias("m"), F.concat(s, p).alias("k")))))
    return F.transform(F.sort_array(keys, asc=False), lambda x: x["k"])


def listed_hosts(hosts: DataFrame, words: list[str]) -> DataFrame:
    return hosts.where(F.arrays_overlap(F.split("key", "[.-]"), F.array(*[F.lit(w) for w in words])))


def _decide(rules_box, hosts_box):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, hosts = rules_box.value, hosts_box.value
        for b in batches:
            keys = b.column(b.schema.get_field_index("u_keys"))
            flat, size = keys.flatten(), np.asarray(keys.value_lengths().fill_null(0))
            h1, h2 = (np.asarray(flat.field(k)).view(np.uint64) for k in ("h1", "h2"))
            ok = rules.holds(h1, h2)
            owner = np.repeat(np.arange(len(size)), size)[ok]
            row, first = np.unique(owner, return_index=True)
            key = pa.array([None] * len(size), pa.string()).to_pylist()
            names = flat.field("k").take(pa.array(np.flatnonzero(ok)[first])).to_pylist()
            for r, name in zip(row.tolist(), names):
                key[r] = name
            g1, g2 = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("u_h1", "u_h2"))
            cols = [b.column(b.schema.get_field_index(c)) for c in ("u_row", "u_host", "u_path")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(key, pa.string()), pa.array(hosts.holds(g1, g2))], ["u_row", "u_host", "u_path", "u_key", "u_listed"])

    return run


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, words: list[str] = BLOCKED_WORDS, carry: tuple[str, ...] | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """`carry` columns (all but host, path, rule and verdict, if not given) with host, path, rule and verdict for every row of `pages`."""
    spark = pages.sparkSession
    lengths = sorted({len(p) for _, p, _ in rules})
    carry = tuple(c for c in pages.columns if c not in ("host", "path", "rule", "verdict")) if carry is None else carry
    d = pages.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("u_row"), host_of(F.col("url")).alias("u_host"), path_of(F.col("url")).alias("u_path"))
    d = d.withColumn("u_keys", rule_keys(F.col("u_host"), F.col("u_path"), lengths))
    listed_rules = spark.createDataFrame([(h + p,) for h, p, _ in rules], "key string")
    by_rule = cascade(listed_rules, d.select(F.explode("u_keys").alias("key")).distinct().unionByName(listed_rules), "url-rules")
    hosts = materialize(d.select(F.col("u_host").alias("key")).distinct(), "url-hosts")
    listed = listed_hosts(hosts, words) if blocked is None else hosts.join(blocked.select(F.lower("host").alias("key")).distinct(), "key", "left_semi")
    by_host = cascade(listed, hosts, "url-hosts")
    if by_rule is None:
        raise ValueError("more rules than a driver holds")
    a, b = hashed(F.col("u_host"), 0)
    d = d.withColumn("u_keys", F.transform("u_keys", lambda k: F.struct(*[c.alias(n) for c, n in zip(hashed(k, 0), ("h1", "h2"), strict=True)], k.alias("k")))).withColumns({"u_h1": a, "u_h2": b})
    row_type = d.schema["u_row"].dataType.simpleString()
    out = d.mapInArrow(_decide(spark.sparkContext.broadcast(by_rule), spark.sparkContext.broadcast(by_host or Cascade([]))), f"u_row {row_type}, u_host string, u_path string, u_key string, u_listed boolean")
    if by_host is None:  # too many listed hosts to broadcast
        out = out.drop("u_listed").join(listed.select(F.col("key").alias("u_host"), F.lit(True).alias("u_listed")), "u_host", "left")
    verdict = F.when(F.col("u_key").isNull(), F.when(F.col("u_listed"), "block").otherwise("allow"))
    for h, p, v in rules:
        verdict = verdict.when(F.col("u_key") == h + p, v)
    return out.select("u_row.*", F.col("u_host").alias("host"), F.col("u_path").alias("path"), F.col("u_key").alias("rule"), verdict.alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), carry=("page_id",))


def oracle() -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    words = ", ".join(f"'{w}'" for w in BLOCKED_WORDS)
    return f"""
WITH r(rh, rp, v) AS (VALUES {values}),
p AS (SELECT row_number() OVER () AS rid, page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
m AS (SELECT rid, arg_max(rh || rp, length(rh || rp) * 1000 + length(rh)) AS rule, arg_max(v, length(rh || rp) * 1000 + length(rh)) AS v
  FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN list_has_any(regexp_split_to_array(host, '[.-]'), [{words}]) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m USING (rid)"""


QUERIES = {"op9_url_filter": op9_url_filter}
ORACLES = {"op9_url_filter": oracle()}
