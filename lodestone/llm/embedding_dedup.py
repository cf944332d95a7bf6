"""Operator 5, embedding near-dedup: a hierarchical navigable small-world graph per shard.

1. Vectors that are null, zero or not finite link with nothing. Equal vectors are one class with a count.
2. Classes are dealt to shards by hash (`SHARDS`, more where a shard would pass `SHARD_ROWS`), and
   each task builds its shard's graph: levels drawn from the id's hash, insertion in batches that grow
   with the graph, links kept to the `M` nearest (twice that at the bottom).
3. Every class queries every shard, in blocks that stream past the shard's graph; a task takes at most
   about `TASK_QUERIES` of them. A beam that ends inside the
   threshold is widened for that query, by flooding the graph from the hits, until its worst entry
   lies outside. Each block of queries is audited against brute force over the shard: probes are drawn until `AUDIT` of them have
   links to others there (or `MOST_PROBES` are drawn), and the beam doubles until the mean recall of those probes' links
   reaches `RECALL`, each probe counting once however many links it has; past the last beam everything is compared.
4. Cosines are verified in double precision. A task returns the count of links of each query and a
   spanning forest of its links, never all pairs of a dense group; forests are joined into components.

Defined results: unusable vectors have n_links 0, their own component, and are kept; copies count as
links of each other; vectors of different lengths never link; repeated vec_ids are one vector a row and
share their component; a null vec_id is left out of components; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._shared import components, materialize, table

THRESHOLD, SHARDS, SHARD_ROWS, TASK_QUERIES, BLOCK = 0.9, 8, 1_000_000, 1_000_000, 4096
M, BUILD_BEAM, BEAM, AUDIT, MOST_PROBES, RECALL, LOCKSTEP = 12, 48, 32, 48, 192, 0.97, 128


class Graph:
    """Navigable small-world graph over unit vectors; all searches advance many queries in lockstep."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.x = vectors.astype(np.float32)
        n = len(vectors)
        u = np.array([(xxhash.xxh3_64_intdigest(int(i).to_bytes(8, "little", signed=True)) >> 11) / (1 << 53) for i in ids])
        self.level = np.minimum((-np.log(np.maximum(u, 1e-12)) / math.log(M)).astype(int), 6)
        order = np.argsort(-self.level, kind="stable")  # upper levels first: the first vector is the entry of all
        self.entry = int(order[0]) if n else -1
        self.links: list[np.ndarray] = [np.full((n, 2 * M if lv == 0 else M), -1, np.int32) for lv in range((int(self.level.max()) if n else 0) + 1)]
        done = 1
        while done < n:
            batch = order[done : done + max(1, min(done // 2, 512))]
            self._insert(batch, order[:done])
            done += len(batch)

    def _insert(self, batch: np.ndarray, before: np.ndarray) -> None:
        top = len(self.links) - 1
        start = np.full(len(batch), self.entry)
        for lv in range(top, -1, -1):
            here = self.level[batch] >= lv
            if not (self.level[before] >= lv).sum():
                continue
            found, _ = self.search_level(self.x[batch], start, lv, BUILD_BEAM if here.any() else 1)
            start = found[:, 0]
            if not here.any():
                continue
            rows = batch[here]
            near = found[here]
            # vectors of the batch see each other too
            sims = self.x[rows] @ self.x[rows].T
            np.fill_diagonal(sims, -2)
            k = min(M, len(rows) - 1)
            mates = rows[np.argpartition(-sims, k - 1, 1)[:, :k]] if k > 0 else np.empty((len(rows), 0), int)
            both = np.concatenate([near, mates], 1)
            score = np.einsum("ijk,ik->ij", self.x[np.maximum(both, 0)], self.x[rows])
            score[both < 0] = -2
            width = self.links[lv].shape[1]
            pick = np.argsort(-score, 1)[:, :M]
            chosen = np.take_along_axis(both, pick, 1)
            chosen[np.take_along_axis(score, pick, 1) <= -2] = -1
            self.links[lv][rows, : chosen.shape[1]] = chosen
            self._link_back(lv, rows, chosen, width)

    def _link_back(self, lv: int, rows: np.ndarray, chosen: np.ndarray, width: int) -> None:
        """Add reverse links; a full vertex keeps its nearest half and, of the rest, the newest, so old regions stay reachable."""
        src, dst = np.repeat(rows, chosen.shape[1]), chosen.ravel()
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        cuts = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(dst)]):
            v = dst[lo]
            mine = self.links[lv][v]
            every = np.unique(np.r_[mine[mine >= 0], src[lo:hi]])
            every = every[every != v]
            if len(every) > width:
                s = self.x[every] @ self.x[v]
                order = np.argsort(-s)
                near, far = every[order[: width // 2]], every[order[width // 2 :]]
                # of the farther ones keep those that no kept vertex stands before
                kept = [*near.tolist()]
                covered = (self.x[far] @ self.x[near].T).max(1) > self.x[far] @ self.x[v]
                kept += far[~covered].tolist() + far[covered].tolist()
                every = np.array(kept[:width])
            mine[:] = -1
            mine[: len(every)] = every

    def search_level(self, q: np.ndarray, start: np.ndarray, lv: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best `beam` vertices for each query by beam search from `start`: (vertices or -1, similarities)."""
        links, n, b = self.links[lv], len(self.x), len(q)
        ids = np.full((b, beam), -1, np.int64)
        sim = np.full((b, beam), -2.0, np.float32)
        opened = np.zeros((b, beam), bool)
        seen = np.zeros((b, n), bool)
        ids[:, 0] = start
        sim[:, 0] = np.einsum("ij,ij->i", self.x[start], q)
        seen[np.arange(b), start] = True
        alive = np.arange(b)
        while len(alive):
            s = np.where(opened[alive] | (ids[alive] < 0), -3.0, sim[alive])
            best = s.argmax(1)
            go = s[np.arange(len(alive)), best] > -2.5
            alive, best = alive[go], best[go]
            if not len(alive):
                break
            opened[alive, best] = True
            near = links[ids[alive, best]].astype(np.int64)
            fresh = (near >= 0) & ~seen[alive[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(fresh)
            seen[alive[r], near[r, c]] = True
            cand = np.full(near.shape, -2.0, np.float32)
            cand[r, c] = np.einsum("ij,ij->i", self.x[near[r, c]], q[alive[r]])
            near = np.where(fresh, near, -1)
            all_ids, all_sim = np.concatenate([ids[alive], near], 1), np.concatenate([sim[alive], cand], 1)
            all_open = np.concatenate([opened[alive], np.zeros(near.shape, bool)], 1)
            top = np.argpartition(-all_sim, beam - 1, 1)[:, :beam]
            ids[alive], sim[alive], opened[alive] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sim, all_open))
        order = np.argsort(-sim, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)

    def within(self, q: np.ndarray, threshold: float, beam: int) -> list[np.ndarray]:
        """For each query the vertices found with a similarity of `threshold` or more."""
        out: list[np.ndarray] = []
        step = max(1, min(LOCKSTEP, 64_000_000 // max(len(self.x), 1)))
        for lo in range(0, len(q), step):
            part = q[lo : lo + step]
            start = np.full(len(part), self.entry)
            for lv in range(len(self.links) - 1, 0, -1):
                start = self.search_level(part, start, lv, 1)[0][:, 0]
            ids, sim = self.search_level(part, start, 0, beam)
            for i in range(len(part)):
                hits = ids[i][(sim[i] >= threshold) & (ids[i] >= 0)]
                out.append(hits if len(hits) < beam else self._flood(part[i], hits, threshold))
        return out

    def _flood(self, q: np.ndarray, hits: np.ndarray, threshold: float) -> np.ndarray:
        """Widen a beam that is full of hits: follow links from hits until all new vertices lie outside."""
        inside = np.zeros(len(self.x), bool)
        tried = np.zeros(len(self.x), bool)
        inside[hits] = tried[hits] = True
        while len(hits):
            near = np.unique(self.links[0][hits])
            near = near[(near >= 0)]
            near = near[~tried[near]]
            tried[near] = True
            hits = near[self.x[near] @ q >= threshold]
            inside[hits] = True
        return np.flatnonzero(inside)


def audited(graph: Graph, q: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """`Graph.within` at the first beam whose audit passes; compares everything where none does. `own`: each query's vertex, or -1."""
    edge = THRESHOLD - 1e-4  # float32 search; double precision decides
    truth: dict[int, np.ndarray] = {}
    for i in np.random.default_rng(len(q)).permutation(len(q))[:MOST_PROBES].tolist():
        near = np.flatnonzero(graph.x @ q[i] >= edge)
        near = near[near != own[i]]  # finding itself proves nothing
        if len(near):
            truth[i] = near
        if len(truth) == AUDIT:
            break
    probe = np.array(list(truth), int)
    beam = BEAM
    while beam <= 512 and beam < len(graph.x):
        got = graph.within(q[probe], edge, beam) if len(probe) else []
        if not truth or np.mean([len(np.intersect1d(a, b)) / len(a) for a, b in zip(truth.values(), got)]) >= RECALL:
            return graph.within(q, edge, beam)
        beam *= 2
    return [np.flatnonzero(graph.x @ v >= edge) for v in q]


class Forest:
    """Union-find over vertices 0..n-1 that remembers the edges that joined sets."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            a, b = self.find(i), self.find(j)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                self.edges.append((i, j))


def _unit(x: pd.Series) -> np.ndarray:
    v = np.stack([np.asarray(a, np.float64) for a in x])
    return v / np.sqrt((v * v).sum(1, keepdims=True))


class Shard:
    """A shard's graph, and the answers to queries: rows (cls, n, other), links of a query counted (other
    null) or an edge of the spanning forest of all links found by this task so far (n null)."""

    def __init__(self, rows: pd.DataFrame):
        self.x, self.ids, self.weight = _unit(rows["embedding"]), rows["cls"].to_numpy(), rows["n"].to_numpy()
        self.graph = Graph(self.x, self.ids)
        self.place = {int(c): i for i, c in enumerate(self.ids)}

    def answer(self, part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        q, mine = _unit(part["embedding"]), part["cls"].to_numpy()
        n = len(self.x)
        forest = Forest(n + len(q))
        counts = np.zeros(len(q), np.int64)
        own = np.array([self.place.get(int(c), -1) for c in mine])
        for i, found in enumerate(audited(self.graph, q.astype(np.float32), own)):
            found = found[(self.x[found] @ q[i]) >= THRESHOLD] if len(found) else found
            found = found[self.ids[found] != mine[i]]
            counts[i] = self.weight[found].sum()
            forest.join(self.place.get(int(mine[i]), n + i), found)
        yield pd.DataFrame({"cls": mine, "n": counts, "other": pd.array([None] * len(q), "Int64")})
        if forest.edges:
            name = lambda k: int(self.ids[k]) if k < n else int(mine[k - n])
            a, b = zip(*((name(i), name(j)) for i, j in forest.edges))
            yield pd.DataFrame({"cls": a, "n": pd.array([None] * len(a), "Int64"), "other": b})


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (task, side): a task's shard (side 0), then its queries (side 1), which stream past it."""
    task, stored, shard = None, [], None
    for b in batches:
        for (t, side), part in b.groupby(["task", "side"], sort=False):
            if t != task:
                task, stored, shard = t, [], None
            if side == 0:
                stored.append(part)
                continue
            if shard is None and stored:
                shard, stored = Shard(pd.concat(stored, ignore_index=True)), []
            for lo in range(0, len(part) if shard else 0, BLOCK):
                yield from shard.answer(part.iloc[lo : lo + BLOCK])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that can link."""
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return d.where(F.coalesce(fine & F.exists("embedding", lambda x: x != 0), F.lit(False)))


def link(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors`."""
    spark = vectors.sparkSession
    good = usable(vectors).withColumn("cls", F.xxhash64(F.concat_ws(",", F.transform("embedding", lambda x: F.hex(F.encode(x.cast("string"), "utf-8"))))))
    rows = materialize(good.select("vec_id", "cls", "embedding"), "vector-rows")
    classes = materialize(rows.groupBy("cls").agg(F.first("embedding").alias("embedding"), F.count("*").alias("n")).withColumn("dim", F.size("embedding")), "vector-classes")
    n = classes.count()
    shards = max(SHARDS, -(-n // SHARD_ROWS))
    blocks = max(1, -(-n // TASK_QUERIES))
    of = lambda salt, k: F.pmod(F.xxhash64(F.lit(salt), "cls"), F.lit(k))
    kept = classes.select("cls", "embedding", "n", "dim", of("shard", shards).alias("shard"), of("block", blocks).alias("block"))
    dims = sorted(r["dim"] for r in classes.select("dim").distinct().collect())  # lengths of vectors, few
    kind = F.array_position(F.array(*[F.lit(x) for x in dims]), F.col("dim")) - 1
    name = lambda s, b: ((kind * shards + s) * blocks + b).cast("int")
    stored = kept.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")).select(name(F.col("shard"), F.col("b").cast("long")).alias("task"), F.lit(0).alias("side"), "cls", "embedding", "n")
    asked = kept.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s")).select(name(F.col("s").cast("long"), F.col("block")).alias("task"), F.lit(1).alias("side"), "cls", "embedding", "n")
    tasks = stored.unionByName(asked).repartitionById(max(1, len(dims) * shards * blocks), "task").sortWithinPartitions("task", "side", "cls")
    found = materialize(tasks.mapInPandas(_run, "cls long, n long, other long"), "vector-found")
    counts = found.where("other IS NULL").groupBy("cls").agg(F.sum("n").alias("links"))
    comp = components(found.where("other IS NOT NULL").select(F.col("cls").alias("a"), F.col("other").alias("b")), "vector")
    per_class = classes.select("cls", "n").join(counts, "cls", "left").join(comp, F.col("cls") == F.col("node"), "left")
    per_class = per_class.select("cls", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cls").alias("comp"))
    placed = materialize(rows.select("vec_id", "cls").join(per_class, "cls").select("vec_id", "n_links", "comp"), "vector-placed")
    smallest = placed.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    linked = placed.join(smallest, "comp").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    alone = d.where(~F.coalesce(fine & F.exists("embedding", lambda x: x != 0), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))


QUERIES = {"op5_embedding_dedup": op5_embedding_dedup}
ORACLES: dict[str, str] = {}
