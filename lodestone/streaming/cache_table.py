"""The result cache as a table that batches of queries share: exact key, then nearest query, eviction by last use.

A batch reads one state of the cache and writes the next, a folder of its own that counts once it is complete, so a run that is cut off
leaves the last state. The state has at most `capacity` rows, which is what bounds its broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.vectors import cosine
from lodestone.sources import tables

KEY = ["key_query", "policy", "entities"]


class CacheTable:
    """At most `capacity` entries of one version, the least recently used left out first; another version starts empty.

    In a batch all lookups come before all saves, each in the order of query_id. A key is saved once a batch, at its first miss. The nearest
    entry has the same policy, whatever its entities; of equally near ones the one with the greatest key counts. The rows equal those of
    `SemanticCache` asked in that order.
    """

    MAX_CAPACITY = 10_000

    def __init__(self, spark: SparkSession, path: str, capacity: int = 200, threshold: float = 0.92):
        if capacity > self.MAX_CAPACITY:
            raise ValueError(f"more than {self.MAX_CAPACITY} entries")
        self.spark, self.path, self.capacity, self.threshold = spark, path.rstrip("/"), capacity, threshold

    def _folder(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """The numbers of the complete states."""
        folder, fs = self._folder()
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        found = [int(n.removeprefix("state-")) for n in names if n.startswith("state-") and n.removeprefix("state-").isdigit()]
        return sorted(n for n in found if tables.exists(self.spark, f"{self.path}/state-{n}/_SUCCESS"))

    def state(self) -> DataFrame | None:
        """(key_query, policy, entities, version, embedding, results, used) of the last batch; None before the first."""
        known = self.batches()
        return self.spark.read.parquet(f"{self.path}/state-{known[-1]}") if known else None

    def _used(self, batch: int, phase: int, seq: Column) -> Column:
        return F.struct(F.lit(batch).alias("batch"), F.lit(phase).alias("phase"), seq.cast("long").alias("seq"))

    def answer(self, queries: DataFrame, version: str, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(query_id, results, tier) for every row of `queries(query_id, query, embedding, policy, entities)`, whose query_id is a key.

        tier is exact, near or searched. `search` gets the rows of `queries` that neither tier answers, one of each key, and
        returns (query_id, results); those it returns no row for are neither saved nor answered (results null). A null query is an empty
        one, a null policy an empty one, null entities none; a query without an embedding has no near tier.
        """
        batch = (self.batches() or [0])[-1] + 1
        keys = {"key_query": F.lower(F.trim(F.coalesce("query", F.lit("")))), "policy": F.coalesce("policy", F.lit("")), "entities": F.array_sort(F.coalesce("entities", F.array().cast("array<string>")))}
        q = tables.written(queries.withColumns(keys), "cache-queries")
        old = self.state()
        old = old.where(F.col("version") == version) if old is not None else None
        hits = self._hits(q, old) if old is not None else None
        missed = q if hits is None else q.join(hits.select("query_id"), "query_id", "left_anti")
        first = missed.groupBy(*KEY).agg(F.min("query_id").alias("query_id"))
        asked = missed.join(first.select("query_id"), "query_id", "left_semi")
        got = tables.written(search(asked.drop("key_query")).select("query_id", "results"), "cache-searched")
        found = first.join(got, "query_id").select(*KEY, "query_id", "results")
        fresh = found.join(asked.select("query_id", "embedding"), "query_id").select(*KEY, F.lit(version).alias("version"), "embedding", "results", self._used(batch, 1, F.col("query_id")).alias("used"))
        rows = fresh
        if hits is not None:
            touched = hits.groupBy(*[F.col(f"entry.{k}").alias(k) for k in KEY]).agg(F.max("query_id").alias("seq"))
            kept = old.join(touched, KEY, "left").withColumn("used", F.when(F.col("seq").isNotNull(), self._used(batch, 0, F.col("seq"))).otherwise(F.col("used"))).drop("seq")
            rows = kept.unionByName(fresh)
        rows.orderBy(F.desc("used")).limit(self.capacity).write.mode("overwrite").parquet(f"{self.path}/state-{batch}")
        self._forget(batch - 1)
        searched = missed.select("query_id", *KEY).join(found.select(*KEY, "results"), KEY, "left").select("query_id", "results", F.lit("searched").alias("tier"))
        return searched if hits is None else hits.select("query_id", "results", "tier").unionByName(searched)

    def _hits(self, q: DataFrame, old: DataFrame) -> DataFrame:
        """(query_id, entry, results, tier), an entry being a key of the cache."""
        entry = F.struct(*KEY).alias("entry")
        exact = q.join(F.broadcast(old.select(*KEY, "results")), KEY).select("query_id", entry, "results", F.lit("exact").alias("tier"))  # `capacity` rows
        rest = q.join(F.broadcast(old.select(*KEY)), KEY, "left_anti").where("embedding IS NOT NULL").select("query_id", "embedding", "policy")
        near = old.where("embedding IS NOT NULL").select(entry, F.col("embedding").alias("other"), "results", "policy")
        met = rest.join(F.broadcast(near), "policy").withColumn("share", cosine(F.col("embedding"), F.col("other"))).where(F.col("share") >= self.threshold)
        best = met.groupBy("query_id").agg(F.max_by(F.struct("entry", "results"), F.struct("share", "entry")).alias("b"))
        return tables.written(exact.unionByName(best.select("query_id", "b.entry", "b.results", F.lit("near").alias("tier"))), "cache-hits")

    def _forget(self, batch: int) -> None:
        """Drop the states before `batch`, which a reader may still have open."""
        folder, fs = self._folder()
        for n in self.batches():
            if n < batch:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state-{n}"), True)
