"""Versioned snapshots of a knowledge base, merged batch by batch and swapped by one manifest.

A snapshot is a set of tables, each cut into buckets by the document's hash. A merge writes new folders for the buckets that hold
changed documents and leaves all others where they are; then it adds a manifest, a small file that names every bucket's folder. The
manifest appears under its final name by a rename that never replaces a file, so a reader finds the old version or the new one,
a second writer of the same version fails, and a merge that dies leaves folders that no manifest names (`vacuum` removes them).
The manifest also holds the last batch of each stream that it contains: a batch that is replayed after a crash changes nothing.

All files are reached through Spark's file systems, so the store can lie wherever the session's tables can.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import bm25, chunking
from lodestone.sources import tables

CHANGE = "doc_id string, seq long, op string, content string, embedding array<double>"
SCHEMAS = {
    "documents": "doc_id string, content string, digest string",
    "chunks": "doc_id string, chunk_id string, content string",
    "postings": "doc_id string, term string, chunk_id string, tf long",
    "doc_len": "doc_id string, chunk_id string, dl long",
    "edges": "doc_id string, name string",
    "vectors": "doc_id string, embedding array<double>",
}
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has added the same version."""


class Store:
    """The versions under `root`."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # --- files ---

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    # --- manifests ---

    def manifest(self, version: int | None = None) -> dict:
        """A version's manifest, the latest by default; before the first one an empty version 0."""
        names = [n for n in self._names("manifests") if n.endswith(".json")]
        name = names[-1] if version is None and names else f"{version or 0:010d}.json"
        if name not in names:
            if version:
                raise ValueError(f"there is no version {version}")
            return {"version": 0, "applied": {}, "buckets": self.buckets, "tables": {t: {} for t in SCHEMAS}}
        stream = self._fs().open(self._path(f"manifests/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> dict:
        fs, final = self._fs(), self._path(f"manifests/{manifest['version']:010d}.json")
        temporary = self._path(f"manifests/{uuid.uuid4().hex}.tmp")
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise Conflict(f"version {manifest['version']} exists")
        return manifest

    # --- reading ---

    def table(self, name: str, version: int | None = None, manifest: dict | None = None) -> DataFrame:
        """A table of one version; the files are fixed when it is called, later merges don't touch them."""
        m = manifest or self.manifest(version)
        folders = sorted(set(m["tables"][name].values()))
        rows = self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], SCHEMAS[name])
        return rows

    def text_index(self, version: int | None = None) -> bm25.TextIndex:
        m = self.manifest(version)
        postings, doc_len = self.table("postings", manifest=m).select("term", "chunk_id", "tf"), self.table("doc_len", manifest=m).select("chunk_id", "dl")
        corpus = doc_len.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
        return bm25.TextIndex(postings, doc_len, postings.groupBy("term").agg(F.count("*").alias("df")), corpus)

    def ready(self) -> dict[str, int]:
        """Rows of each table of the latest version, as its merge counted them; empty before the first."""
        return self.manifest().get("rows", {})

    # --- merging ---

    def _bucket(self):
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def merge(self, changes: DataFrame, batch: int, stream: str = "changes", chunked: Callable[[DataFrame], DataFrame] = chunking.sliding) -> dict:
        """Merge a batch of `changes` (CHANGE): op 'delete' removes a document, any other replaces it; of one document the greatest seq counts.

        Returns the manifest that holds afterwards. A batch at or below the stream's last one, and one that changes no document, adds no version.
        """
        old = self.manifest()
        if batch <= old["applied"].get(stream, -1):
            return old
        if old["buckets"] != self.buckets:
            raise ValueError(f"the store has {old['buckets']} buckets")
        latest = Window.partitionBy("doc_id").orderBy(F.desc("seq"), "op", "content")
        last = changes.where("doc_id IS NOT NULL").withColumn("at", F.row_number().over(latest)).where("at = 1").drop("at")
        last = last.withColumns({"digest": F.md5(F.to_json(F.struct("content", "embedding"))), "bucket": self._bucket()})
        known = self.table("documents", manifest=old).select("doc_id", F.col("digest").alias("known"))
        deleted = F.col("op") == "delete"
        real = F.when(deleted, F.col("known").isNotNull()).otherwise(~F.col("known").eqNullSafe(F.col("digest")))
        changed = tables.written(last.join(known, "doc_id", "left").where(real).drop("known"), "changed")  # unchanged documents touch no bucket
        touched = [r[0] for r in changed.select("bucket").distinct().collect()]  # at most `buckets`
        folder, new = f"v{old['version'] + 1:010d}-{uuid.uuid4().hex[:8]}", {t: dict(f) for t, f in old["tables"].items()}
        for name, fresh in self._fresh(changed.where(~deleted), chunked).items():
            kept = [old["tables"][name][str(b)] for b in touched if str(b) in old["tables"][name]]
            rows = fresh.select(*[c.split()[0] for c in SCHEMAS[name].split(", ")])
            if kept:
                before = self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.root}/{f}" for f in sorted(set(kept))])
                rows = rows.unionByName(before.join(changed.select("doc_id"), "doc_id", "left_anti"))
            path = f"{folder}/{name}"
            rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{path}")
            there = set(self._names(path))
            for b in touched:
                new[name].pop(str(b), None)
                if f"bucket={b}" in there:
                    new[name][str(b)] = f"{path}/bucket={b}"
        manifest = {"version": old["version"] + 1 if touched else old["version"], "applied": old["applied"] | {stream: batch}, "buckets": self.buckets, "built_at": datetime.now(timezone.utc).isoformat(), "tables": new}
        if not touched:
            return old
        manifest["rows"] = {t: self.table(t, manifest=manifest).count() for t in SCHEMAS}
        return self._publish(manifest)

    def _fresh(self, documents: DataFrame, chunked: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
        """Rows of every table for changed documents (doc_id, content, embedding, digest)."""
        pieces = chunked(documents.select("doc_id", "content")).select("doc_id", F.concat_ws("_", "doc_id", "chunk_index").alias("chunk_id"), "content")
        index = bm25.build_index(pieces)
        own = pieces.select("chunk_id", "doc_id")
        links = documents.select("doc_id", F.explode(F.array_distinct(T.wiki_links(F.col("content")))).alias("name"))
        return {
            "documents": documents.select("doc_id", "content", "digest"), "chunks": pieces, "postings": index.postings.drop("dl").join(own, "chunk_id"),
            "doc_len": index.doc_len.join(own, "chunk_id"), "edges": links, "vectors": documents.where("embedding IS NOT NULL").select("doc_id", "embedding"),
        }

    def follow(self, changes: DataFrame, checkpoint: str, stream: str = "changes"):
        """Merge every micro-batch of a stream of changes until it is drained; restarted from its checkpoint it merges no batch twice."""
        return changes.writeStream.foreachBatch(lambda rows, batch: self.merge(rows, batch, stream)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove manifests but the last `keep`, and every bucket's folder that none of those names; returns these folders."""
        names = [n for n in self._names("manifests") if n.endswith(".json")]
        held = {f for n in names[-keep:] for t in self.manifest(int(n[:-5]))["tables"].values() for f in t.values()}
        for n in names[:-keep]:
            self._fs().delete(self._path(f"manifests/{n}"), False)
        gone = []
        for version in (f for f in self._names("") if f.startswith("v")):
            there = [f"{version}/{t}/{b}" for t in self._names(version) for b in self._names(f"{version}/{t}") if b.startswith("bucket=")]
            old = [f for f in there if f not in held]
            for f in old if len(old) < len(there) else [version]:
                self._fs().delete(self._path(f), True)
            gone += old
        return gone
