"""Sources and sinks: Markdown folders, JSON lines staging, index tables, manifest."""

from __future__ import annotations

import atexit
import hashlib
import json
import os
import shutil
import tempfile
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan_markdown(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """(doc_key, name, path, content) of the `*.md` files directly in a folder."""
    d = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))
    name = F.regexp_replace("file", r"\.md$", "")
    return d.select(F.concat(F.lit(prefix), name).alias("doc_key"), name.alias("name"), "path", "content")


def scan_wiki(spark: SparkSession, concepts: str, entities: str) -> DataFrame:
    parts = [scan_markdown(spark, p, "wiki_").withColumns({"type": F.lit(t), "ordinal": F.lit(i)}) for i, (t, p) in enumerate((("concept", concepts), ("entity", entities)))]
    return parts[0].unionByName(parts[1])


def read_chunk_maps(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON maps id -> chunk; a later file overwrites an id of an earlier one."""
    value = "map<string,struct<docId:string,docTitle:string,docPath:string,metadata:map<string,string>,content:string,wikiLinks:array<string>>>"
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.explode(F.from_json("value", value)).alias("id", "c"))
    shard = F.regexp_extract("file", r"(\d+)", 1).cast("int")
    last = Window.partitionBy("id").orderBy(F.desc(shard), F.desc("file"))
    return d.withColumn("r", F.row_number().over(last)).where("r = 1").select("id", "c.*")


def read_staging(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_staging(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def write_chunks(chunks: DataFrame, path: str, most: int = 2000) -> None:
    """Chunk metadata with contents cut to 3000 characters."""
    chunks.withColumn("content", F.substring("content", 1, 3000)).write.mode("overwrite").option("maxRecordsPerFile", most).parquet(path)


def scan_all(spark: SparkSession, raw: str, concepts: str, entities: str) -> DataFrame:
    """Raw documents and articles together; raw ones have no type."""
    r = scan_markdown(spark, raw, "raw_").withColumns({"type": F.lit(None).cast("string"), "ordinal": F.lit(-1)})
    return r.unionByName(scan_wiki(spark, concepts, entities))


def read_document(documents: DataFrame, name: str, root: str = "") -> DataFrame:
    """The document of `documents(path, ...)` at a path below `root`. A leading `Wiki/` is dropped; a relative path that leaves the root
    is refused, an absolute one taken as it is."""
    name = name.removeprefix("Wiki/")
    path = name if name.startswith("/") else os.path.normpath(f"{root}/{name}" if root else name)
    if not name.startswith("/") and (path.startswith("..") or root and not path.startswith(os.path.normpath(root) + "/")):
        raise ValueError(f"{name} lies outside the documents")
    return documents.where(F.regexp_replace("path", "^file:/*", "/") == path)


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share; only a session in one process gets one of its own where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """`df` written to the shared folder and read back, so that it is worked out once and survives lost executors."""
    path = f"{work_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes and rows of a batch of texts that a Python worker gets at once.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1000


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds of texts, whatever the size of its task: by default a batch is 10,000 rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Digest of the paths, sizes and modification times of all files below `paths`."""
    conf, found = spark._jsc.hadoopConfiguration(), []
    for p in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(p)
        files = folder.getFileSystem(conf).listFiles(folder, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def ready(spark: SparkSession, path: str, stores: tuple[str, ...] = ("postings", "doc_len", "term_stats", "corpus")) -> dict[str, bool]:
    """Which stores of an index folder are complete."""
    return {s: exists(spark, f"{path}/{s}/_SUCCESS") for s in stores}


def read_index(spark: SparkSession, path: str):
    """A text index written by `write_index`."""
    from lodestone.operators.bm25 import TextIndex

    return TextIndex(*(spark.read.parquet(f"{path}/{name}") for name in TextIndex._fields))


def write_vectors(vectors: DataFrame, path: str) -> dict:
    """Replace the vectors' table and, where the policy for its size names an inverted file, build that beside it (`<path>-index`).

    Returns the policy, the rows, and the index's configuration. The exact search needs no index; the policy's graph has none either.
    """
    from lodestone.operators import ivf
    from lodestone.operators import vectors as operators

    vectors.write.mode("overwrite").parquet(path)
    rows = vectors.sparkSession.read.parquet(path)
    row = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    config = operators.index_policy(row["n"], row["dim"] or 0) | {"rows": row["n"]}
    if config["kind"] == "inverted-file":
        config |= ivf.build(rows, f"{path}-index", config["partitions"], config["sub_vectors"]).config
    return config


def write_parents(parents: DataFrame, path: str) -> None:
    parents.write.mode("overwrite").parquet(path)


def write_struct(entries: DataFrame, edges: DataFrame, path: str) -> dict[str, int]:
    """Entries (the last of a name wins) and edges (the first of a pair wins, unknown names are left out), with the six counts."""
    from lodestone.operators.entities import first_edges, last_wins

    spark = entries.sparkSession
    last_wins(entries).write.mode("overwrite").parquet(f"{path}/entries")
    kept = spark.read.parquet(f"{path}/entries")
    first_edges(edges.join(kept.select("name"), "name", "left_semi")).write.mode("overwrite").parquet(f"{path}/edges")
    got = kept.agg(F.count("*").alias("entries"), F.count_if(F.col("type") == "concept").alias("concepts"), F.count_if(F.col("type") == "entity").alias("entities")).first().asDict()
    rows = {"entry_rows": entries.count(), "edge_rows": edges.count(), "relations": spark.read.parquet(f"{path}/edges").count()}
    return got | rows


def write_index(index, path: str) -> None:
    """The tables of a text index. Its postings come sorted by term, so term filters prune files and row groups."""
    for name in index._fields:
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def read_manifest(path: str) -> dict | None:
    """The manifest on the driver's file system, None if it is missing or unreadable."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return None


def write_manifest(path: str, stores: dict[str, dict], mode: str = "full", required: tuple[str, ...] = ("vectors", "text", "chunks", "parents")) -> dict:
    """Next version, replaced atomically; refused while a required store isn't ready."""
    missing = [s for s in required if not stores.get(s, {}).get("ready")]
    if missing:
        raise ValueError(f"stores aren't ready: {', '.join(missing)}")
    manifest = {"index_version": ((read_manifest(path) or {}).get("index_version") or 0) + 1, "built_at": datetime.now(timezone.utc).isoformat(), "build_mode": mode, "stores": stores}
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(manifest, f)
    os.replace(f"{path}.tmp", path)
    return manifest


def update_struct(path: str, store: dict) -> dict:
    """The manifest with a new state of the dictionary alone; without a manifest a minimal one."""
    manifest = read_manifest(path) or {"index_version": 0, "build_mode": "structdb-only", "stores": {}}
    manifest["stores"] = {**manifest["stores"], "structDb": store}
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(manifest, f)
    os.replace(f"{path}.tmp", path)
    return manifest
