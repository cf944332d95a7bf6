"""Calls of an outside model over a table of items, kept in a log so that a rerun does only what is missing.

`run` asks the model for every item that has no answer in the log yet and appends one row a call: the answer, or the error. One
item's failure never ends the run; a run that is cut off keeps the slices it has finished. Models are any picklable function of a
prompt. `StandIn` and `HashingEmbedder` are deterministic ones for batches and tests without a network.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.tokenize import regex_tokens
from lodestone.sources import tables

LOG = "item string, run int, answer string, error string"
#: Calls whose answers a task holds at a time.
HELD = 256


class StandIn:
    """Answers a prompt by its digest; fails where the digest begins with `fails`."""

    def __init__(self, head: str = "", fails: str = " "):
        self.head, self.fails = head, fails

    def __call__(self, prompt: str) -> str:
        digest = hashlib.md5(prompt.encode()).hexdigest()
        if digest.startswith(self.fails):
            raise RuntimeError("the model is busy")
        return f"{self.head}{digest}"


class HashingEmbedder:
    """Unit vectors of signed word counts by hash; texts are cut to 2000 characters before, as the model's service does. No words: all zero."""

    def __init__(self, dim: int = 64, most: int = 2000):
        self.dim, self.most = dim, most

    def column(self, text: Column) -> Column:
        dim = self.dim

        @F.pandas_udf("array<float>")
        def embed(hashes: pd.Series) -> pd.Series:
            out = []
            for h in hashes:
                h = np.asarray(h, np.int64)
                v = np.bincount((h >> 1) % dim, np.where(h & 1, 1.0, -1.0), dim)
                out.append((v / (np.sqrt(v @ v) or 1.0)).astype(np.float32))
            return pd.Series(out)

        return embed(F.transform(regex_tokens(F.substring(text, 1, self.most)), lambda t: F.xxhash64(t)))

    def __call__(self, texts: DataFrame) -> DataFrame:
        """`texts(..., text)` with `embedding`; a null text is one without words."""
        return texts.withColumn("embedding", self.column(F.coalesce("text", F.lit(""))))


class _Call:
    """(item, prompt) -> rows of the log."""

    def __init__(self, model: Callable[[str], str], run: int, concurrency: int):
        self.model, self.run, self.concurrency = model, run, concurrency

    def one(self, prompt: str | None) -> tuple[str | None, str | None]:
        if prompt is None:
            return None, "no prompt"
        try:
            answer = self.model(prompt)
        except Exception as e:  # an item's failure is a row of the log
            return None, f"{type(e).__name__}: {e}"
        return (answer, None) if isinstance(answer, str) else (None, "no answer")

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(self.concurrency) as pool:
            for b in batches:
                for lo in range(0, b.num_rows, HELD):
                    part = b.slice(lo, HELD)
                    answer, error = zip(*pool.map(self.one, part.column(1).to_pylist()))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([self.run] * part.num_rows, pa.int32()), pa.array(answer, pa.string()), pa.array(error, pa.string())], ["item", "run", "answer", "error"])


def log(spark: SparkSession, path: str) -> DataFrame:
    """(item, run, answer, error): all calls so far; empty before the first."""
    return spark.read.schema(LOG).parquet(path) if tables.exists(spark, path) else spark.createDataFrame([], LOG)


def answers(calls: DataFrame) -> DataFrame:
    """(item, answer, run): the first answer of each item that has one."""
    return calls.where("answer IS NOT NULL").groupBy("item").agg(F.min_by("answer", F.struct("run", "answer")).alias("answer"), F.min("run").alias("run"))


def failures(calls: DataFrame) -> DataFrame:
    """(item, calls, error): items without an answer, how often each was tried, and its last error."""
    tried = calls.groupBy("item").agg(F.count("*").alias("calls"), F.count("answer").alias("answers"), F.max_by("error", F.struct("run", "error")).alias("error"))
    return tried.where("answers = 0").drop("answers")


def pending(items: DataFrame, calls: DataFrame, attempts: int) -> DataFrame:
    """`items` without an answer that were tried less than `attempts` times."""
    done = calls.groupBy("item").agg(F.count("*").alias("calls"), F.count("answer").alias("answers")).where((F.col("answers") > 0) | (F.col("calls") >= attempts))
    return items.join(done, "item", "left_anti")


def run(items: DataFrame, model: Callable[[str], str], path: str, attempts: int = 3, slices: int = 1, concurrency: int = 4) -> DataFrame:
    """Ask `model` for the items (item, prompt) that lack an answer in the log at `path`; returns the whole log.

    Items are dealt to `slices` by hash, each appended by a job of its own, so a run that is cut off loses one slice at most. Each task
    makes `concurrency` calls at a time. A repeated item is asked once, with its least prompt; a null item not at all; a null prompt is
    a failure. A task that Spark tries again asks again, which the log's readers allow for: they take one answer an item.
    """
    spark = items.sparkSession
    known = log(spark, path)
    number = (known.agg(F.max("run")).first()[0] or 0) + 1
    one = items.where("item IS NOT NULL").groupBy("item").agg(F.min("prompt").alias("prompt"))
    todo = tables.written(pending(one, known, attempts).withColumn("slice", F.pmod(F.xxhash64("item"), F.lit(slices))), "calls")
    for i in range(slices):
        todo.where(F.col("slice") == i).select("item", "prompt").mapInArrow(_Call(model, number, concurrency), LOG).write.mode("append").parquet(path)
    return log(spark, path)


def concept_contexts(concepts: DataFrame, mentions: DataFrame, documents: DataFrame, most: int = 3) -> DataFrame:
    """(name, contexts): the first `most` documents by id that mention a concept, as `title: snippet` lines numbered from 1.

    `mentions(name, doc_id)` may repeat; `documents(doc_id, title, content)` of at most 100 characters are left out. The cut
    is made before documents are joined, and on each side of the shuffle, so a concept of all documents fills no task.
    """
    long = documents.where(F.length("content") > 100)
    met = mentions.join(concepts.select("name").distinct(), "name", "left_semi").join(long.select("doc_id"), "doc_id", "left_semi").select("name", "doc_id").distinct()
    first = met.withColumn("pos", F.row_number().over(Window.partitionBy("name").orderBy("doc_id"))).where(F.col("pos") <= most)
    snippet = F.trim(F.translate(F.substring("content", 1, 500), "\n", " "))
    lines = first.join(long, "doc_id").select("name", "pos", F.concat(F.col("pos").cast("string"), F.lit(". "), "title", F.lit(": "), snippet).alias("line"))
    return lines.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("contexts"))  # `most` lines


def concept_prompts(concepts: DataFrame, contexts: DataFrame, template: str) -> DataFrame:
    """(item, prompt) of `concepts(name, definition)`; the template has {name}, {definition} and {contexts}, each put in once."""
    rows = concepts.select("name", "definition").join(contexts, "name", "left")
    parts, last = [], template
    for key in ("name", "definition", "contexts"):
        head, last = last.split("{" + key + "}", 1)
        parts += [F.lit(head), F.coalesce(F.col(key), F.lit(""))]
    return rows.select(F.col("name").alias("item"), F.concat(*parts, F.lit(last)).alias("prompt"))


def concept_articles(concepts: DataFrame, calls: DataFrame) -> DataFrame:
    """(name, content, run): the articles of the concepts (name, definition, frequency) that the log has an answer for."""
    lines = F.concat(F.lit("# "), "name", F.lit("\n\n> 概念 | 出现频次: "), F.col("frequency").cast("string"), F.lit("\n"))
    defined = F.when(F.coalesce("definition", F.lit("")) != "", F.concat(F.lit("> 定义: "), "definition", F.lit("\n"))).otherwise("")
    got = answers(calls).select(F.col("item").alias("name"), "answer", "run")
    return concepts.join(got, "name").select("name", F.concat(lines, defined, F.lit("> 来源: LLM生成\n\n"), F.trim("answer")).alias("content"), "run")
