"""Reports taken while their rows are written: the source is read once, whatever is asked about it.

Figures are observed on the rows as they pass to the sink. Details, of which a report shows a bounded number, are flagged in the rows and
read back from what was written.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import corpus, linking

#: Details that a report shows.
DETAILS = 50
TABLE_LINE = r"(?m)^ *\|.*\| *$|^ *\| *$"


class Report(NamedTuple):
    """Figures by name, all written rows, and the first details."""

    summary: dict[str, object]
    rows: DataFrame
    details: DataFrame


def write_observed(rows: DataFrame, path: str, keep: Column | None = None, **figures: Column) -> tuple[dict[str, object], DataFrame]:
    """Write the rows that `keep` passes (all without it), and aggregate `figures` over all rows in the same pass.

    Returns the figures and the written rows. Figures are taken in the job's last stage, whose tasks count once however often they are tried.
    """
    seen = Observation()
    passing = rows.observe(seen, *[c.alias(name) for name, c in figures.items()])
    (passing if keep is None else passing.where(keep)).write.mode("overwrite").parquet(path)
    return seen.get, rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_chunks(chunks: DataFrame, path: str, details: int = DETAILS) -> Report:
    """Write `chunks(doc_id, chunk_index, content, ...)` with `has_table` and `is_cut`, and report on them.

    Figures: chunks, chunks with a table line, chunks with a cut table, short ones (under 100 characters), the least, greatest and mean (floored) length;
    zeros without chunks. A null content has no length and no table. Details: the first cut tables by (doc_id, chunk_index).
    """
    n = F.length("content")
    flagged = chunks.withColumns({"has_table": F.coalesce(F.col("content").rlike(TABLE_LINE), F.lit(False)), "is_cut": F.coalesce(corpus.broken_tables(F.col("content")), F.lit(False))})
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    figures = {"chunks": F.count(F.lit(1)), "tables": F.count_if("has_table"), "cut": F.count_if("is_cut"), "short": F.count_if(n < 100), "least": zero(F.min(n)), "most": zero(F.max(n)), "mean": zero(F.floor(F.avg(n)))}
    summary, rows = write_observed(flagged, path, **figures)
    return Report(summary, rows, rows.where("is_cut").orderBy("doc_id", "chunk_index").limit(details))


def document_counts(report: Report) -> DataFrame:
    """(doc_id, chunks, tables, cut) of every document of a chunk report, from what was written."""
    return report.rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if("has_table").alias("tables"), F.count_if("is_cut").alias("cut"))


def write_missing_links(chunks: DataFrame, names: list[str], path: str, details: int = DETAILS) -> Report:
    """Write (chunk_id, missing) of the chunks in which known names stand without a link, and report on all chunks.

    Figures: chunks, those with missing links, missing links altogether. Details: the first such chunks by chunk_id. `names` are
    a broadcast dictionary, as in `linking.missing_links`.
    """
    rows = chunks.select("chunk_id", F.array_sort(linking.missing_names(chunks, names)).alias("missing"))
    size = F.size(F.coalesce("missing", F.array().cast("array<string>")))
    some = size > 0
    figures = {"chunks": F.count(F.lit(1)), "with_missing": F.count_if(some), "missing_links": F.coalesce(F.sum(size), F.lit(0)).cast("long")}
    summary, rows = write_observed(rows, path, some, **figures)
    return Report(summary, rows, rows.orderBy("chunk_id").limit(details))


def markdown(title: str, report: Report) -> str:
    """The report as a heading, a table of figures and a table of details; cells have no line breaks or bars."""
    cell = lambda v: str(v).replace("|", "/").replace("\n", " ")
    head = [f"# {title}", "", "| figure | value |", "| --- | --- |", *(f"| {cell(k)} | {cell(v)} |" for k, v in report.summary.items())]
    names = [c for c in report.details.columns if c != "content"]
    body = ["| " + " | ".join(cell(r[c]) for c in names) + " |" for r in report.details.select(*names).collect()]  # a bounded number
    return "\n".join(head + (["", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *body] if body else []) + [""])


def save(spark: SparkSession, title: str, report: Report, path: str) -> None:
    """Summary and details as JSON and the Markdown text, each a folder below `path`, on whatever file system Spark writes to."""
    figures = [F.lit(v).alias(k) for k, v in report.summary.items()]
    spark.range(1, numPartitions=1).select(*figures).write.mode("overwrite").json(f"{path}/summary")
    report.details.write.mode("overwrite").json(f"{path}/details")
    spark.createDataFrame([(markdown(title, report),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/markdown")
