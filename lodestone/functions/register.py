"""SQL names of the engine's functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import CJK
from lodestone.operators.chunking import chunk_text


def register(spark: SparkSession) -> None:
    """kb_chunk(doc_id, text) as a table function; kb_tokenize, kb_estimate_tokens, kb_strip_links, kb_highlight and kb_cosine as SQL functions."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION kb_tokenize(t STRING) RETURNS ARRAY<STRING> RETURN filter(split(lower(coalesce(t, '')), '[^\\\\p{L}\\\\p{N}]+'), x -> x <> '')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION kb_strip_links(t STRING) RETURNS STRING RETURN regexp_replace(t, '\\\\[\\\\[([^\\\\]]+)\\\\]\\\\]', '$1')")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION kb_estimate_tokens(t STRING) RETURNS BIGINT RETURN CAST(ceil(regexp_count(t, '{CJK}') / 1.5"
        f" + (length(t) - regexp_count(t, '{CJK}')) / 4) AS BIGINT)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION kb_highlight(t STRING, word STRING) RETURNS STRING RETURN CASE WHEN word = '' OR instr(lower(t), lower(word)) = 0 THEN t "
        "ELSE concat(substring(t, 1, instr(lower(t), lower(word)) - 1), '**', substring(t, instr(lower(t), lower(word)), length(word)), '**', substring(t, instr(lower(t), lower(word)) + length(word))) END"
    )

    @F.udtf(returnType="id: string, chunk_index: int, content: string")
    class Chunks:
        def eval(self, doc_id: str, text: str):
            for c in chunk_text(str(doc_id), text or ""):
                yield c["id"], c["chunk_index"], c["content"]

    spark.udtf.register("kb_chunk", Chunks)

    @F.pandas_udf("double")
    def kb_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for x, y in zip(a, b):
            n = min(len(x), len(y)) if x is not None and y is not None else 0
            u, v = np.asarray(x[:n], float), np.asarray(y[:n], float)
            den = np.sqrt((u * u).sum()) * np.sqrt((v * v).sum()) if n else 0.0
            out.append(float(u @ v / den) if den else 0.0)
        return pd.Series(out)

    spark.udf.register("kb_cosine", kb_cosine)
