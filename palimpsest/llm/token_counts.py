"""Token counts (7): batches of texts in an Arrow function that returns lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, narrow
from .tokens import pieces


def _count_tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = pieces(path, True)
        for batch in batches:
            n = memory.of_all(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row per row of ``docs``, in one scan and without a shuffle.

    The counts are those of the vocabulary file's library without begin, end or added special tokens; special strings
    inside a text count as the library's default has them.  Arrow batches are ended by bytes, and texts are cut at safe
    boundaries only (`tokens`).  A null or empty text has no tokens; null or repeated ids stay as they are; an empty table
    gives an empty one; further columns are ignored.
    """
    byte_batches(docs.sparkSession)
    rows = narrow(docs, doc_id=id_col, text=text_col)
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = rows.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(
        _count_tokens(tokenizer_path), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
