"""What both classifiers need: a bounded, hash-chosen sample of labelled texts, and memory of words per worker."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, forget, narrow

#: Folds of the contract: crc32 of the id as text, modulo this; fold 0 is held out.
FOLDS = 5
#: Words a worker remembers.
REMEMBERED = 500_000


def held_out(doc_id, folds: int = FOLDS):
    """True for rows no label may be learnt from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def training_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, max_bytes: int) -> tuple[list[str], np.ndarray]:
    """At most ``limit`` labelled texts of ``max_bytes`` bytes together, out of the folds to learn from, chosen by a hash of the id, in its order.

    Only the ids of the chosen labels go to the executors: a table of ``limit`` rows at most.  An id with several labels has the
    largest, one with several texts the least; null labels are none.  Of the texts, taken in order, one that does not fit any more is left out.
    Nothing else comes to the driver.
    """
    y = narrow(labels, doc_id="doc_id", y=label).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    chosen = y.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    at = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = chosen.orderBy(at, "doc_id").limit(limit)
    texts = narrow(docs, doc_id="doc_id", text="text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sample = durable(texts.select(at.alias("at"), "doc_id", "y", F.octet_length("text").alias("size"), "text"), "sample")
    fits, left = [], max_bytes
    for r in sorted(sample.select("at", "doc_id", "size").toArrow().to_pylist(), key=lambda r: (r["at"], r["doc_id"])):
        if r["size"] <= left:
            fits.append(r["doc_id"])
            left -= r["size"]
    rows = sample.filter(F.col("doc_id").isin(fits)).select("at", "doc_id", "text", "y").toArrow().to_pylist()
    forget(sample)
    rows.sort(key=lambda r: (r["at"], r["doc_id"]))
    return [r["text"] for r in rows], np.array([r["y"] for r in rows], "float64")


def give_back() -> None:
    """Returns freed memory to the system: what training took would else stay with the driver's process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Memory(dict):
    """word -> value, computed at first sight; at most ``limit`` words stay."""

    def __init__(self, compute, limit: int = REMEMBERED):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, word: str):
        out = self.compute(word)
        if len(self) < self.limit and len(word) < 48:
            self[word] = out
        return out
