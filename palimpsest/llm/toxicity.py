"""Toxicity (8): a factorization machine over hashed terms."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import STAGE_BATCH, byte_batches, narrow
from .learning import Memory, give_back, held_out, sigmoid, training_sample

#: Labelled texts learnt from, and their bytes, at most.
MAX_TRAIN, MAX_BYTES = 6_000, 16 << 20
#: Places of the table that all terms are hashed into.
TABLE = 1 << 18
FACTORS = 8
#: Words a worker remembers, and terms of texts that are scored together, about: its memory beside Spark's and that of other stages is bounded by both.
REMEMBERED, SLICE = 150_000, 1 << 16
#: Texts are gone through so often, few texts more often, for so many steps at least.
EPOCHS, MIN_STEPS, BATCH = 5, 320, 64
#: A text's terms have the values `SCALE` / sqrt(number of its terms).
SCALE = 4.0
#: Steps and penalties: of the weights, and of the factors.
RATE, LASSO, FACTOR_RATE, FACTOR_DECAY, SPREAD = 10.0, 2.0, 0.02, 1e-3, 0.02
EDGES = ".,;:!?\"'()[]{}*#$%&|<>-_=+~`/\\«»¿¡…"


def term_places(word: str) -> tuple[int, ...]:
    """Places of a word's terms: itself without punctuation at its ends, and its first four and five letters."""
    word = word.strip(EDGES)
    if not word:
        return ()
    return tuple({zlib.crc32(t.encode("utf-8", "surrogatepass")) % TABLE for t in (word, word[:4] + "+", word[:5] + "+")})


def terms_of(text: str, memory: Memory) -> list[int]:
    """Places of all terms of a text, each once, in order."""
    return sorted(set().union(*map(memory.__getitem__, set(text.lower().split()))))


class FactorizationMachine:
    """score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j); x_i is the same for all terms of a text.

    The sum over pairs is ((sum v_i x_i)^2 - sum (v_i x_i)^2) / 2, summed over factors, so a text costs its number of terms.
    Every term has a weight and factors from the start, whether it tells anything alone or not.
    """

    def __init__(self, size: int = TABLE, seed: int = 1):
        self.w0, self.w = 0.0, np.zeros(size, "float32")
        self.v = np.random.default_rng(seed).standard_normal((size, FACTORS), dtype="float32") * np.float32(SPREAD)

    def logits(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """``flat``: places of the texts' terms one after the other; ``ends``: where each text's end."""
        out, starts = np.full(len(ends), self.w0), np.concatenate(([0], ends[:-1]))
        has = np.flatnonzero(ends > starts)
        if len(has):
            x = SCALE / np.sqrt(ends[has] - starts[has])
            v = self.v[flat]
            each = np.concatenate((self.w[flat][:, None], v, (v * v).sum(axis=1, keepdims=True)), axis=1, dtype="float64")
            s = np.add.reduceat(each, starts[has], axis=0)
            out[has] += x * s[:, 0] + 0.5 * x * x * ((s[:, 1 : 1 + FACTORS] ** 2).sum(axis=1) - s[:, -1])
        return out

    def fit(self, texts: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 2) -> FactorizationMachine:
        """Gradient descent on the logistic loss: the weights by follow-the-regularised-leader with a lasso, which leaves those of noise at zero, the factors by steps
        that shrink with their gradients."""
        if not len(y):
            return self
        rng = np.random.default_rng(seed)
        self.w0 = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        full = [i for i in rng.permutation(len(texts)).tolist() if len(texts[i])]
        batches = [self._batch([texts[i] for i in full[at : at + BATCH]], y[full[at : at + BATCH]]) for at in range(0, len(full), BATCH)]
        lead, seen, g_v, g_0 = np.zeros(len(self.w)), np.zeros(len(self.w)), np.ones(len(self.w), "float32"), 1e-2
        for _ in range(max(epochs, -(-MIN_STEPS // len(batches))) if batches else 0):
            for k in rng.permutation(len(batches)).tolist():
                terms, back, order, new, starts, doc, x, label = batches[k]
                vx = self.v[terms][back] * x[doc][:, None]
                sums = np.add.reduceat(vx, starts, axis=0)
                z = self.w0 + np.add.reduceat(self.w[terms][back], starts) * x + 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts))
                err = (sigmoid(z) - label).astype("float32")
                e = (err * x)[doc]
                g = np.add.reduceat(e[order], new).astype("float64")
                step = (np.sqrt(seen[terms] + g * g) - np.sqrt(seen[terms])) / RATE
                lead[terms] += g - step * self.w[terms]
                seen[terms] += g * g
                u = lead[terms]
                self.w[terms] = np.where(np.abs(u) <= LASSO, 0, (np.sign(u) * LASSO - u) * RATE / (1 + np.sqrt(seen[terms])))
                d = np.add.reduceat((e[:, None] * (sums[doc] - vx))[order], new, axis=0)
                g_v[terms] += (d * d).mean(axis=1)
                self.v[terms] -= FACTOR_RATE * (d + FACTOR_DECAY * self.v[terms]) / np.sqrt(g_v[terms])[:, None]
                g_0 += float(err.sum()) ** 2
                self.w0 -= 0.05 * float(err.sum()) / g_0**0.5
        return self

    @staticmethod
    def _batch(texts: list[np.ndarray], label: np.ndarray) -> tuple:
        flat, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
        terms, back = np.unique(flat, return_inverse=True)
        order = np.argsort(back, kind="stable").astype("int32")
        new = np.searchsorted(back[order], np.arange(len(terms)))
        doc = np.repeat(np.arange(len(texts), dtype="int32"), sizes)
        return terms, back.astype("int32"), order, new, np.cumsum(sizes) - sizes, doc, (SCALE / np.sqrt(sizes)).astype("float32"), label


def train(texts: list[str], y: np.ndarray) -> FactorizationMachine:
    memory = Memory(term_places, 50_000)
    # Flat arrays: as Python sets, the terms of all training texts would fill the driver's memory.
    fm = FactorizationMachine().fit([np.array(terms_of(t, memory), "int32") for t in texts], y)
    memory.clear()
    give_back()
    return fm


def _scorer(fm: FactorizationMachine):
    """Scores of a list of texts, in slices of texts that have about `SLICE` terms together."""
    memory = Memory(term_places, REMEMBERED)

    def score(texts: list[str]) -> np.ndarray:
        out, flat, ends = [], array("i"), []
        for text in texts:
            flat.extend(terms_of(text, memory))
            ends.append(len(flat))
            if len(flat) >= SLICE:
                out.append(fm.logits(np.array(flat), np.array(ends)))
                flat, ends = array("i"), []
        out.append(fm.logits(np.array(flat), np.array(ends, "int64")))
        return sigmoid(np.concatenate(out))

    return score


def _score(fm: FactorizationMachine):
    score = _scorer(fm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of ``docs``; only its text is scored.

    Learns from at most ``max_train`` labelled texts out of held-out folds (`training_sample`).  Terms are a text's distinct words,
    lower case and without punctuation at their ends, and their beginnings, all of them hashed into one table.  A null or empty text has
    no terms and gets the base rate; without labels all scores are alike; null or repeated
    ids stay; an empty table gives an empty one; further columns are ignored.
    """
    byte_batches(docs.sparkSession, STAGE_BATCH)
    fm = train(*training_sample(docs, labels, "toxic", max_train, MAX_BYTES))
    rows = narrow(docs, doc_id="doc_id", text="text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    scored = rows.mapInArrow(_score(fm), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows and all columns of ``docs`` whose text scores under ``threshold``, in one scan; training and cases as of `toxicity`."""
    byte_batches(docs.sparkSession, STAGE_BATCH)
    names = docs.columns
    at, score = names.index("text"), _scorer(train(*training_sample(docs, labels, "toxic", max_train, MAX_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score([t or "" for t in batch.column(at).to_pylist()]) < threshold))

    numbered = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    return numbered.mapInArrow(run, StructType([StructField(f.name, f.dataType, True) for f in numbered.schema.fields])).toDF(*names)
