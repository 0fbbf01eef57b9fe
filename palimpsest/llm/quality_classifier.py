"""Quality classifier (9): supervised subword embeddings with a softmax, trained by stochastic gradient descent in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, narrow
from .learning import Memory, held_out, sigmoid, training_sample

#: Labelled texts learnt from, and their bytes, at most.
MAX_TRAIN, MAX_BYTES = 4_000, 12 << 20
BUCKETS = 1 << 16
DIMENSIONS = 8
LENGTHS = (3, 4)
EPOCHS = 4
#: The word 2-gram of a word that is the one before it again, whatever the word: it has a vector of its own, beside the word's.
SAME = "<same word>"
#: Words of more characters are hashed bit by bit and not remembered.
LONG = 64


def bucket(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def subwords(word: str) -> Iterator[int]:
    """Buckets of a word: the whole, and the n-grams of its characters between marks at its ends, all of them."""
    marked = f"<{word}>"
    yield bucket(marked)
    for n in LENGTHS:
        for i in range(len(marked) - n + 1):
            yield bucket(marked[i : i + n])


def with_repeats(words: list[str]) -> list[str]:
    """The words, and `SAME` for each that repeats the one before."""
    return words + [SAME] * sum(map(eq, words, words[1:]))


class SubwordClassifier:
    """A document is the mean of its words' vectors, with those of repeats; a word is the mean of its buckets' vectors; then two softmax outputs."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.e = (rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS).astype("float32")
        self.out = np.zeros((DIMENSIONS, 2), "float32")
        self.bias = np.zeros(2, "float32")

    def fit(self, texts: list[str], y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.5, seed: int = 4) -> SubwordClassifier:
        rng, number, parts = np.random.default_rng(seed), {}, []
        docs = []
        for t in texts:
            ids = []
            for w in with_repeats(t.split()):
                if w not in number:
                    number[w] = len(parts)
                    parts.append(np.fromiter(subwords(w), "uint16"))
                ids.append(number[w])
            docs.append(np.unique(np.array(ids, "int64"), return_counts=True))
        keep = [i for i, (ids, _) in enumerate(docs) if len(ids)]
        sizes = np.array([len(p) for p in parts], "int64")
        starts, flat = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(parts) else sizes, np.concatenate([np.empty(0, "uint16"), *parts])
        if keep:
            self.bias[1] = np.log((y[keep].mean() + 1e-3) / (1 - y[keep].mean() + 1e-3))
        steps, done = max(1, epochs * -(-len(keep) // 32)), 0
        g_e = np.full(BUCKETS, 1e-3, "float32")
        for _ in range(epochs):
            order = rng.permutation(keep)
            for at in range(0, len(order), 32):
                some = order[at : at + 32]
                words, share, doc = (np.concatenate(x) for x in zip(*[(docs[i][0], docs[i][1] / docs[i][1].sum(), np.full(len(docs[i][0]), k)) for k, i in enumerate(some)], strict=True))
                distinct, back = np.unique(words, return_inverse=True)
                n = sizes[distinct]
                # Bucket entries of the batch's words, one after the other.
                pos = np.repeat(starts[distinct] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                buckets, owner = flat[pos], np.repeat(np.arange(len(distinct)), n)
                vec = np.add.reduceat(self.e[buckets], np.concatenate(([0], np.cumsum(n)[:-1])), axis=0) / n[:, None]
                h = np.stack([np.bincount(doc, share * vec[back, d], len(some)) for d in range(DIMENSIONS)], axis=1)
                z = h @ self.out + self.bias
                z -= z.max(axis=1, keepdims=True)
                p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
                p[np.arange(len(some)), y[some].astype(int)] -= 1
                step = rate * (1 - done / steps)
                done += 1
                dh = p @ self.out.T
                self.out -= (step * h.T @ p / len(some) * 4).astype("float32")
                self.bias -= (step * p.mean(axis=0)).astype("float32")
                dword = np.stack([np.bincount(back, share * dh[doc, d], len(distinct)) for d in range(DIMENSIONS)], axis=1) / n[:, None]
                uniq, where = np.unique(buckets, return_inverse=True)
                de = np.stack([np.bincount(where, dword[owner, d], len(uniq)) for d in range(DIMENSIONS)], axis=1)
                g_e[uniq] += (de**2).sum(axis=1)
                self.e[uniq] -= (step * de / np.sqrt(g_e[uniq])[:, None]).astype("float32")
        return self

    def margins(self) -> tuple[list[float], float]:
        """What a bucket adds to the difference of the two logits, as both layers are linear; and the biases' difference."""
        return (self.e @ (self.out[:, 1] - self.out[:, 0])).astype("float64").tolist(), float(self.bias[1] - self.bias[0])


def _score(buckets: list[float], bias: float):
    def of(word: str) -> float:
        if len(word) <= LONG:
            parts = list(map(buckets.__getitem__, subwords(word)))
            return sum(parts) / len(parts)
        total, n = 0.0, 0
        for b in subwords(word):
            total += buckets[b]
            n += 1
        return total / n

    memory = Memory(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = []
            for text in batch.column(1).to_pylist():
                words = with_repeats(text.split())
                z.append(bias + (sum(map(memory.__getitem__, words)) / len(words) if words else 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(np.array(z, "float64")), pa.float64())], ["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of ``docs``; only its text is scored, all of its words.

    Learns from at most ``max_train`` labelled texts out of held-out folds (`training_sample`).  A null or empty text has no words
    and gets the base rate of the labels (0.5 without any); null or repeated ids stay; an empty table gives an empty one;
    further columns are ignored.
    """
    byte_batches(docs.sparkSession)
    model = SubwordClassifier().fit(*training_sample(docs, labels, "quality", max_train, MAX_BYTES))
    rows = narrow(docs, doc_id="doc_id", text="text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    scored = rows.mapInArrow(_score(*model.margins()), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
