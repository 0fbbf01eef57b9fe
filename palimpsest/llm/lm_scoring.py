"""LM scoring (3): bigrams by deleted interpolation, weights by context-frequency buckets learnt with expectation-maximisation.

    p(w | x) = a c(x, w) / c(x) + b c(w) / N + c / (V + 1),   (a, b, c) by the bucket of c(x)

Every word is a context of its own.  Texts are gathered into blocks of a bounded size.  A block asks for the count of each
distinct word and pair it holds, together with what it adds to that count itself; questions go to shards by ranges of the
64-bit key, sorted and as differences.  A shard adds up and answers in the order of the questions, so an answer carries no keys.
A key has one question a block, so no key is a hot spot; what a worker holds is one block or one shard.  Nothing is
cut off, and no table of words or pairs goes to the driver or to all executors.  The weights are learnt on the deleted fold, whose texts
have blocks of their own, from sums over cells of a grid.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILE_ROWS, byte_batches, durable, narrow, release
from .dart_minhash import mix

#: Folds by crc32 of the id: 0 is held out, 1 is deleted (for the weights), the rest and 1 give the counts.
FOLDS = 10
#: Bytes of text in a block, and bytes of text a shard is meant to stand for.
BLOCK_BYTES, SHARD_BYTES = 4 << 20, 5 << 20
#: Texts are hashed piece by piece of about so many bytes.
PIECE = 1 << 19
#: Buckets: the binary order of a context's share, then the start of a text, then contexts never seen.
ORDERS = 48
START, UNSEEN = ORDERS, ORDERS + 1
#: Cells a decade of the grid on which the weights are learnt.
GRID = 8
ITERATIONS = 40

_R = np.uint64(0x9E3779B97F4A7C15)
_R_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype="uint8")
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_EVEN, _ODD = ~np.uint64(1), np.uint64(1)
_powers = [np.ones(1, "uint64"), np.ones(1, "uint64")]


def fold_of(doc_id):
    """crc32 of the id as text, modulo `FOLDS`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_R, _R_BACK)):
            x = np.full(n, base)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers


def _finished(h: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Keys of words are even, those of pairs odd."""
    with np.errstate(over="ignore"):
        return mix(h + length.astype("uint64") * _R_BACK) & _EVEN


#: The key of a text's end, which is the empty word.
END = _finished(np.zeros(1, "uint64"), np.zeros(1, "int64"))[0]


def word_keys(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of each word of the bytes: a polynomial of its bytes, A-Z as a-z, and its length, mixed."""
    if not raw:
        return np.empty(0, "uint64"), np.empty(0, "int64")
    a = _LOWER[np.frombuffer(raw, "uint8")]
    space = _SPACE[a]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, "uint64"), start
    powers, back = _power(len(a))
    with np.errstate(over="ignore"):
        total = np.zeros(len(a) + 1, "uint64")
        np.cumsum(a * powers[: len(a)], out=total[1:])
        return _finished((total[end] - total[start]) * back[start], end - start), start


def _pieces(raw: bytes, size: int) -> Iterator[tuple[int, int]]:
    """Stretches of about ``size`` bytes, cut at spaces."""
    at = 0
    while len(raw) - at > size:
        cut = raw.rfind(b" ", at, at + size)
        if cut <= at:
            cut = raw.find(b" ", at + size)
            if cut < 0:
                break
        yield at, cut
        at = cut
    yield at, len(raw)


class Block:
    """Tokens of some texts, their distinct words (of some place in ``words``), and their distinct pairs.

    ``counted``: of each text, whether it adds to the counts.
    """

    def __init__(self, texts: list[bytes], counted: np.ndarray):
        raw, ends = b"\n".join(texts), np.cumsum([len(t) + 1 for t in texts])
        parts = [(k, at + start) for start, end in _pieces(raw, PIECE) for k, at in [word_keys(raw[start:end])]]
        keys, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        n = np.diff(np.searchsorted(at, ends), prepend=0)
        del raw, at, parts
        #: Place after the last token of each text, its end included.
        self.ends = np.cumsum(n + 1)
        keys = np.insert(keys, np.cumsum(n), END)
        self.words, token = np.unique(keys, return_inverse=True)
        del keys
        #: The start of a text is the context after all words.
        m = len(self.words)
        before = np.concatenate(([m], token[:-1]))
        before[self.ends[:-1]] = m
        self.pair_of = before * m + token
        self.token, adds = token, np.repeat(counted, n + 1)
        self.n_word = np.bincount(token, adds, m).astype("int64")
        tagged = np.sort(self.pair_of * 2 + adds)
        new = np.flatnonzero(np.diff(tagged >> 1, prepend=-1))
        self.pairs = tagged[new] >> 1
        self.n_pair = np.add.reduceat(tagged & 1, new)
        self.first, self.second = self.pairs // m, self.pairs % m
        with np.errstate(over="ignore"):
            context = np.append(self.words, _R)
            pair_keys = mix(mix(context)[self.first] * _R + self.words[self.second]) | _ODD
        self.keys = np.concatenate((self.words, pair_keys))
        self.order = np.argsort(self.keys)

    def questions(self, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, keys, counts), keys in order; a shard has a range of the keys' upper halves."""
        keys, counts = self.keys[self.order], np.concatenate((self.n_word, self.n_pair))[self.order]
        shard = ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype("int64")
        ends = np.searchsorted(shard, np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(ends)).tolist():
            yield s, keys[ends[s] : ends[s + 1]], counts[ends[s] : ends[s + 1]]

    def placed(self, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of the words, of the pairs, and of the contexts: a word is followed by a token whenever it occurs, and starts are as many as ends."""
        out = np.empty(len(answers), "int64")
        out[self.order] = answers
        words = out[: len(self.words)]
        return words, out[len(self.words) :], np.append(words, words[np.searchsorted(self.words, END)])


def _squeezed(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte plane by byte plane."""
    raw = b"".join(np.ascontiguousarray(x.view("uint8").reshape(len(x), -1).T).tobytes() for x in columns)
    return struct.pack("<I", len(columns[0])) + zstandard.ZstdCompressor(level=1).compress(raw)


def _opened(blob: bytes, *kinds: str) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<I", blob)
    raw, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:]), "uint8"), [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def _blocks(id_type: pa.DataType):
    """Rows (block, deleted, blob, ids, folds): the texts of a block, and the ids and folds of its rows."""

    def closed(number: int, deleted: bool, texts: list[bytes], ids: list, folds: list[int]) -> pa.RecordBatch:
        lengths = np.array([len(t) for t in texts], "uint32")
        blob = struct.pack("<I", len(texts)) + zstandard.ZstdCompressor(level=1).compress(lengths.tobytes() + b"".join(texts))
        columns = [pa.array([number], pa.int64()), pa.array([deleted]), pa.array([blob], pa.binary()), pa.array([ids], pa.list_(id_type)), pa.array([folds], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, ["block", "deleted", "blob", "ids", "folds"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Attempts at a task give its blocks the same numbers.
        number, held = TaskContext.get().partitionId() << 32, {d: [[], [], [], 0] for d in (False, True)}
        for batch in batches:
            for i, fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                mine = held[fold == 1]
                mine[0].append(text)
                mine[1].append(i)
                mine[2].append(fold)
                mine[3] += len(text) + 1
                if mine[3] >= BLOCK_BYTES:
                    held[fold == 1] = [[], [], [], 0]
                    yield closed(number, fold == 1, *mine[:3])
                    number += 1
        for deleted, mine in held.items():
            if mine[0]:
                yield closed(number, deleted, *mine[:3])
                number += 1

    return run


def _opened_block(blob: bytes, folds: list[int]) -> Block:
    (n,) = struct.unpack_from("<I", blob)
    raw = zstandard.ZstdDecompressor().decompress(blob[4:])
    ends = 4 * n + np.cumsum(np.frombuffer(raw, "uint32", n), dtype="int64")
    return Block([raw[a:b] for a, b in zip([4 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)], np.array(folds) > 0)


def _questions(shards: int):
    """Rows (block, shard, deleted, blob): what a block asks of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, deleted, blob, folds = (batch.column(i)[row].as_py() for i in range(4))
                asked = [(s, _squeezed(np.diff(k, prepend=np.uint64(0)), n.astype("uint32"))) for s, k, n in _opened_block(blob, folds).questions(shards)]
                k = len(asked)
                columns = [pa.array([block] * k, pa.int64()), pa.array([s for s, _ in asked], pa.int32()), pa.array([deleted] * k), pa.array([b for _, b in asked], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "shard", "deleted", "blob"])
                pa.default_memory_pool().release_unused()

    return run


def _answers(asked: pa.Table) -> pa.Table:
    """Of one shard: for each block the counts of its keys; and one row (block null) of the shard's sums N, kept N and V."""
    blocks, deleted, out = asked.column("block").to_pylist(), asked.column("deleted").to_pylist(), []
    parts = [_opened(b, "uint64", "uint32") for b in asked.column("blob").to_pylist()]
    ends = np.cumsum([len(n) for _, n in parts])
    with np.errstate(over="ignore"):
        keys = np.concatenate([np.cumsum(d, dtype="uint64") for d, _ in parts])
    counts = np.concatenate([n for _, n in parts]).astype("int64")
    kept = counts * np.repeat(~np.array(deleted, bool), np.diff(ends, prepend=0))
    del parts
    order = np.argsort(keys)
    new = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))
    sizes = np.diff(np.append(new, len(keys)))
    total, kept = (np.add.reduceat(x[order], new) for x in (counts, kept))
    is_word = keys[order[new]] & _ODD == 0
    sums = [int(total[is_word].sum()), int(kept[is_word].sum()), int((total[is_word] > 0).sum())]
    del keys, counts
    mine = np.empty((2, len(order)), "uint32")
    for row, x in enumerate((total, kept)):
        if total.max(initial=0) >= 1 << 32:
            raise OverflowError("a count does not fit into 32 bits")
        mine[row, order] = np.repeat(x, sizes)
    for block, d, a, b in zip(blocks, deleted, np.concatenate(([0], ends[:-1])), ends, strict=True):
        out.append((block, _squeezed(mine[0, a:b], mine[1, a:b]) if d else _squeezed(mine[0, a:b])))
    shard = asked.column("shard")[0].as_py()
    columns = [pa.array([*(b for b, _ in out), None], pa.int64()), pa.array([shard] * (len(out) + 1), pa.int32()), pa.array([*(b for _, b in out), None], pa.binary())]
    return pa.table([*columns, *(pa.array([None] * len(out) + [s], pa.int64()) for s in sums)], names=["block", "shard", "blob", "n", "kept_n", "v"])


def _in_order(answers: pa.Table) -> list[bytes]:
    return [b for _, b in sorted(zip(answers.column("shard").to_pylist(), answers.column("blob").to_pylist(), strict=True))]


def buckets(context: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """By the binary order of a context's share of the tokens; starts, and contexts never seen, have their own."""
    b = np.clip(np.floor(-np.log2(np.maximum(context, 1) / max(n, 1))), 0, ORDERS - 1).astype("int64")
    return np.where(start, START, np.where(context > 0, b, UNSEEN))


def cells(bucket: np.ndarray, p2: np.ndarray, p1: np.ndarray, weight: np.ndarray) -> dict[int, list[float]]:
    """Of held-out tokens, by cell of a grid over both estimates: weight and weighted sums of the estimates."""

    def order(p):
        return np.where(p > 0, np.clip(np.floor(-np.log10(np.maximum(p, 1e-15)) * GRID), 0, 15 * GRID) + 1, 0).astype("int64")

    key = (bucket * 256 + order(p2)) * 256 + order(p1)
    found, back = np.unique(key, return_inverse=True)
    sums = [np.bincount(back, x, len(found)) for x in (weight, weight * p2, weight * p1)]
    return {int(k): [float(s[i]) for s in sums] for i, k in enumerate(found)}


def learn_weights(grid: dict[int, list[float]], n_buckets: int, v: int) -> np.ndarray:
    """Expectation-maximisation of the three weights of each bucket; buckets without held-out tokens keep even ones."""
    out = np.full((n_buckets, 3), 1 / 3)
    key = np.array(list(grid), "int64")
    if not len(key):
        return out
    w, s2, s1 = np.array(list(grid.values())).T
    bucket, p2, p1 = key // 65536, s2 / w, s1 / w
    for _ in range(ITERATIONS):
        share = out[bucket] * np.stack([p2, p1, np.full(len(w), 1 / (v + 1))], axis=1)
        share *= (w / share.sum(axis=1))[:, None]
        sums = np.stack([np.bincount(bucket, share[:, i], n_buckets) for i in range(3)], axis=1)
        total = sums.sum(axis=1, keepdims=True)
        out = np.where(total > 0, sums / np.maximum(total, 1e-300), out)
    out = np.maximum(out, 1e-6)
    return out / out.sum(axis=1, keepdims=True)


def _deleted_cells(kept_n: int):
    """Sums over the grid's cells of a block of the deleted fold, whose own counts are left out of the estimates."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        grid = {}
        if texts.num_rows:
            b = _opened_block(texts.column("blob")[0].as_py(), texts.column("folds")[0].as_py())
            word, pair, context = b.placed(np.concatenate([_opened(x, "uint32", "uint32")[1] for x in _in_order(answers)]))
            at = context[b.first]
            grid = cells(buckets(at, b.first == len(b.words), kept_n), pair / np.maximum(at, 1), word[b.second] / max(kept_n, 1), b.n_pair.astype("float64"))
        return pa.table({"cell": pa.array(list(grid), pa.int64()), **{c: pa.array([x[i] for x in grid.values()], pa.float64()) for i, c in enumerate(("w", "s2", "s1"))}})

    return run


def _scores(weights: np.ndarray, n: int, v: int, id_type: pa.DataType):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        ids, folds, columns = [], np.empty(0, "int64"), [np.empty(0)] * 4
        if texts.num_rows:
            ids, folds = texts.column("ids")[0].as_py(), np.array(texts.column("folds")[0].as_py())
            b = _opened_block(texts.column("blob")[0].as_py(), folds)
            word, pair, context = b.placed(np.concatenate([_opened(x, "uint32")[0] for x in _in_order(answers)]))
            at, starts = context[b.first], np.concatenate(([0], b.ends[:-1]))
            w = weights[buckets(at, b.first == len(b.words), n)]
            p = np.log10(w[:, 0] * pair / np.maximum(at, 1) + w[:, 1] * word[b.second] / max(n, 1) + w[:, 2] / (v + 1))
            base = np.log10((word + 0.1) / (n + 0.1 * (v + 1)))
            each = ((word > 0).astype("int64")[b.token], base[b.token], p[np.searchsorted(b.pairs, b.pair_of)])
            columns = [np.diff(b.ends, prepend=0), *(np.add.reduceat(x, starts) for x in each)]
        kinds = ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())
        return pa.table({"doc_id": pa.array(ids, id_type), "fold": pa.array(folds, pa.int32()), **{name: pa.array(x.astype(kind.to_pandas_dtype())) for x, (name, kind) in zip(columns, kinds, strict=True)}})

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of ``docs``.

    Tokens are the words of the text, A-Z as a-z, and one end.  Counts are those of all texts out of fold 0; the weights are learnt on
    fold 1 against the counts of folds 2 to 9.  Contexts are the word before; the start of a text, and words that no training text
    has, have buckets of their own.  score is the sum of log10 p over the text, base_score that of unigrams with 0.1 added to each count.

    A null text is empty (its end only); null ids are the empty text for the folds; rows that repeat count and are scored each;
    without training texts all counts are zero; an empty table gives an empty one; further columns are ignored.
    """
    spark = docs.sparkSession
    byte_batches(spark)
    from pyspark.sql.pandas.types import to_arrow_type

    rows = narrow(docs, doc_id=id_col, text=text_col)
    kind, id_type = rows.schema["doc_id"].dataType.simpleString(), to_arrow_type(rows.schema["doc_id"].dataType)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = rows.select("doc_id", fold_of(F.col("doc_id")).cast("int").alias("fold"), text.alias("text"))
    size, n_rows = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-size // SHARD_BYTES))

    texts = durable(rows.mapInArrow(_blocks(id_type), f"block long, deleted boolean, blob binary, ids array<{kind}>, folds array<int>"), "texts")
    asked = texts.select("block", "deleted", "blob", "folds").mapInArrow(_questions(shards), "block long, shard int, deleted boolean, blob binary")
    answers = durable(asked.groupBy("shard").applyInArrow(_answers, "block long, shard int, blob binary, n long, kept_n long, v long"), "answers")
    n, kept_n, v = (x or 0 for x in answers.filter("block IS NULL").agg(F.sum("n"), F.sum("kept_n"), F.sum("v")).first())
    del asked
    release(spark)

    told = answers.filter("block IS NOT NULL").select("block", "shard", "blob")
    learnt = texts.filter("deleted")
    mine = told.join(learnt.select("block"), "block", "left_semi")
    found = learnt.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(_deleted_cells(kept_n), "cell long, w double, s2 double, s1 double")
    grid = {r[0]: [r[1], r[2], r[3]] for r in found.groupBy("cell").agg(F.sum("w"), F.sum("s2"), F.sum("s1")).collect()}
    weights = learn_weights(grid, UNSEEN + 1, v)
    release(spark)

    scored = texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_scores(weights, n, v, id_type), f"doc_id {kind}, fold int, n_tokens long, n_known long, base_score double, score double")
    # Rows are short: dealt out anew, they make few files, and the tasks that score stay as many as they are.
    scored = scored.repartition(max(spark.sparkContext.defaultParallelism, n_rows // FILE_ROWS))
    return scored.select("doc_id", (F.col("fold") == 0).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
