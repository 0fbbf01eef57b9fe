"""Best-fit packing (5): bounded-space online best fit over a bitset of free spaces."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STAGE_BATCH, byte_batches, durable, narrow
from .tokens import pieces

CAPACITY = 2048
#: Open bins of a task.
OPEN_BINS = 256
#: Bins left open at a task's end with more than this share free are packed again with those of other tasks.
REPACK_FREE = 0.02
#: Pieces of a group of the second pass.
GROUP_PIECES = 2048


class BestFit:
    """A fixed number of open bins; bit f of the bitset is set while some open bin has f tokens free.

    An item goes to the bin with the least free space that holds it.  If none does, a bin opens; if too many are open then,
    the fullest closes first.  ``closed`` is called with (items, free) of each bin that closes.
    """

    def __init__(self, capacity: int, open_bins: int, closed: Callable[[list, int], None]):
        self.capacity, self.open_bins, self.closed = capacity, open_bins, closed
        self.free: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.bits, self.n = 0, 0

    def _take(self, f: int) -> list:
        of = self.free[f]
        items = of.pop()
        if not of:
            self.bits &= ~(1 << f)
        self.n -= 1
        return items

    def _put(self, f: int, items: list) -> None:
        self.free[f].append(items)
        self.bits |= 1 << f
        self.n += 1

    def _close_fullest(self) -> None:
        f = (self.bits & -self.bits).bit_length() - 1
        self.closed(self._take(f), f)

    def add(self, item, length: int) -> None:
        fits = self.bits >> length
        if fits:
            f = length + (fits & -fits).bit_length() - 1
            items = self._take(f)
        else:
            f, items = self.capacity, []
            if self.n == self.open_bins:
                self._close_fullest()
        items.append(item)
        if f == length:
            self.closed(items, 0)
        else:
            self._put(f - length, items)

    def end(self) -> list[tuple[list, int]]:
        """The bins that are still open, fullest first."""
        out = []
        while self.bits:
            f = (self.bits & -self.bits).bit_length() - 1
            out.append((self._take(f), f))
        return out


PIECE = "piece int, start long, length long, ids_crc32 long"
COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of full length, but for the first, which may be shorter."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    out = [(0, head)] if head else []
    return out + [(s, capacity) for s in range(head, n, capacity)]


def _pack_documents(path: str, share: int, capacity: int, open_bins: int, end_id: int, id_type: pa.DataType):
    """Tokens, pieces and bins of one partition; the text of no other is needed.  ``left``: to be packed again."""
    end = end_id.to_bytes(4, "little")
    schema = pa.schema([("doc_id", id_type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("left", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, base = pieces(path, False, share), TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        made = [0]

        def closed(items: list, free: int, left: bool = False) -> None:
            at, seq = 0, base + made[0]
            made[0] += 1
            for item in items:
                rows.append((*item, seq, at, left))
                at += item[3]

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            rows.clear()
            return out

        bins = BestFit(capacity, open_bins, closed)
        for got in batches:
            for doc, ids in zip(got.column(0).to_pylist(), memory.of_all(got.column(1).to_pylist()), strict=True):
                ids += end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    bins.add((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), length)
            if len(rows) >= 4096:
                yield batch()
        for items, free in bins.end():
            closed(items, free, free > REPACK_FREE * capacity)
        if rows:
            yield batch()

    return run


def _pack_group(capacity: int, open_bins: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        # The order of a group's rows isn't fixed; sorted, longest first, the result is.
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = group.column("length").to_pylist()
        seq, offset, made = np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64"), [0]
        base = (1 << 62) + (key[0].as_py() << 32)

        def closed(items: list, free: int) -> None:
            at = 0
            for i in items:
                seq[i], offset[i] = base + made[0], at
                at += lengths[i]
            made[0] += 1

        bins = BestFit(capacity, open_bins, closed)
        for i, n in enumerate(lengths):
            bins.add(i, n)
        for items, free in bins.end():
            closed(items, free)
        kept = group.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return kept.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset))

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = 0,
    share: int = 1,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where each piece of each document goes.

    A document is its ids and then ``end_id``; one of more than ``capacity`` ids is cut, the first piece may be shorter.
    Each partition packs what it reads as it reads it, with ``open_bins`` open; nothing is shuffled but the pieces of
    bins that stay open to the end, which are dealt into groups of about `GROUP_PIECES` and packed once more, longest first.
    The first pass is written to the shared folder, so a lost executor can't make the two passes disagree.

    With a ``share`` over 1, batches are small and workers remember one in so many segments: less memory, more time.

    A null or empty text is one piece, of the end id only; null or repeated ids stay, each row is a document; an empty table
    gives no pieces; further columns are ignored.
    """
    spark = docs.sparkSession
    byte_batches(spark, STAGE_BATCH) if share > 1 else byte_batches(spark)
    rows = narrow(docs, doc_id=id_col, text=text_col)
    id_type = rows.schema["doc_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, {PIECE}, sequence_id long, offset long, left boolean"
    from pyspark.sql.pandas.types import to_arrow_type

    first = durable(
        rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_pack_documents(tokenizer_path, share, capacity, open_bins, end_id, to_arrow_type(id_type)), schema), "packed"
    )
    left = first.filter("left")
    groups = max(1, -(-left.count() // GROUP_PIECES))
    again = (
        left.select("doc_id", "piece", "start", "length", "ids_crc32", F.pmod(F.xxhash64("sequence_id", "doc_id", "piece"), F.lit(groups)).alias("bucket"))
        .groupBy("bucket")
        .applyInArrow(_pack_group(capacity, open_bins), f"doc_id {id_type.simpleString()}, {PIECE}, sequence_id long, offset long")
    )
    return first.filter("not left").select(*COLUMNS).unionByName(again)
