"""MinHash near-duplicates (10): DartMinHash signatures, banded joins, exact check, classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import STAGE_BATCH, byte_batches, durable, narrow
from .dart_minhash import mix, signature

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares a band with a chance of 1 - (1 - 0.8^5)^25 = 0.99995.
BANDS, ROWS = 25, 5
COORDINATES = 128
#: Rounds with one pivot a bucket, before what is left of a bucket is paired up between classes.
PIVOT_ROUNDS = 1
#: Nodes of a bucket, and elements of their sets, that a block holds, about; a cell of that last step has two blocks.
CELL, CELL_ELEMENTS = 512, 1 << 19
#: Edges of a graph, at most, whose components one task finds; beyond, rounds of joins do.
SMALL = 1 << 19

_P = np.uint64(0x100000001B3)


class Shingler:
    """Distinct hashes of a text's windows of five words, sorted, with weights.

    A-Z count as lower case.  A text of one to four words has one shingle, all of it; one without words has none.
    ``by_count``: an element weighs as often as it occurs; else 1.
    """

    def __init__(self, n: int = SHINGLE, by_count: bool = False):
        self.n, self.by_count = n, by_count

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        # Of bytes, lower() changes A-Z only, and split() knows the six white space characters only.
        keys = (text or "").encode().lower().split()
        w = mix(np.fromiter(map(xxhash.xxh64_intdigest, keys), "uint64", len(keys)))
        n = min(self.n, len(w))
        if not n:
            return w, np.empty(0)
        with np.errstate(over="ignore"):
            h = w[: len(w) - n + 1].copy()
            for i in range(1, n):
                h = mix(h * _P + w[i : len(w) - n + 1 + i])
        found, counts = np.unique(h, return_counts=True)
        return found, counts.astype("float64") if self.by_count else np.ones(len(found))


def _node(elements: np.ndarray, weights: np.ndarray) -> int:
    """Hash of the weighted set: texts that have it in common are alike."""
    with np.errstate(over="ignore"):
        h = mix(elements + mix(weights.astype("uint64")))
        return int(mix(np.array([h.sum() + mix(np.bitwise_xor.reduce(h, keepdims=True))[0]], "uint64"))[0].astype("int64"))


def _signatures(shingle: int, by_count: bool, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(shingle, by_count)
        for batch in batches:
            nodes, sizes, bands = [], [], []
            for text in batch.column(2).to_pylist():
                e, w = shingles(text)
                sizes.append(int(w.sum()))
                if not len(e):
                    nodes.append(None)
                    bands.append([])
                    continue
                nodes.append(_node(e, w))
                s = signature(e, w, COORDINATES)[: BANDS * ROWS].reshape(BANDS, ROWS)
                h = np.arange(BANDS, dtype="uint64")
                for i in range(ROWS):
                    h = mix(mix(h) ^ s[:, i])
                bands.append(h.astype("int64"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "t", "node", "n", "bands"]
            )

    return run


def _shingle_sets(shingle: int, by_count: bool):
    """Each weighted set as a plain one: of an element of weight 3, three numbered copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(shingle, by_count)
        for batch in batches:
            nodes, sets = [], []
            for text in batch.column(0).to_pylist():
                e, w = shingles(text)
                nodes.append(_node(e, w) if len(e) else None)
                if by_count and len(e):
                    k = w.astype("int64")
                    copy = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    e = mix(np.repeat(e, k) ^ mix(copy.astype("uint64")))
                sets.append(e.astype("int64"))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "elements"])

    return run


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of undirected ``edges`` (a, b): label is the least node of the component.

    Up to `SMALL` edges go through one task, so that they aren't written and shuffled in small files once a round.  Else, each round takes the least label among the neighbours, then the label of that label; what a node sends is combined before
    the shuffle, so a node with many edges is no hot spot.
    """
    if edges.count() <= SMALL:
        return durable(edges.select("a", "b").coalesce(1).mapInArrow(_components, "node long, label long"), "labels")
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = durable(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        took = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = durable(took.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("label")), "labels")
        if new.filter("label < old").limit(1).count() == 0:
            return new.select("node", "label")
        labels = new.select("node", "label")


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What `connected` gives, of all edges of a partition: labels go along edges, then to the label's label."""
    edges = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches]
    if not edges:
        return
    ids, codes = np.unique(np.concatenate(edges, axis=1), return_inverse=True)
    a, b = codes.reshape(2, -1)
    label, old = np.arange(len(ids)), None
    while old is None or (label != old).any():
        old = label.copy()
        np.minimum.at(label, a, old[b])
        np.minimum.at(label, b, old[a])
        label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["node", "label"])


def _relabelled(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Labels after ``edges`` (a, b) between nodes: joined through the labels so far."""
    if labels is None:
        return connected(edges)
    return connected(edges.select("a", "b").union(labels.select("node", "label")).filter("a != b"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, by_count: bool = True) -> DataFrame:
    """(doc_id, t, node, n_shingles, class_id, class_size, label): one row per row of ``docs``; t is a hash of its text.

    Documents whose sets of shingles agree, with their counts, are one node.  Nodes that share a band of their DartMinHash signatures are
    checked exactly (Jaccard similarity weighted by the counts of shingles, or of plain sets without ``by_count``) and the classes are the
    components of the links.  In a bucket, one pivot a round is compared with all nodes of other classes and then leaves it;
    a bucket ends when one class is left in it.  So a group of m copies costs about m pairs, and of the pairs that share a band, none between different
    classes goes unchecked: after `PIVOT_ROUNDS` rounds, what is still mixed is compared between classes, cell by cell of two blocks of
    `CELL` nodes, which gives fewer links than a cell has nodes; each pair is checked once, however many bands it shares, and not at all once its cell has joined it.  Pairs of a similarity below ``similarity`` are not looked for.
    class_id is the least doc_id of the class; where ids are null or repeat, classes may have it in common.  label tells all
    classes of texts with words apart: it is the least node of the class.

    A null text is empty; texts without words have no shingles, each is its own class (node and label null, class_id its doc_id).  Null
    ids stay and count for class_id only where a class has no other; rows that repeat fall into one class; an empty
    table gives an empty one; further columns are ignored.
    """
    spark = docs.sparkSession
    byte_batches(spark, STAGE_BATCH)
    from pyspark.sql.pandas.types import to_arrow_type

    rows = narrow(docs, doc_id=id_col, text=text_col)
    id_type = rows.schema["doc_id"].dataType
    signed = durable(
        rows.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(_signatures(shingle, by_count, to_arrow_type(id_type)), f"doc_id {id_type.simpleString()}, t long, node long, n long, bands array<long>"),
        "signatures",
    )
    nodes = durable(signed.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.count("*").alias("copies")), "nodes")
    labels = _linked(rows, signed, nodes, similarity, shingle, by_count)
    if labels is not None:
        labels = nodes.join(labels, "node", "left").select("node", "least", "copies", F.coalesce("label", "node").alias("label"))
        of = labels.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
        of = labels.join(of, "label").select("node", "label", "class_id", "class_size")
    else:
        of = nodes.select("node", F.col("node").alias("label"), F.col("least").alias("class_id"), F.col("copies").alias("class_size"))
    return signed.join(of, "node", "left").select(
        "doc_id", "t", "node", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), "label"
    )


def _linked(rows: DataFrame, signed: DataFrame, nodes: DataFrame, similarity: float, shingle: int, by_count: bool) -> DataFrame | None:
    """(node, label) of the nodes with links; None if there are none."""
    buckets = signed.select("node", F.posexplode("bands").alias("band", "h")).groupBy("band", "h", "node").agg(F.lit(1).alias("one"))
    shared = buckets.groupBy("band", "h").agg(F.count("*").alias("k")).filter("k > 1").select("band", "h")
    members = durable(buckets.join(shared, ["band", "h"]).join(nodes.select("node", "n"), "node").select(F.xxhash64("band", "h").alias("bucket"), "band", "node", "n"), "members")
    wanted = members.select("node").distinct().join(nodes, "node").select("node", F.col("least").alias("doc_id"))
    texts = rows.join(wanted.select("doc_id").distinct().withColumnRenamed("doc_id", "w"), F.col("doc_id").eqNullSafe(F.col("w")), "left_semi").select("text")
    sets = durable(texts.mapInArrow(_shingle_sets(shingle, by_count), "node long, elements array<long>").join(wanted.select("node"), "node", "left_semi"), "sets")

    labels = None
    for _ in range(PIVOT_ROUNDS):
        at = _mixed(members, labels)
        pairs = at.filter("label != p.label").select(F.col("p.node").alias("x"), F.col("p.n").alias("nx"), F.col("node").alias("y"), F.col("n").alias("ny"))
        members = at.filter("node != p.node").select("bucket", "band", "node", "n")
        # Sets whose sizes differ by more can't be that similar.
        pairs = pairs.filter(F.least("nx", "ny") >= similarity * F.greatest("nx", "ny"))
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("nx") + F.col("ny")).alias("both")).distinct()
        links = durable(_checked(pairs, sets, similarity).filter("linked").select("a", "b"), "pairs")
        if links.limit(1).count():
            labels = _relabelled(labels, links)
    bands = signed.join(_mixed(members, labels).select("node").distinct(), "node").groupBy("node").agg(F.first("bands").alias("bands"))
    rest = _mixed(members, labels).drop("p").join(bands, "node").join(sets, "node")
    links = durable(_between_classes(rest, similarity), "links")
    return _relabelled(labels, links) if links.limit(1).count() else labels


def _mixed(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of buckets with nodes of several labels, with their own, the bucket's pivot p, its number of members m and the sum of their sizes."""
    at = members.withColumn("label", F.col("node")) if labels is None else members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = at.groupBy("bucket").agg(F.min("label").alias("lo"), F.max(F.struct("label", "node", "n")).alias("p"), F.count("*").alias("m"), F.sum("n").alias("volume")).filter("lo < p.label").select("bucket", "p", "m", "volume")
    return at.join(mixed, "bucket")


def _between_classes(at: DataFrame, similarity: float) -> DataFrame:
    """(a, b): labels of nodes of one bucket that are linked, as many as it takes to join what the links of a cell join.

    A bucket is dealt into blocks of about `CELL` nodes or `CELL_ELEMENTS` elements, and two blocks meet in a cell of their own, so no cell grows with a bucket.
    A cell gives fewer links than it has nodes, however many pairs of them are alike.
    """
    blocks = F.greatest(F.col("m") / CELL, F.least(F.col("volume") / CELL_ELEMENTS, "m"))
    last = (F.ceil(blocks) - 1).cast("int")
    dealt = at.withColumn("i", F.pmod(F.xxhash64("node"), last + 1).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), last)))
    cells = dealt.select("bucket", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "band", "node", "n", "label", "bands", "elements")
    cells = cells.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return cells.mapInArrow(_cell_links(similarity), "a long, b long")


def _cell_links(similarity: float):
    """Links of the cells of a partition, which is sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            found = []
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "lo", "hi", "i", "band", "n", "label")]
            keys = np.stack(columns[:3], axis=1)
            bands = batch.column("bands").flatten().to_numpy().reshape(-1, BANDS)
            elements, sizes = batch.column("elements").flatten().to_numpy(), batch.column("elements").value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if held and (keys[lo] != key).any():
                    found += _forest(held, similarity)
                    held = []
                key = keys[lo].copy()
                held.append([*(c[lo:hi] for c in columns[3:]), bands[lo:hi], sizes[lo:hi], elements[ends[lo] - sizes[lo] : ends[hi - 1]]])
            # What goes on in the next batch must not keep this one.
            held = [[c.copy() for c in part] for part in held]
            yield _links(found)
        if held:
            yield _links(_forest(held, similarity))

    return run


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _forest(parts: list[list[np.ndarray]], similarity: float) -> list[tuple[int, int]]:
    """Pairs of labels that join all nodes of a cell that its links join; nodes already joined are not compared.

    Nodes of two blocks meet in a cell of both, those of one block in its own.  A pair that shares several bands is checked in the first one.
    """
    block, band, n, label, bands, sizes, elements = parts[0] if len(parts) == 1 else (np.concatenate(c) for c in zip(*parts))
    joined = label.copy()
    if (joined == joined[0]).all():
        return []
    apart, starts, found = (block != block[0]).any(), np.cumsum(sizes) - sizes, []
    distinct, codes = np.unique(elements, return_inverse=True)
    mark = np.zeros(len(distinct), "bool")
    for x in range(len(n) - 1):
        ys = np.flatnonzero(joined[x + 1 :] != joined[x]) + x + 1
        if apart:
            ys = ys[block[ys] != block[x]]
        # Sets whose sizes differ by more can't be that similar.
        ys = ys[np.minimum(n[ys], n[x]) >= similarity * np.maximum(n[ys], n[x])]
        ys = ys[(bands[ys] == bands[x]).argmax(axis=1) == band[x]] if len(ys) else ys
        if not len(ys):
            continue
        own = codes[starts[x] : starts[x] + sizes[x]]
        mark[own] = True
        before = np.cumsum(sizes[ys]) - sizes[ys]
        theirs = codes[np.repeat(starts[ys] - before, sizes[ys]) + np.arange(sizes[ys].sum())]
        common = np.add.reduceat(mark[theirs], before, dtype="int64")
        mark[own] = False
        for y in ys[common * (1 + similarity) >= similarity * (n[ys] + n[x]) - 1e-9].tolist():
            if joined[y] != joined[x]:
                found.append((int(label[x]), int(label[y])))
                joined[joined == joined[y]] = joined[x]
    return found


def _linked_sets(a: str, b: str, both, similarity: float):
    """common / (both - common) >= similarity, with the common elements counted once."""
    return F.size(F.array_intersect(a, b)) * (1 + similarity) >= similarity * both - 1e-9


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, linked) of the pairs (a, b, both), by their sets."""
    a, b = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea")), sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", _linked_sets("ea", "eb", F.col("both"), similarity).alias("linked"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows and all columns of ``docs``, of each class that with the least id; cases as of `classes`."""
    names = docs.columns
    found = classes(docs, id_col, text_col, **options)
    alone = found.filter("node IS NULL").select("doc_id", "t").distinct().withColumn("m", F.lit(0).cast("long"))
    least = found.filter("node IS NOT NULL AND doc_id <=> class_id")
    # Rows that repeat an id may be several; of those, one text, and of that, one row.
    # By label, as classes of null or repeated ids have their class_id in common.
    kept = least.groupBy("label").agg(F.min(F.struct("doc_id", "t")).alias("x"), F.count("*").alias("m")).select("x.doc_id", "x.t", "m")
    kept = kept.unionByName(alone).withColumnsRenamed({"doc_id": "__id", "t": "__t", "m": "__m"})
    numbered = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    i, t = F.col(f"__c{names.index(id_col)}"), F.col(f"__c{names.index(text_col)}")
    got = numbered.join(kept, i.eqNullSafe(F.col("__id")) & (F.xxhash64(t) == F.col("__t")))
    again = got.filter("__m > 1").withColumn("__r", F.row_number().over(Window.partitionBy("__id", "__t").orderBy(t))).filter("__r = 1").drop("__r")
    return got.filter("__m <= 1").unionByName(again).select(*numbered.columns).toDF(*names)
