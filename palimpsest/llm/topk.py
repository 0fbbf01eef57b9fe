"""Exact top-k search (6): an impact-ordered index, score at a time, with a proof before it stops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, narrow

#: Vectors of an index block, and levels of quantised impact in a dimension.
BLOCK, LEVELS = 4096, 8
#: Segments between two looks at the bounds.
STEP = 128
#: Most queries in a group: more than these meet a block in several groups.
MOST = 8192
#: With fewer possible members than this share of a block, they are scored rather than bounded further.
FEW = 0.1


class ImpactIndex:
    """Postings of each dimension by value, cut into segments of equal counts, each with its least and greatest value."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        n, d = x.shape
        self.order = np.argsort(x, axis=0, kind="stable").T.copy()
        self.bounds = np.unique(np.linspace(0, n, LEVELS + 1).astype(int))
        self.low = x[self.order[:, self.bounds[:-1]], np.arange(d)[:, None]].astype("float64")
        self.high = x[self.order[:, self.bounds[1:] - 1], np.arange(d)[:, None]].astype("float64")

    def search(self, q: np.ndarray, own: int, k: int, threshold: float = -np.inf) -> list[tuple[int, int]]:
        """(score, place) of the k best by score, then id; the place ``own`` is left out, and so may be those that score less than ``threshold``.

        Segments come by descending impact, which is the most a posting in them adds.  After some of them, a vector can't score more than
        what its postings seen so far add at most, and the impact of the next segment for each dimension not seen.  Those that
        could still be members are scored once they are few; the threshold is a k-th best exact score, so what is left out
        is proven not to belong.
        """
        n, d = self.x.shape
        if not n:
            return []
        impact = np.where(q[:, None] >= 0, q[:, None] * self.high, q[:, None] * self.low)
        by_impact = np.argsort(-impact, axis=None, kind="stable")
        dims, levels = np.unravel_index(by_impact, impact.shape)
        impacts = impact.ravel()[by_impact]
        upper, seen = np.zeros(n), np.zeros(n, "int64")
        possible = np.flatnonzero(np.arange(n) != own)
        exact: dict[int, int] = {}
        given = np.isfinite(threshold)
        for at in range(0, len(dims), STEP):
            some = [self.order[a, self.bounds[b] : self.bounds[b + 1]] for a, b in zip(dims[at : at + STEP], levels[at : at + STEP], strict=True)]
            where, sizes = np.concatenate(some), np.array([len(s) for s in some])
            upper += np.bincount(where, np.repeat(impacts[at : at + STEP], sizes), n)
            seen += np.bincount(where, minlength=n)
            rest = impacts[at + STEP] if at + STEP < len(dims) else 0.0
            bound = upper[possible] + (d - seen[possible]) * rest
            # The vectors that lead so far are scored, for a threshold, where none is given.
            lead = possible[:0] if given else possible[np.argpartition(-bound, k)[: k + 1]] if len(possible) > k + 1 else possible
            new = [int(i) for i in lead if int(i) not in exact]
            if new:
                exact.update(zip(new, (self.x[new] @ q).tolist(), strict=True))
            if len(exact) >= k:
                threshold = max(threshold, sorted(exact.values())[-k])
            possible = possible[bound >= threshold]
            if len(possible) <= max(4 * k, FEW * n):
                break
        scores = self.x[possible] @ q
        best = np.lexsort((self.ids[possible], -scores))[:k]
        return [(int(scores[i]), int(possible[i])) for i in best]


def _search_groups(k: int):
    """Of the queries (row, id, v, least) that meet a block of vectors (row, id, v): the k best in it, those under ``least`` left out or not."""

    def run(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(vectors) and len(queries):
            vectors = vectors.sort_by([("id", "ascending"), ("row", "ascending")])
            d = key[0].as_py()
            # Null ids come last among equals.
            ids = vectors.column("id").fill_null(np.iinfo("int64").max).to_numpy()
            null, place = vectors.column("id").is_null().to_numpy(), {r: i for i, r in enumerate(vectors.column("row").to_pylist())}
            index = ImpactIndex(ids, vectors.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d))
            asked = queries.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d)
            for row, own, least, q in zip(queries.column("row").to_pylist(), queries.column("id").to_pylist(), queries.column("least").to_pylist(), asked, strict=True):
                found = index.search(q, place.get(row, -1), k, -np.inf if least is None else least)
                out += [(row, own, None if null[i] else int(ids[i]), s) for s, i in found]
        columns = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["row", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, its k best among all other rows.

    Components are floor(scale * x); the score is the integer inner product, ties go to the smaller id.  The index is made of
    blocks of about `BLOCK` vectors.  Queries go to the blocks, not vectors to the queries: first all to one block, whose k-th best score is a bound that the
    true one can't be under, then with this bound to all others, where whatever is proven to score less is left out.  Each block gives k rows a query
    at most, and the best of these are the result: no task sees more than a block and `MOST` queries.

    Vectors that are null, empty, or hold a null or non-finite component take no part, nor do those whose sum of squares is 2^62 or more, as their
    scores might not fit into a long.  Only vectors of the query's length are
    candidates.  Of rows with equal ids each is a row of its own: a query of its own, and a candidate of the other;
    null ids are candidates, last among equals; an empty table gives an empty one; further columns are ignored.
    """
    rows = narrow(vectors, id=id_col, v=vector_col)
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < 2.0**31 / scale))
    whole = F.transform("v", lambda x: F.floor(scale * x.cast("double")).cast("long"))
    small = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) < 2.0**62
    rows = rows.filter(fine).select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), whole.alias("v")).filter(small)
    rows = durable(rows.select("*", F.size("v").alias("d")).filter("d > 0"), "vectors")
    is_query = F.col("id") % every == 0
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    blocks, groups = max(1, -(-n // BLOCK)), max(1, -(-n_queries // MOST))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    left = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # Renamed and back, as the two sides of a cogroup may not share columns.
    queries = rows.filter(is_query).toDF("a", "b", "c", "e").select(F.col("a").alias("row"), F.col("b").alias("id"), F.col("c").alias("v"), F.col("e").alias("d"))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)).cast("int"))
    out = "row long, query_id long, vec_id long, score long"

    def met(of: DataFrame, asked: DataFrame) -> DataFrame:
        return of.groupBy("d", "block", "part").cogroup(asked.groupBy("d", "block", "part")).applyInArrow(_search_groups(k), out)

    # The first block is searched without a bound.
    seed = durable(met(left.filter("block = 0"), queries.select("*", F.lit(0).alias("block"), F.lit(None).cast("double").alias("least"))), "seed")
    bound = seed.groupBy("row").agg(F.count("*").alias("m"), F.min("score").cast("double").alias("least")).select("row", F.when(F.col("m") == k, F.col("least")).alias("least"))
    found = seed
    if blocks > 1:
        asked = queries.join(bound, "row", "left").withColumn("block", F.explode(F.sequence(F.lit(1), F.lit(blocks - 1))))
        found = seed.union(met(left.filter("block > 0"), asked))
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
