"""Joins that a plain equality doesn't express, as equality joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: How many times wider a level's cells are than those of the level before.
LEVEL = 16


def range_join(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, width: int, equal: Sequence[str] = ()) -> DataFrame:
    """Pairs with low <= at < high.  Space is cut into cells of ``width``: a range goes to the cells it meets, a point to one,
    and cells are joined; no pair comes twice.  Cells have levels, each `LEVEL` times as wide as the one before: a range goes to the first level at which it meets
    few cells, so however long it is, it has at most ``LEVEL + 1`` copies, and a point has one a level that ranges use.  Empty ranges and
    nulls meet nothing.
    """
    rows = ranges.filter(F.col(low) < F.col(high))
    longest = rows.agg(F.max(F.col(high) - F.col(low))).first()[0]
    levels = 1
    while longest is not None and width * LEVEL**levels < longest:
        levels += 1
    size = F.element_at(F.array(*[F.lit(width * LEVEL**i) for i in range(levels)]), F.col("_level") + 1)
    level = F.lit(0)
    for i in range(1, levels):
        level = level + F.when(F.col(high) - F.col(low) > width * LEVEL**i, 1).otherwise(0)
    p = points.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("_cell", F.floor(F.col(at) / size))
    r = rows.withColumn("_level", level).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / size), F.floor((F.col(high) - 1) / size))))
    return p.join(r, ["_level", "_cell", *equal]).filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_level", "_cell")


def slice_of(df: DataFrame, column: str, slices: int) -> Column:
    """Number of the slice that a value of a column falls into: slices hold about as many rows each, equal values share one, nulls are in the first.

    Only the slices' bounds come to the driver.
    """
    bounds = df.agg(F.percentile_approx(column, [i / slices for i in range(1, slices)], 1000)).first()[0] if slices > 1 else None
    out = F.lit(0)
    for b in sorted(set(bounds or ())):
        out = out + F.when(F.col(column) >= F.lit(b), 1).otherwise(0)
    return out


def asof_join(left: DataFrame, right: DataFrame, equal: Sequence[str], at: str, take: Sequence[str], ties: tuple[str, str] | None = None, slices: int = 32) -> DataFrame:
    """Each left row with the last right row of its key at or before it; nulls where there is none.

    One union sorted by key and time carries the last right row along, linear in both sides.  A key's rows are sorted slice by slice of
    time (`slice_of`), and what a slice begins with comes from a row for each key and slice, so a key with most of the rows is spread too.
    ``ties``: columns that order rows of one time, left and right.  Null keys are one key; rows of a null time come first; empty sides give no
    rows, or nulls.
    """
    tie_l, tie_r = ties or (None, None)
    one = F.struct(*[F.col(c) for c in take])
    kind = right.select(one.alias("x")).schema["x"].dataType
    rest = [c for c in left.columns if c not in equal and c != at]
    a = left.select(*equal, at, F.struct(*rest).alias("_l"), F.lit(None).cast(kind).alias("_r"), (F.col(tie_l) if tie_l else F.lit(0)).cast("long").alias("_tie"), F.lit(1).alias("_side"))
    b = right.select(*equal, at, F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), one.alias("_r"), (F.col(tie_r) if tie_r else F.lit(0)).cast("long").alias("_tie"), F.lit(0).alias("_side"))
    both = a.unionByName(b)
    both = both.withColumn("_slice", slice_of(both, at, slices))
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(equal)]
    ends = both.filter("_side = 0").groupBy(*keys, "_slice").agg(F.max_by("_r", F.struct(at, "_tie")).alias("_end"))
    # A left row's slice begins with the last right row of the slices before it.
    starts = both.select(*keys, "_slice").distinct().join(ends.withColumnsRenamed({"_slice": "_s"} | {f"_k{i}": f"_j{i}" for i in range(len(equal))}), _all_same(len(equal)) & (F.col("_slice") == F.col("_s")), "left")
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(equal))]).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*[f"_k{i}" for i in range(len(equal))], F.col("_slice").alias("_s"), F.last("_end", ignorenulls=True).over(w).alias("_start")).filter("_start IS NOT NULL")
    w = Window.partitionBy(*equal, "_slice").orderBy(at, "_tie", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_in", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    on = F.col("_slice") == F.col("_s")
    for i, c in enumerate(equal):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    out = out.join(starts, on, "left").withColumn("_last", F.coalesce("_in", "_start"))
    return out.select(*equal, at, "_l.*", *[F.col(f"_last.{c}").alias(c) for c in take])


def _all_same(n: int) -> Column:
    out = F.lit(True)
    for i in range(n):
        out = out & F.col(f"_k{i}").eqNullSafe(F.col(f"_j{i}"))
    return out
