"""Constraints as queries for the rows that break them; an empty result means that all hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ForeignKey, TableDef
from .joins import slice_of


def unique(df: DataFrame, key: Sequence[str], nulls_distinct: bool = True) -> DataFrame:
    """(key, n) of keys that occur more than once.  ``nulls_distinct``: a key with a null equals no other."""
    if nulls_distinct:
        for c in key:
            df = df.filter(F.col(c).isNotNull())
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return df.filter(bad)


def check(df: DataFrame, condition: str | Column) -> DataFrame:
    """Rows for which the condition is false; unknown passes."""
    c = F.expr(condition) if isinstance(condition, str) else condition
    return df.filter(~c)


def foreign_key(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """Child rows without a parent; a key with a null refers to none."""
    for c in fk.columns:
        child = child.filter(F.col(c).isNotNull())
    on = parent.select(*[F.col(p).alias(c) for p, c in zip(fk.parent_columns, fk.columns, strict=True)])
    return child.join(on, list(fk.columns), "left_anti").select(*child.columns)


def cascade(child: DataFrame, moved: DataFrame, column: str) -> DataFrame:
    """ON UPDATE CASCADE: the child with ``column`` changed as ``moved`` (old, new) says."""
    return child.join(moved.select(F.col("old").alias(column), F.col("new").alias("_new")), column, "left").withColumn(column, F.coalesce("_new", column)).select(*child.columns)


def overlaps(df: DataFrame, pk: Sequence[str], low: str, high: str, equal: Sequence[str] = (), slices: int = 32) -> DataFrame:
    """Rows whose range [low, high) meets that of another row, with ``equal`` columns alike (an exclusion constraint).

    A row breaks it if a range before it, by start, reaches past its start, or the next one starts before its end.  So sorting
    by start in each group of equals does it, instead of comparing pairs.  A group is sorted slice by slice of starts (`joins.slice_of`), and a row for each group and
    slice says how far the slices before reach and where those after start: neither a large group nor a table without ``equal`` is one task's.
    Empty ranges meet nothing; a null start or end is open; nulls in ``equal`` meet nothing.
    """
    rows = df.filter((F.col(low) < F.col(high)) | F.col(low).isNull() | F.col(high).isNull())
    for c in equal:
        rows = rows.filter(F.col(c).isNotNull())
    rows = rows.withColumn("_slice", slice_of(rows, low, slices)).withColumn("_far", F.struct(F.col(high).isNull().alias("open"), F.col(high).alias("end")))
    ends = rows.groupBy(*equal, "_slice").agg(F.max("_far").alias("_m"), F.min(low).alias("_first"))
    group = Window.partitionBy(*(equal or [F.lit(0)])).orderBy("_slice")
    ends = ends.select(*equal, "_slice", F.max("_m").over(group.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.min("_first").over(group.rowsBetween(1, Window.unboundedFollowing)).alias("_next"))
    w = Window.partitionBy(*equal, "_slice").orderBy(F.col(low).asc_nulls_first(), *pk)
    at = rows.withColumn("_reach", F.max("_far").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_after", F.lead(F.struct(F.col(low).alias("start"))).over(w))
    at = at.join(ends, [*equal, "_slice"])
    reach = F.greatest("_reach", "_before")
    earlier = reach.isNotNull() & (reach["open"] | F.col(low).isNull() | (reach["end"] > F.col(low)))
    start = F.when(F.col("_after").isNotNull(), F.col("_after.start")).otherwise(F.col("_next"))
    later = (F.col("_after").isNotNull() | F.col("_next").isNotNull()) & (F.col(high).isNull() | start.isNull() | (start < F.col(high)))
    return at.filter(earlier | later).select(*df.columns)


def differing(df: DataFrame, column: str, equal: Sequence[str]) -> DataFrame:
    """Rows with ``equal`` columns like another row's and another value of ``column`` (an exclusion constraint with = and <>); nulls meet nothing."""
    rows = df
    for c in (*equal, column):
        rows = rows.filter(F.col(c).isNotNull())
    mixed = rows.groupBy(*equal).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi")).filter("_lo <> _hi").select(*equal)
    return rows.join(mixed, list(equal), "left_semi").select(*df.columns)


def verify(df: DataFrame, table: TableDef, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """(constraint, violations): one row for each constraint that is broken."""
    found: list[DataFrame] = []

    def count(name: str, rows: DataFrame) -> None:
        found.append(rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("constraint"), "violations"))

    for c in table.live:
        if not c.nullable or c.name in table.pk:
            count(f"not null {c.name}", not_null(df, c.name))
        if c.check:
            count(f"check {c.name}", check(df, c.check))
        if c.enum:
            count(f"enum {c.name}", df.filter(F.col(c.name).isNotNull() & ~F.col(c.name).isin(list(c.enum))))
        if c.generated:
            count(f"generated {c.name}", df.filter(~F.col(c.name).eqNullSafe(F.expr(c.generated).cast(c.type))))
    if table.pk:
        count("primary key", unique(df, table.pk))
    for i in table.indexes:
        if i.kind == "unique":
            rows = df.filter(F.expr(i.where)) if i.where else df
            keyed = rows.select(*[F.expr(k.expr).alias(f"k{n}") for n, k in enumerate(i.key)])
            count(f"unique {i.name}", unique(keyed, keyed.columns, i.nulls_distinct))
    for text in table.checks:
        count(f"check {text}", check(df, text))
    for fk in table.foreign_keys:
        if parents and fk.parent in parents:
            count(f"foreign key {','.join(fk.columns)}", foreign_key(df, parents[fk.parent], fk))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out.filter("violations > 0")
