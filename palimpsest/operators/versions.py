"""Versions of rows over an append-only log of changes: snapshots, history, rewind, horizon, savepoints.

A log has the key and payload columns and `_op` (I, U or D), `_csn` (commit), `_cid` (command within it) and `_ts` (commit time).
A snapshot sees the commits before its csn, and its own commands before its cid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

META = ("_op", "_csn", "_cid", "_ts")


def payload(log: DataFrame) -> list[str]:
    return [c for c in log.columns if c not in META and not c.startswith("_")]


def order() -> list[Column]:
    """The order of a key's changes.  A command that moves keys takes a key from one row and gives it to another: the old row's end comes first."""
    return [F.col("_csn"), F.col("_cid"), F.col("_op") != "D"]


def place() -> Column:
    """Where a change stands among those of its key, as one value."""
    return F.struct(F.col("_csn"), F.col("_cid"), (F.col("_op") != "D").alias("_comes"))


def visible(csn: int, own_csn: int | None = None, cid: int | None = None) -> Column:
    """Committed before ``csn``, or the own transaction's commands before ``cid``."""
    out = F.col("_csn") < csn
    if own_csn is not None:
        out = out | ((F.col("_csn") == own_csn) & (F.col("_cid") < cid))
    return out


def latest(log: DataFrame, pk: Sequence[str], deleted: bool = False) -> DataFrame:
    """The last version of each key.  One aggregate with partial combination before the shuffle: no sort, no window."""
    rest = [c for c in log.columns if c not in pk]
    last = log.groupBy(*pk).agg(F.max_by(F.struct(*rest), place()).alias("_v"))
    out = last.select(*pk, *[F.col(f"_v.{c}").alias(c) for c in rest])
    return (out if deleted else out.filter("_op <> 'D'")).select(*log.columns)


def snapshot(log: DataFrame, pk: Sequence[str], csn: int, own_csn: int | None = None, cid: int | None = None) -> DataFrame:
    """Rows as of ``csn``.  The filter on the commit prunes the log's files."""
    return latest(log.filter(visible(csn, own_csn, cid)), pk).select(*payload(log))


def as_of(log: DataFrame, pk: Sequence[str], ts: Column) -> DataFrame:
    """Rows as commits up to and with time ``ts`` left them."""
    return latest(log.filter(F.col("_ts") <= ts), pk).select(*payload(log))


def history(log: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Each version with the commit that ended it (`_csn_to`, null for the current one)."""
    w = Window.partitionBy(*pk).orderBy(*order())
    return log.withColumn("_csn_from", F.col("_csn")).withColumn("_csn_to", F.lead("_csn").over(w))


def rewind(log: DataFrame, pk: Sequence[str], csn: int, new_csn: int) -> DataFrame:
    """The changes that bring the state before ``csn`` back as commit ``new_csn``: only keys touched since are among them.

    The join is no semi join, as Spark pushes those below a log's unions and then, where they are sort-merge joins, takes the union for dealt
    by key and fails ("Can't zip RDDs with unequal numbers of partitions").
    """
    touched = log.filter(F.col("_csn") >= csn).select(*pk).distinct()
    names = payload(log)
    old = F.col("_csn") < csn
    last = log.join(touched, list(pk)).groupBy(*pk).agg(F.max_by(F.struct("_op", *[c for c in names if c not in pk]), F.when(old, place())).alias("_v"))
    there = F.coalesce(F.col("_v._op") != "D", F.lit(False))
    rows = [F.col(c) if c in pk else F.when(there, F.col(f"_v.{c}")).alias(c) for c in names]
    return last.select(*rows, F.when(there, "U").otherwise("D").alias("_op"), F.lit(new_csn).cast("long").alias("_csn"), F.lit(0).alias("_cid"))


def horizon(log: DataFrame, pk: Sequence[str], oldest: int) -> DataFrame:
    """The log without versions that no snapshot from ``oldest`` on can see: of what is before it, the last version of a key stays, and if that is a delete, none."""
    old = latest(log.filter(F.col("_csn") < oldest), pk)
    return old.unionByName(log.filter(F.col("_csn") >= oldest))


def rollback_to(log: DataFrame, csn: int, savepoint: int) -> DataFrame:
    """Drops the commands of transaction ``csn`` from ``savepoint`` on."""
    return log.filter(~((F.col("_csn") == csn) & (F.col("_cid") >= savepoint)))
