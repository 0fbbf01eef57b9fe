"""Ways into a table: by key, by several keys, by sets of keys, in key order."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import IndexDef, KeyPart

#: Keys of a list up to which they go into the filter itself, and so to the scan.
IN_FILTER = 1000


def scan(df: DataFrame, *columns: str, where: Column | None = None) -> DataFrame:
    """Sequential scan; columns and filter are pushed into the files."""
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def lookup(df: DataFrame, **key: Any) -> DataFrame:
    """Rows of one key."""
    for c, v in key.items():
        df = df.filter(F.col(c).isNull() if v is None else F.col(c) == v)
    return df


def multi_lookup(df: DataFrame, column: str, keys: Sequence[Any] | DataFrame) -> DataFrame:
    """Rows of many keys: a short list becomes a filter; a table of keys is joined, as large as it is."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_semi").select(*df.columns)
    if len(keys) <= IN_FILTER:
        return df.filter(F.col(column).isin(list(keys)))
    spark = df.sparkSession
    return multi_lookup(df, column, spark.createDataFrame([(k,) for k in keys], f"`{column}` {df.schema[column].dataType.simpleString()}"))


def index_scan(df: DataFrame, index: IndexDef, where: Column | None = None, limit: int | None = None, pk: Sequence[str] = (), only: bool = False) -> DataFrame:
    """Rows in the index's order.  ``only``: its key, included and primary key columns and no others (an index-only scan).

    A limit becomes a top-k that keeps k rows a task; without one, rows are range-partitioned and sorted.
    """
    if index.where:
        df = df.filter(F.expr(index.where))
    if where is not None:
        df = df.filter(where)
    ties = [KeyPart(c) for c in pk if all(c != k.expr for k in index.key)]
    out = df.orderBy(*[k.order() for k in (*index.key, *ties)])
    if limit is not None:
        out = out.limit(limit)
    if only:
        names = dict.fromkeys([*(k.expr for k in index.key), *index.include, *pk])
        out = out.select(*[n for n in names if n in df.columns])
    return out


class KeySet:
    """A set of primary keys, as bitmap scans make them: made by a predicate, intersected, united, and used to fetch rows.

    Predicates over one table stay one filter as long as they can; a set that comes from elsewhere is a join.
    """

    def __init__(self, table: DataFrame, pk: Sequence[str], where: Column | None = None, keys: DataFrame | None = None):
        self.table, self.pk, self.where, self.own = table, list(pk), where, keys

    @property
    def keys(self) -> DataFrame:
        return self.own if self.own is not None else self.table.filter(self.where).select(*self.pk)

    def _with(self, other: KeySet, both: Column | None, keys) -> KeySet:
        if self.where is not None and other.where is not None and self.table is other.table:
            return KeySet(self.table, self.pk, both)
        return KeySet(self.table, self.pk, keys=keys())

    def __and__(self, other: KeySet) -> KeySet:
        return self._with(other, self.where & other.where if self.where is not None and other.where is not None else None, lambda: self.keys.intersect(other.keys))

    def __or__(self, other: KeySet) -> KeySet:
        return self._with(other, self.where | other.where if self.where is not None and other.where is not None else None, lambda: self.keys.union(other.keys).distinct())

    def fetch(self, recheck: Column | None = None) -> DataFrame:
        """The rows of the keys; ``recheck`` is applied to them."""
        out = self.table.filter(self.where) if self.where is not None else self.table.join(self.own, self.pk, "left_semi")
        return out.filter(recheck) if recheck is not None else out
