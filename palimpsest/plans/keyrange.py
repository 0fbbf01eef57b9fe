"""Predicates on keys as bounds: ranges, lists on several columns, row comparison, ANY and ALL.

Everything becomes plain comparisons of columns with literals, so that filters reach the scan (row groups, pages, bloom filters).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KeyPart


@dataclass(frozen=True)
class KeyRange:
    """Bounds of one key column; None is unbounded.  ``null``: True for IS NULL, False for IS NOT NULL."""

    column: str
    low: Any = None
    high: Any = None
    low_inclusive: bool = True
    high_inclusive: bool = True
    null: bool | None = None

    def predicate(self) -> Column:
        c = F.col(self.column)
        if self.null is True:
            return c.isNull()
        parts = []
        if self.low is not None:
            parts.append(c >= self.low if self.low_inclusive else c > self.low)
        if self.high is not None:
            parts.append(c <= self.high if self.high_inclusive else c < self.high)
        if self.null is False or not parts:
            parts.append(c.isNotNull() if self.null is False else F.lit(True))
        return reduce(and_, parts)

    @staticmethod
    def point(column: str, value: Any) -> KeyRange:
        return KeyRange(column, value, value)


def all_of_ranges(*ranges: KeyRange) -> Column:
    return reduce(and_, [r.predicate() for r in ranges], F.lit(True))


def any_of_ranges(*ranges: KeyRange) -> Column:
    return reduce(or_, [r.predicate() for r in ranges], F.lit(False))


def in_lists(**lists: Sequence[Any]) -> Column:
    """A cross product of lists: each column in its list."""
    return reduce(and_, [F.col(c).isin(list(v)) for c, v in lists.items()])


def row_compare(columns: Sequence[str], op: str, values: Sequence[Any]) -> Column:
    """(a, b, ...) op (x, y, ...) by position with SQL's rules for nulls; not a comparison of structs, which orders nulls."""
    if op not in ("<", "<=", ">", ">="):
        raise ValueError(op)
    strict = op[0]
    out: Column | None = None
    for c, v in reversed(list(zip(columns, values, strict=True))):
        col, value = F.col(c), F.lit(v)
        less = col < value if strict == "<" else col > value
        if out is None:
            out = less if len(op) == 1 else (col <= value if strict == "<" else col >= value)
        else:
            out = less | ((col == value) & out)
    return out


def any_array(column: Column, op: str, values: Sequence[Any]) -> Column:
    """column op ANY(values): for an order, against the least or greatest value."""
    values = list(values)
    if op == "=":
        return column.isin(values)
    return {"<": column < max(values), "<=": column <= max(values), ">": column > min(values), ">=": column >= min(values), "<>": F.lit(len(set(values)) > 1) & column.isNotNull() | (column != values[0])}[op]


def all_array(column: Column, op: str, values: Sequence[Any]) -> Column:
    values = list(values)
    if op == "<>":
        return ~column.isin(values)
    return {"<": column < min(values), "<=": column <= min(values), ">": column > max(values), ">=": column >= max(values), "=": F.lit(len(set(values)) == 1) & (column == values[0])}[op]


def skip_scan(df: DataFrame, trailing: Column) -> DataFrame:
    """The leading key column is free: the trailing predicate alone goes to the scan, whose row groups it prunes."""
    return df.filter(trailing)


def distinct_leading(df: DataFrame, leading: str, trailing: Column) -> DataFrame:
    """Distinct leading values among rows that meet the trailing predicate; combined before the shuffle."""
    return df.filter(trailing).select(leading).distinct()


def ordered(df: DataFrame, *key: KeyPart) -> DataFrame:
    """Range partitions, each sorted: a total order without one task for all rows."""
    return df.orderBy(*[k.order() for k in key])
