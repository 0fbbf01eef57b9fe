"""Triggers: functions over the changes of a statement, before they are applied and after."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Change = Callable[[DataFrame], DataFrame]


class Triggers:
    """Row triggers in the order they were made.  A statement without changes fires none of them on any row."""

    def __init__(self) -> None:
        self.first: list[tuple[str, Callable[[Column, Column], Column], Column | None]] = []
        self.then: list[tuple[str, Change]] = []

    def before(self, ops: str, row: Callable[[Column, Column], Column], when: Column | None = None) -> Triggers:
        """``row(before, after)`` gives the row that is written instead; null leaves the change out.  ``ops``: letters of I, U, D."""
        self.first.append((ops, row, when))
        return self

    def after(self, ops: str, statement: Change) -> Triggers:
        """``statement`` gets the changes made, and gives rows for another table, such as an audit."""
        self.then.append((ops, statement))
        return self

    def fire(self, changes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """(the changes as the triggers leave them, what each after trigger gives)."""
        for ops, row, when in self.first:
            hit = F.col("_op").isin(list(ops)) & (when if when is not None else F.lit(True))
            out = row(F.col("before"), F.col("after"))
            side = F.when(F.col("_op") == "D", F.col("before")).otherwise(F.col("after"))
            # Of a delete, the row that stays is the old one: the trigger can only let it go or keep it.
            changes = changes.withColumn("_row", F.when(hit, out).otherwise(side)).filter("_row IS NOT NULL")
            changes = changes.withColumn("after", F.when(F.col("_op") != "D", F.col("_row"))).drop("_row")
        return changes, [f(changes.filter(F.col("_op").isin(list(ops)))) for ops, f in self.then]


def audit(changes: DataFrame, pk: Sequence[str], column: str) -> DataFrame:
    """(_op, pk, old, new) of a column: what an audit table gets."""
    side = F.coalesce("after", "before")
    return changes.select("_op", *[side[c].alias(c) for c in pk], F.col("before")[column].alias("old"), F.col("after")[column].alias("new"))
