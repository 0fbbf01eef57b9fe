"""Copies of a table in the order of an index: built, read by key range, compared with the table, rebuilt and dropped.

A copy holds the key's values, the covered columns and the primary key, sorted by the key in ranges of it, so a scan by key range
reads the row groups whose statistics meet the range, and a covered query reads nothing else.  Rows outside a partial index's predicate
are not in it.  An index over an empty table is an empty copy; null keys are in it, in the place that the key part gives them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import IndexDef
from ..operators import introspect
from .commitlog import _Files


class IndexCopy:
    def __init__(self, spark: SparkSession, path: str, index: IndexDef, pk: Sequence[str]):
        self.spark, self.path, self.index, self.pk = spark, path.rstrip("/"), index, list(pk)
        self.files = _Files(spark, self.path)

    def rows(self, table: DataFrame) -> DataFrame:
        """What the index has of a table: key_0, key_1, ..., the covered columns and the primary key."""
        if self.index.where:
            table = table.filter(self.index.where)
        rest = dict.fromkeys([*self.index.include, *self.pk])
        return table.select(*[F.expr(k.expr).alias(f"key_{i}") for i, k in enumerate(self.index.key)], *rest)

    def _order(self) -> list[Column]:
        parts = []
        for i, k in enumerate(self.index.key):
            first, c = k.desc if k.nulls_first is None else k.nulls_first, F.col(f"key_{i}")
            parts.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if k.desc else (c.asc_nulls_first() if first else c.asc_nulls_last()))
        return [*parts, *(F.col(c) for c in self.pk)]

    def build(self, table: DataFrame) -> None:
        """Writes a copy and then makes it the one that is read; a reader meanwhile sees the one before, whole."""
        to = f"{self.path}/{uuid.uuid4().hex}"
        self.rows(table).repartitionByRange(*self._order()).sortWithinPartitions(*self._order()).write.parquet(to)
        built = self._built()
        number = int(built[-1][0].partition(".")[0]) + 1 if built else 1
        if not self.files.create(f"{self.path}/{number:08d}.current", to):
            self.files.delete(to)
            raise ValueError(f"index {self.index.name} was built by another one meanwhile")
        for name, old in built:
            self.files.delete(f"{self.path}/{name}")
            self.files.delete(old)

    def _built(self) -> list[tuple[str, str]]:
        return [(n, self.files.read(f"{self.path}/{n}")) for n in sorted(self.files.names(self.path)) if n.endswith(".current")]

    def read(self) -> DataFrame:
        built = self._built()
        if not built:
            raise ValueError(f"index {self.index.name} is not built")
        return self.spark.read.parquet(built[-1][1])

    def scan(self, where: Column | None = None) -> DataFrame:
        """Rows of the copy in its order; ``where`` names keys as key_0, key_1, ... and reaches the files."""
        found = self.read().filter(where) if where is not None else self.read()
        return found.orderBy(*self._order())

    def fetch(self, table: DataFrame, where: Column) -> DataFrame:
        """Rows of the table whose keys satisfy ``where``, by the primary keys that the copy gives."""
        return table.join(self.read().filter(where).select(*self.pk), self.pk, "left_semi")

    def agrees(self, table: DataFrame) -> bool:
        """Whether the copy is what the table would give now."""
        return introspect.same_rows(self.read(), self.rows(table))

    def drop(self) -> None:
        self.files.delete(self.path)
