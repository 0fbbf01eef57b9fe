"""Files in and out: COPY, cursors over results, tables made from queries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession

from ..model import TableDef
from .commitlog import _Files


def copy_from(spark: SparkSession, path: str, table: TableDef, format: str = "csv", delimiter: str = ",", null: str = "", header: bool = False) -> DataFrame:
    """Rows of files as the table's columns; a value that doesn't fit its type fails the read, as COPY does."""
    if format != "csv":
        return table.complete(spark.read.format(format).load(path))
    written = [c for c in table.live if c.generated is None]
    schema = ", ".join(f"`{c.name}` {c.type}" for c in written)
    rows = spark.read.options(sep=delimiter, nullValue=null, header=header, mode="FAILFAST").schema(schema).csv(path)
    return table.complete(rows)


def copy_to(df: DataFrame, path: str, format: str = "csv", delimiter: str = ",", null: str = "", header: bool = False, compression: str | None = None) -> None:
    """One file a partition; nothing passes through the driver."""
    writer = df.write.format(format)
    if format == "csv":
        writer = writer.options(sep=delimiter, nullValue=null, header=header)
    (writer.option("compression", compression) if compression else writer).save(path)


def cursor(df: DataFrame, fetch: int = 1000) -> Iterator[list[Row]]:
    """Blocks of rows in order, a partition at a time on the driver, never all of them."""
    block: list[Row] = []
    for row in df.toLocalIterator(prefetchPartitions=False):
        block.append(row)
        if len(block) == fetch:
            yield block
            block = []
    if block:
        yield block


class Policies:
    """Row security: a row is seen if some permissive policy and all restrictive ones allow it; without any, none is."""

    def __init__(self) -> None:
        self.permissive: list[Column] = []
        self.restrictive: list[Column] = []

    def allow(self, where: Column) -> Policies:
        self.permissive.append(where)
        return self

    def restrict(self, where: Column) -> Policies:
        self.restrictive.append(where)
        return self

    def view(self, df: DataFrame) -> DataFrame:
        from functools import reduce
        from operator import and_, or_

        from pyspark.sql import functions as F

        seen = reduce(or_, self.permissive, F.lit(False))
        return df.filter(reduce(and_, self.restrictive, seen))


class MaterializedView:
    """A query's rows kept as files; a refresh writes new ones and then points at them, so readers see one or the other whole."""

    def __init__(self, spark: SparkSession, path: str, query: Callable[[], DataFrame]):
        self.spark, self.path, self.query = spark, path.rstrip("/"), query
        self.files = _Files(spark, self.path)

    def _versions(self) -> list[int]:
        return sorted(int(n) for n in self.files.names(f"{self.path}/ready"))

    def refresh(self) -> None:
        number = time.time_ns()
        self.query().write.parquet(f"{self.path}/rows/{number}")
        self.files.create(f"{self.path}/ready/{number}", "")
        for old in self._versions()[:-2]:
            self.files.delete(f"{self.path}/ready/{old}")
            self.files.delete(f"{self.path}/rows/{old}")

    def read(self) -> DataFrame:
        ready = self._versions()
        if not ready:
            raise ValueError("the view has no rows yet; refresh it first")
        return self.spark.read.parquet(f"{self.path}/rows/{ready[-1]}")
