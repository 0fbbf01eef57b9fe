"""Declared tables: columns, keys, indexes and constraints, and versions of a schema."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnDef:
    """``missing``: what rows written before the column came have there; ``generated``: SQL of a stored generated column.

    ``number``: what files know the column by, whatever it is called; given by the table.
    """

    name: str
    type: str
    nullable: bool = True
    default: Any = None
    missing: Any = None
    generated: str | None = None
    enum: tuple[str, ...] = ()
    check: str | None = None
    since: int = 1
    dropped: int | None = None
    number: int = 0


@dataclass(frozen=True)
class KeyPart:
    """A key column or expression with its direction and its place for nulls (default: last ascending, first descending)."""

    expr: str
    desc: bool = False
    nulls_first: bool | None = None

    def order(self) -> Column:
        first = self.desc if self.nulls_first is None else self.nulls_first
        c = F.expr(self.expr)
        return (c.desc_nulls_first() if first else c.desc_nulls_last()) if self.desc else (c.asc_nulls_first() if first else c.asc_nulls_last())


@dataclass(frozen=True)
class IndexDef:
    """kind: primary, unique, regular or exclusion; an index is an order, a predicate and a covering projection, not a copy."""

    name: str
    key: tuple[KeyPart, ...]
    kind: str = "regular"
    include: tuple[str, ...] = ()
    where: str | None = None
    nulls_distinct: bool = True


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_update_cascade: bool = False


@dataclass(frozen=True)
class TableDef:
    """A table's definition; immutable, every change gives the next version."""

    name: str
    columns: tuple[ColumnDef, ...]
    pk: tuple[str, ...] = ()
    indexes: tuple[IndexDef, ...] = ()
    checks: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    options: Mapping[str, str] = field(default_factory=dict)
    version: int = 1

    def __post_init__(self) -> None:
        top = max((c.number for c in self.columns), default=0)
        numbered = []
        for c in self.columns:
            top += c.number == 0
            numbered.append(c if c.number else replace(c, number=top))
        object.__setattr__(self, "columns", tuple(numbered))

    @property
    def live(self) -> tuple[ColumnDef, ...]:
        return tuple(c for c in self.columns if c.dropped is None)

    def schema(self) -> T.StructType:
        out = T.StructType()
        for c in self.live:
            out = out.add(T.StructField(c.name, T._parse_datatype_string(c.type), c.nullable, {"enum": list(c.enum)} if c.enum else {}))
        return out

    # Evolution.

    def add_column(self, column: ColumnDef) -> TableDef:
        """Rows written before read ``column.missing``; a null written later stays null."""
        self._free(column.name)
        return replace(self, columns=(*self.columns, replace(column, since=self.version + 1)), version=self.version + 1)

    def drop_column(self, name: str) -> TableDef:
        if name in self.pk:
            raise ValueError(f"{name} is in the primary key")
        used = [i.name for i in self.indexes if name in i.include or any(name == k.expr for k in i.key)]
        if used:
            raise ValueError(f"indexes {used} need {name}")
        return self._change(name, {"dropped": self.version + 1})

    def alter_type(self, name: str, type_: str) -> TableDef:
        """Rows written before are cast when they are read."""
        return self._change(name, {"type": type_})

    def rename_column(self, old: str, new: str) -> TableDef:
        """Keys, indexes, checks, generated columns and foreign keys follow the name."""
        self._free(new)
        word = re.compile(rf"(?<![\w.`]){re.escape(old)}(?!\w)")
        text = lambda x: x if x is None else word.sub(new, x)
        names = lambda x: tuple(new if c == old else c for c in x)
        out = self._change(old, {"name": new})
        return replace(
            out,
            pk=names(self.pk),
            columns=tuple(replace(c, check=text(c.check), generated=text(c.generated)) for c in out.columns),
            indexes=tuple(replace(i, key=tuple(replace(k, expr=text(k.expr)) for k in i.key), include=names(i.include), where=text(i.where)) for i in self.indexes),
            checks=tuple(text(c) for c in self.checks),
            foreign_keys=tuple(replace(f, columns=names(f.columns)) for f in self.foreign_keys),
        )

    def create_index(self, index: IndexDef) -> TableDef:
        if any(i.name == index.name for i in self.indexes):
            raise ValueError(f"index {index.name} exists")
        return replace(self, indexes=(*self.indexes, index), version=self.version + 1)

    def drop_index(self, name: str) -> TableDef:
        return replace(self, indexes=tuple(i for i in self.indexes if i.name != name), version=self.version + 1)

    def set_primary_key(self, *columns: str) -> TableDef:
        """No columns: rows have a surrogate identity only."""
        return replace(self, pk=columns, version=self.version + 1)

    def _free(self, name: str) -> None:
        if any(c.name == name for c in self.live):
            raise ValueError(f"column {name} exists")

    def _change(self, name: str, what: Mapping[str, Any]) -> TableDef:
        if not any(c.name == name for c in self.live):
            raise ValueError(f"no column {name}")
        return replace(self, columns=tuple(replace(c, **what) if c.name == name and c.dropped is None else c for c in self.columns), version=self.version + 1)

    # Rows.

    def read_as(self, df: DataFrame, written_version: Column | int) -> DataFrame:
        """``df`` as rows of this version: columns added since get their missing value where the row is older, types are cast."""
        v = F.lit(written_version) if isinstance(written_version, int) else written_version
        out = []
        for c in self.live:
            value = F.col(c.name) if c.name in df.columns else F.lit(None)
            out.append(F.when(v < c.since, F.lit(c.missing)).otherwise(value).cast(c.type).alias(c.name))
        return df.select(*out)

    def complete(self, df: DataFrame) -> DataFrame:
        """``df`` with defaults for columns it lacks and generated columns computed, in the table's order."""
        for c in self.live:
            if c.generated is None and c.name not in df.columns:
                df = df.withColumn(c.name, F.lit(c.default).cast(c.type))
        for c in self.live:
            if c.generated is not None:
                df = df.withColumn(c.name, F.expr(c.generated).cast(c.type))
        return df.select(*[F.col(c.name).cast(c.type).alias(c.name) for c in self.live])

    def description(self, spark) -> DataFrame:
        """One row a column: (table_name, position, column_name, type, nullable, in_pk)."""
        rows = [(self.name, i + 1, c.name, c.type, c.nullable, c.name in self.pk) for i, c in enumerate(self.live)]
        return spark.createDataFrame(rows, "table_name string, position int, column_name string, type string, nullable boolean, in_pk boolean")

    def index_description(self, spark) -> DataFrame:
        rows = [(self.name, i.name, i.kind, ", ".join(k.expr + (" DESC" if k.desc else "") for k in i.key), ", ".join(i.include), i.where) for i in self.all_indexes()]
        return spark.createDataFrame(rows, "table_name string, index_name string, kind string, key string, include string, predicate string")

    def all_indexes(self) -> tuple[IndexDef, ...]:
        primary = (IndexDef(f"{self.name}_pkey", tuple(KeyPart(c) for c in self.pk), "primary"),) if self.pk else ()
        return primary + self.indexes


def by_name(tables: Sequence[TableDef]) -> Callable[[str], TableDef]:
    return {t.name: t for t in tables}.__getitem__
