"""Changes as DataFrames: each statement turns a snapshot and its input into rows (`_op`, `before`, `after`).

Keys are not null: a row with a null in its key equals none.  Statements on empty tables or with empty input change nothing.

Nothing is written here.  `apply` gives the table after the changes, `returning` the rows a statement returns, and
`sources.commitlog` publishes them as a commit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What a statement says that would touch a row a second time, and one that would give a key a second row.
SECOND_TIME = "cannot affect row a second time"
DUPLICATE_KEY = "duplicate key value violates unique constraint"


class CardinalityError(ValueError):
    """A statement would touch a row a second time, or a key that exists."""


def _once(rows: DataFrame, key: Sequence[str], message: str) -> DataFrame:
    """``rows``; a key that several of them have makes the query fail when it runs."""
    twice = rows.groupBy(*key).agg(F.count("*").alias("_n")).filter("_n > 1")
    return rows.join(twice.select(*key, F.raise_error(F.lit(message)).cast("string").alias("_e")), list(key), "left").filter("_e IS NULL").select(*rows.columns)


def _row(df: DataFrame, columns: Sequence[str], prefix: str = "") -> Column:
    return F.struct(*[df[prefix + c].alias(c) for c in columns])


def _null_row(df: DataFrame) -> Column:
    return F.lit(None).cast(df.schema.simpleString())


def _same(pk: Sequence[str], a: str, b: str) -> Column:
    out = F.col(f"{a}.{pk[0]}") == F.col(f"{b}.{pk[0]}")
    for c in pk[1:]:
        out = out & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return out


def insert(target: DataFrame, rows: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """INSERT.  With ``key``, a row whose key the target or another of the rows has makes the query fail when it runs; without, the commit checks it."""
    if key:
        there = target.join(rows.select(*key).distinct(), list(key), "left_semi").select(*key, F.raise_error(F.lit(DUPLICATE_KEY)).cast("string").alias("_e"))
        rows = _once(rows, key, DUPLICATE_KEY).join(there, list(key), "left").filter("_e IS NULL").select(*rows.columns)
    rows = rows.select(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in target.columns])
    return rows.select(F.lit("I").alias("_op"), _null_row(target).alias("before"), F.struct(*rows.columns).alias("after"))


def upsert_do_nothing(target: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """INSERT ON CONFLICT DO NOTHING: of rows with one key the first by ``order`` is new, if the target has none."""
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), F.struct(*(order or rows.columns))).alias("r")).select("r.*")
    return insert(target, first.join(target.select(*key), list(key), "left_anti"))


def upsert_do_update(target: DataFrame, rows: DataFrame, key: Sequence[str], set_: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    """INSERT ON CONFLICT DO UPDATE.  In ``set_`` and ``where``, ``t.c`` is the row there and ``excluded.c`` the new one.

    Two rows of one key make the query fail when it runs: the second would meet what the first one made.
    """
    rows = _once(rows, key, f"ON CONFLICT DO UPDATE {SECOND_TIME}")
    joined = rows.alias("excluded").join(target.alias("t"), _same(key, "excluded", "t"), "left")
    hit = F.col(f"t.{key[0]}").isNotNull()
    if where is not None:
        joined = joined.filter(~hit | where)
    old = F.struct(*[F.col(f"t.{c}").alias(c) for c in target.columns])
    new = F.struct(*[F.when(hit, set_.get(c, F.col(f"t.{c}"))).otherwise(F.col(f"excluded.{c}") if c in rows.columns else F.lit(None)).cast(target.schema[c].dataType).alias(c) for c in target.columns])
    return joined.select(F.when(hit, "U").otherwise("I").alias("_op"), F.when(hit, old).alias("before"), new.alias("after"))


def update(target: DataFrame, set_: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    hit = target.filter(where) if where is not None else target
    new = F.struct(*[set_.get(c, F.col(c)).cast(target.schema[c].dataType).alias(c) for c in target.columns])
    return hit.select(F.lit("U").alias("_op"), F.struct(*target.columns).alias("before"), new.alias("after"))


def update_from(target: DataFrame, source: DataFrame, on: Column, set_: Mapping[str, Column], pk: Sequence[str]) -> DataFrame:
    """UPDATE t SET ... FROM s WHERE on; a row that several source rows match is changed once, by the least of them."""
    t, s = target.alias("t"), source.alias("s")
    new = F.struct(*[set_.get(c, F.col(f"t.{c}")).cast(target.schema[c].dataType).alias(c) for c in target.columns])
    hits = t.join(s, on).select(F.struct(*[F.col(f"t.{c}").alias(c) for c in target.columns]).alias("before"), new.alias("after"))
    once = hits.groupBy(*[F.col(f"before.{c}").alias(c) for c in pk]).agg(F.min(F.struct("before", "after")).alias("x"))
    return once.select(F.lit("U").alias("_op"), "x.before", "x.after")


def delete(target: DataFrame, where: Column | None = None) -> DataFrame:
    hit = target.filter(where) if where is not None else target
    return hit.select(F.lit("D").alias("_op"), F.struct(*target.columns).alias("before"), _null_row(target).alias("after"))


def delete_using(target: DataFrame, source: DataFrame, on: Column) -> DataFrame:
    """DELETE FROM t USING s WHERE on: a semi join, so a row that many source rows match goes once."""
    return delete(target.alias("t").join(source.alias("s"), on, "left_semi"))


def merge(
    target: DataFrame,
    source: DataFrame,
    key: Sequence[str],
    matched_update: Mapping[str, Column] | None = None,
    matched_delete: Column | None = None,
    not_matched_insert: bool = True,
    checked: bool = True,
) -> DataFrame:
    """MERGE INTO t USING s on equal keys.  ``matched_delete`` comes first; ``t.c`` and ``s.c`` name columns.

    ``checked``: a source with two rows of one key makes the query fail when it runs, as one row can't be touched twice.
    """
    if checked:
        source = _once(source, key, f"MERGE {SECOND_TIME}")
    joined = source.alias("s").join(target.alias("t"), _same(key, "s", "t"), "left")
    hit = F.col(f"t.{key[0]}").isNotNull()
    op = F.when(hit & (matched_delete if matched_delete is not None else F.lit(False)), "D").when(hit & F.lit(matched_update is not None), "U").when(~hit & F.lit(not_matched_insert), "I")
    old = F.struct(*[F.col(f"t.{c}").alias(c) for c in target.columns])
    sets = matched_update or {}
    new = F.struct(*[F.when(hit, sets.get(c, F.col(f"t.{c}"))).otherwise(F.col(f"s.{c}") if c in source.columns else F.lit(None)).cast(target.schema[c].dataType).alias(c) for c in target.columns])
    return joined.select(op.alias("_op"), F.when(hit, old).alias("before"), new.alias("after")).filter("_op IS NOT NULL").withColumn("after", F.when(F.col("_op") != "D", F.col("after")))


def apply(target: DataFrame, changes: DataFrame, pk: Sequence[str]) -> DataFrame:
    """The table after the changes: rows not touched, and what the others became.  A changed key is a delete and an insert."""
    touched = changes.filter("before IS NOT NULL").select(*[F.col(f"before.{c}").alias(c) for c in pk])
    return target.join(touched, list(pk), "left_anti").select(*target.columns).unionByName(changes.filter("after IS NOT NULL").select("after.*"))


def together(*changes: DataFrame) -> DataFrame:
    """The data-changing statements of one WITH: all see the snapshot that they were made from, and none what another one does."""
    return reduce(DataFrame.unionByName, changes)


def returning(changes: DataFrame, *columns: str) -> DataFrame:
    """RETURNING: a statement's rows after it, or before it where it deletes them."""
    rows = changes.select("_op", F.coalesce("after", "before").alias("r")).select("_op", "r.*")
    return rows.select(*columns) if columns else rows.drop("_op")


def log_rows(changes: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Rows for the log: key and payload with `_op`, the old row, and `_moved` for both halves of a changed key."""
    moved = F.lit(False)
    for c in pk:
        moved = moved | (F.col("before")[c] != F.col("after")[c])
    both = changes.withColumn("_moved", F.coalesce((F.col("_op") == "U") & moved, F.lit(False)))
    stays = both.filter("NOT _moved").select(F.coalesce("after", "before").alias("r"), "_op", "before", "_moved")
    out = both.filter("_moved").select(F.col("before").alias("r"), F.lit("D").alias("_op"), "before", "_moved")
    back = both.filter("_moved").select(F.col("after").alias("r"), F.lit("I").alias("_op"), "before", "_moved")
    rows = stays.union(out).union(back)
    return rows.select("r.*", "_op", F.col("before").alias("_old"), "_moved")
