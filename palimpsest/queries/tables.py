"""Whole tables through the commit log: shifted keys, refused statements, changed schemas, truncation, streams, index copies, triggers, introspection."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ColumnDef, IndexDef, KeyPart, TableDef
from ..operators import constraints, dml, introspect, triggers, versions
from ..session import shared_dir
from ..sources.commitlog import VersionedTable
from ..sources.indexes import IndexCopy
from ..streaming import cdc
from .changes import PK, orders
from .registry import query

ORDERS = TableDef("orders", (ColumnDef("o_orderkey", "bigint", nullable=False), ColumnDef("o_custkey", "bigint"), ColumnDef("o_totalprice", "double"), ColumnDef("o_orderstatus", "string")), ("o_orderkey",))
_O = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM {orders}"


def folder(spark) -> str:
    return f"{shared_dir(spark)}/core-{uuid.uuid4().hex}"


def filled(t) -> VersionedTable:
    """A table on disk with all orders as its first commit."""
    rows = orders(t)
    table = VersionedTable(rows.sparkSession, folder(rows.sparkSession), ORDERS)
    table.commit(dml.insert(rows, rows))
    return table


@query("dml_update_pk_shift", "SELECT o_orderkey + 1 AS o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM {orders}")
def _(t):
    """Every new key but one is the old key of another row."""
    table = filled(t)
    table.commit(dml.update(table.snapshot(), {"o_orderkey": F.col("o_orderkey") + 1}))
    return table.snapshot()


def refused(table: VersionedTable, changes) -> DataFrame:
    """(message, rows): what a statement says that fails, and the rows that the table has after it."""
    message = "none"
    try:
        table.commit(changes())
    except dml.CardinalityError as e:
        message = str(e)
    return table.snapshot().agg(F.count("*").alias("rows")).select(F.lit(message).alias("message"), "rows")


@query("insert_duplicate_key", "SELECT 'duplicate key value violates unique constraint' AS message, count(*) AS rows FROM {orders}")
def _(t):
    table = filled(t)
    return refused(table, lambda: dml.insert(table.snapshot(), orders(t).withColumn("o_orderstatus", F.lit("X"))))


@query("upsert_repeated_source", "SELECT 'ON CONFLICT DO UPDATE cannot affect row a second time' AS message, count(*) AS rows FROM {orders}")
def _(t):
    table = filled(t)
    twice = orders(t).union(orders(t).withColumn("o_totalprice", F.col("o_totalprice") + 1))
    return refused(table, lambda: dml.upsert_do_update(table.snapshot(), twice, PK, {"o_totalprice": F.col("excluded.o_totalprice")}))


@query("cdc_stream_commits", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM {orders} WHERE o_orderstatus <> 'P'")
def _(t):
    """A replica that follows a table commit by commit; files that no commit publishes never reach it."""
    table = filled(t)
    spark, out = table.spark, folder(table.spark)

    def follow() -> None:
        q = cdc.replicate(table, f"{out}/progress", lambda df, n: df.drop("_old").write.parquet(f"{out}/changes/batch={n}")).start()
        q.awaitTermination()

    follow()
    table._write(table._stored(dml.log_rows(dml.delete(table.snapshot()), PK).withColumn("_cid", F.lit(0))), 2)
    table.commit(dml.update(table.snapshot(), {"o_totalprice": F.col("o_totalprice") + 1}, F.col("o_orderstatus") == "F"))
    follow()
    table.commit(dml.delete(table.snapshot(), F.col("o_orderstatus") == "P"))
    follow()
    return versions.latest(spark.read.parquet(f"{out}/changes").drop("batch"), PK).select(*ORDERS.schema().names)


@query("alter_rename", "SELECT o_orderkey AS id, o_custkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS price, o_orderstatus FROM {orders}")
def _(t):
    table = filled(t)
    table.alter(lambda d: d.rename_column("o_totalprice", "price").rename_column("o_orderkey", "id"))
    table.commit(dml.update(table.snapshot(), {"price": F.col("price") + 1}, F.col("o_orderstatus") == "F"))
    return table.snapshot()


@query("alter_type", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'c' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS o_custkey, o_totalprice, o_orderstatus FROM {orders}")
def _(t):
    """Rows of both types: those before the change are cast, those after were written in the new one."""
    table = filled(t)
    table.alter(lambda d: d.alter_type("o_custkey", "string"))
    table.commit(dml.update(table.snapshot(), {"o_custkey": F.concat(F.lit("c"), F.col("o_custkey"))}, F.col("o_orderstatus") == "F"))
    return table.snapshot()


@query("truncate", f"{_O} WHERE o_orderstatus = 'F'")
def _(t):
    table = filled(t)
    table.truncate()
    table.commit(dml.insert(table.snapshot(), orders(t).filter("o_orderstatus = 'F'")))
    return table.snapshot()


@query("truncate_before", _O)
def _(t):
    """The snapshot before a truncation still has every row."""
    table = filled(t)
    return table.snapshot(table.truncate())


@query("writable_cte", """
SELECT 'updated' AS what, count(*) AS n, CAST(round(sum(o_totalprice * 2), 2) AS DOUBLE) AS total FROM {orders} WHERE o_orderstatus = 'F' UNION ALL
SELECT 'deleted', count(*), CAST(round(sum(o_totalprice), 2) AS DOUBLE) FROM {orders} WHERE o_orderstatus = 'P' UNION ALL
SELECT 'left', count(*), CAST(round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END), 2) AS DOUBLE) FROM {orders} WHERE o_orderstatus <> 'P'""")
def _(t):
    """WITH u AS (UPDATE ... RETURNING), d AS (DELETE ... RETURNING) SELECT aggregates of both: one snapshot, one commit."""
    table = filled(t)
    at = table.snapshot()
    u, d = dml.update(at, {"o_totalprice": F.col("o_totalprice") * 2}, F.col("o_orderstatus") == "F"), dml.delete(at, F.col("o_orderstatus") == "P")
    table.commit(dml.together(u, d))

    def summed(what: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).select(F.lit(what).alias("what"), "n", "total")

    return summed("updated", dml.returning(u)).union(summed("deleted", dml.returning(d))).union(summed("left", table.snapshot()))


@query("trigger_audit", """
SELECT 'U' AS op, o_orderkey, o_totalprice AS old, least(o_totalprice * 2, 400000.0) AS new FROM {orders} WHERE o_orderstatus = 'F'
UNION ALL SELECT 'D', o_orderkey, o_totalprice, NULL FROM {orders} WHERE o_orderstatus = 'P' AND o_totalprice < 300000""")
def _(t):
    """A trigger that caps a price before it is written, one that keeps some rows from being deleted, and an audit after."""
    capped = lambda old, new: new.withField("o_totalprice", F.least(new["o_totalprice"], F.lit(400000.0)))
    some = lambda old, new: F.when(old["o_totalprice"] < 300000, old)
    set_ = triggers.Triggers().before("U", capped).before("D", some).after("UD", lambda c: triggers.audit(c, PK, "o_totalprice"))
    at = orders(t)
    changes = dml.together(dml.update(at, {"o_totalprice": F.col("o_totalprice") * 2}, F.col("o_orderstatus") == "F"), dml.delete(at, F.col("o_orderstatus") == "P"))
    return set_.fire(changes)[1][0].withColumnRenamed("_op", "op")


BY_PRICE = IndexDef("by_price", (KeyPart("o_totalprice", desc=True),), include=("o_custkey",), where="o_orderstatus <> 'P'")


@query("index_build_scan", "SELECT o_totalprice AS key_0, o_custkey, o_orderkey FROM {orders} WHERE o_orderstatus <> 'P' AND o_totalprice BETWEEN 100000 AND 150000")
def _(t):
    """A covered scan by key range of a partial index's copy."""
    at = orders(t)
    copy = IndexCopy(at.sparkSession, folder(at.sparkSession), BY_PRICE, PK)
    copy.build(at)
    return copy.scan(F.col("key_0").between(100000, 150000))


@query("index_rebuild", "SELECT true AS agrees, false AS before, count(*) AS n FROM {orders} WHERE o_orderstatus <> 'P'")
def _(t):
    """After an update the copy is out of date; built again, it agrees with the table."""
    at = orders(t)
    copy = IndexCopy(at.sparkSession, folder(at.sparkSession), BY_PRICE, PK)
    copy.build(at)
    later = dml.apply(at, dml.update(at, {"o_totalprice": F.col("o_totalprice") + 1}), PK)
    before = copy.agrees(later)
    copy.build(later)
    return copy.read().agg(F.count("*").alias("n")).select(F.lit(copy.agrees(later)).alias("agrees"), F.lit(before).alias("before"), "n")


@query("constraint_exclude_differing", "SELECT o_orderkey, o_custkey, o_orderpriority FROM {orders} WHERE o_custkey IN (SELECT o_custkey FROM {orders} GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1)")
def _(t):
    return constraints.differing(t("orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderpriority", ["o_custkey"])


@query("table_pages", "SELECT count(*) AS rows, min(o_orderkey) AS low, max(o_orderkey) AS high FROM {orders}")
def _(t):
    """The splits of a table's files and their key ranges, summed up; how many there are is up to the files."""
    p = introspect.pages(t("orders"), "o_orderkey")
    return p.agg(F.sum("rows").alias("rows"), F.min("low_o_orderkey").alias("low"), F.max("high_o_orderkey").alias("high"))


@query("catalog_views", "SELECT * FROM (VALUES ('orders', 'orders_pkey', 'primary', 4, 2), ('orders', 'by_price', 'regular', 4, 2)) AS v(table_name, index_name, kind, columns, indexes)")
def _(t):
    spark, d = t("orders").sparkSession, ORDERS.create_index(BY_PRICE)
    return introspect.indexes(spark, [d]).join(introspect.tables(spark, [d]).select("table_name", "columns", "indexes"), "table_name").select("table_name", "index_name", "kind", "columns", "indexes")


@query("explain_scan", "SELECT true AS scans, true AS pushed, false AS shuffles")
def _(t):
    """What EXPLAIN says of a key lookup: a scan with the key pushed down and no shuffle."""
    text = introspect.plan(t("orders").filter("o_orderkey = 7").select("o_orderkey"))
    has = lambda x: F.coalesce(F.bool_or(F.contains("text", F.lit(x))), F.lit(False))
    return text.agg(has("Scan parquet").alias("scans"), has("EqualTo(o_orderkey,7)").alias("pushed"), has("Exchange").alias("shuffles"))


@F.pandas_udf(T.LongType())
def collatz_step(n: pd.Series) -> pd.Series:
    """A scalar function over Arrow batches."""
    return n.where(n % 2 == 1, n // 2).where(n % 2 == 0, 3 * n + 1)


@query("udf_scalar", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey // 2 ELSE 3 * o_orderkey + 1 END AS step FROM {orders}")
def _(t):
    return t("orders").select("o_orderkey", collatz_step("o_orderkey").alias("step"))


@F.pandas_udf(T.DoubleType())
def spread(x: pd.Series) -> float:
    """An aggregate function: the range of a group's values."""
    return float(x.max() - x.min())


@query("udaf_pandas", "SELECT c_nationkey, max(c_acctbal) - min(c_acctbal) AS spread FROM {customer} GROUP BY c_nationkey")
def _(t):
    return t("customer").groupBy("c_nationkey").agg(spread("c_acctbal").alias("spread"))
