"""DML, constraints, versions, change feeds and event windows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ColumnDef, ForeignKey, TableDef
from ..operators import constraints, dml, versions
from ..streaming import cdc
from .registry import query

PK = ["o_orderkey"]
COLS = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
_O = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM {orders}"


def orders(t) -> DataFrame:
    return t("orders").select(*COLS)


def incoming(t) -> DataFrame:
    """Half of the rows exist, half are new: keys moved up by 100."""
    return orders(t).filter("o_orderkey % 50 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 100 * (F.col("o_orderkey") % 100 == 0).cast("long") + 1_000_000 * (F.col("o_orderkey") % 100 != 0).cast("long")).withColumn("o_totalprice", F.col("o_totalprice") * 2)


_IN = "SELECT o_orderkey + CASE WHEN o_orderkey % 100 = 0 THEN 100 ELSE 1000000 END AS o_orderkey, o_custkey, o_totalprice * 2 AS o_totalprice, o_orderstatus FROM {orders} WHERE o_orderkey % 50 = 0"


@query("dml_insert", f"{_O} UNION ALL SELECT o_orderkey + 1000000, o_custkey, o_totalprice, 'N' FROM {{orders}} WHERE o_orderkey <= 100")
def _(t):
    new = orders(t).filter("o_orderkey <= 100").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000).withColumn("o_orderstatus", F.lit("N"))
    return dml.apply(orders(t), dml.insert(orders(t), new), PK)


@query("dml_update", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM {orders}")
def _(t):
    return dml.apply(orders(t), dml.update(orders(t), {"o_totalprice": F.col("o_totalprice") + 1}, F.col("o_orderkey") % 10 == 0), PK)


@query("dml_update_pk", "SELECT CASE WHEN o_orderkey <= 50 THEN o_orderkey + 5000000 ELSE o_orderkey END AS o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM {orders}")
def _(t):
    return dml.apply(orders(t), dml.update(orders(t), {"o_orderkey": F.col("o_orderkey") + 5_000_000}, F.col("o_orderkey") <= 50), PK)


@query("dml_delete", f"{_O} WHERE NOT (o_orderkey % 17 = 0)")
def _(t):
    return dml.apply(orders(t), dml.delete(orders(t), F.col("o_orderkey") % 17 == 0), PK)


@query("dml_returning", "SELECT o_orderkey, o_totalprice * 1.5 AS o_totalprice FROM {orders} WHERE o_custkey < 20")
def _(t):
    return dml.returning(dml.update(orders(t), {"o_totalprice": F.col("o_totalprice") * 1.5}, F.col("o_custkey") < 20), "o_orderkey", "o_totalprice")


@query("upsert_do_nothing", f"{_O} UNION ALL SELECT * FROM ({_IN}) AS s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {{orders}})")
def _(t):
    return dml.apply(orders(t), dml.upsert_do_nothing(orders(t), incoming(t), PK), PK)


@query("upsert_do_update", f"""
WITH s AS ({_IN}) SELECT coalesce(o.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(o.o_custkey, s.o_custkey) AS o_custkey,
CASE WHEN o.o_orderkey IS NOT NULL AND s.o_orderkey IS NOT NULL THEN o.o_totalprice + s.o_totalprice ELSE coalesce(o.o_totalprice, s.o_totalprice) END AS o_totalprice, coalesce(o.o_orderstatus, s.o_orderstatus) AS o_orderstatus
FROM {{orders}} o FULL JOIN s ON o.o_orderkey = s.o_orderkey""")
def _(t):
    return dml.apply(orders(t), dml.upsert_do_update(orders(t), incoming(t), PK, {"o_totalprice": F.col("t.o_totalprice") + F.col("excluded.o_totalprice")}), PK)


@query("update_from", "SELECT o.o_orderkey, o.o_custkey, CASE WHEN c.c_custkey IS NOT NULL THEN o.o_totalprice + c.c_acctbal ELSE o.o_totalprice END AS o_totalprice, o.o_orderstatus FROM {orders} o LEFT JOIN (SELECT * FROM {customer} WHERE c_mktsegment = 'BUILDING') c ON o.o_custkey = c.c_custkey")
def _(t):
    c = t("customer").filter("c_mktsegment = 'BUILDING'")
    ch = dml.update_from(orders(t), c, F.col("t.o_custkey") == F.col("s.c_custkey"), {"o_totalprice": F.col("t.o_totalprice") + F.col("s.c_acctbal")}, PK)
    return dml.apply(orders(t), ch, PK)


@query("delete_using", f"{_O} WHERE o_custkey NOT IN (SELECT c_custkey FROM {{customer}} WHERE c_acctbal < 0)")
def _(t):
    return dml.apply(orders(t), dml.delete_using(orders(t), t("customer").filter("c_acctbal < 0"), F.col("t.o_custkey") == F.col("s.c_custkey")), PK)


@query("merge_into", f"""
WITH s AS ({_IN}) SELECT coalesce(o.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(o.o_custkey, s.o_custkey) AS o_custkey,
CASE WHEN o.o_orderkey IS NOT NULL AND s.o_orderkey IS NOT NULL THEN s.o_totalprice ELSE coalesce(o.o_totalprice, s.o_totalprice) END AS o_totalprice, CASE WHEN o.o_orderkey IS NOT NULL AND s.o_orderkey IS NOT NULL THEN 'M' ELSE coalesce(o.o_orderstatus, s.o_orderstatus) END AS o_orderstatus
FROM {{orders}} o FULL JOIN s ON o.o_orderkey = s.o_orderkey WHERE NOT (o.o_orderkey IS NOT NULL AND s.o_orderkey IS NOT NULL AND s.o_orderstatus = 'F')""")
def _(t):
    ch = dml.merge(orders(t), incoming(t), PK, {"o_totalprice": F.col("s.o_totalprice"), "o_orderstatus": F.lit("M")}, matched_delete=F.col("s.o_orderstatus") == "F")
    return dml.apply(orders(t), ch, PK)


@query("ctas", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey")
def _(t):
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("matview_refresh", "SELECT o_custkey, count(*) AS n, CAST(round(sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100, 2) AS DOUBLE) AS total FROM (SELECT * FROM {orders} WHERE o_orderkey % 17 <> 0 UNION ALL SELECT * FROM {orders} WHERE o_orderkey <= 100) GROUP BY o_custkey")
def _(t):
    """A summary kept up to date from changes alone: old rows count negative, new ones positive."""
    base, cents = t("orders"), F.round(F.col("o_totalprice") * 100).cast("long")
    view = base.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(cents).alias("cents"))
    gone, new = base.filter("o_orderkey % 17 = 0"), base.filter("o_orderkey <= 100")
    delta = gone.select("o_custkey", F.lit(-1).cast("long").alias("n"), (-cents).alias("cents")).union(new.select("o_custkey", F.lit(1).cast("long"), cents))
    out = view.union(delta).groupBy("o_custkey").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents")).filter("n > 0")
    return out.select("o_custkey", "n", F.round(F.col("cents") / 100, 2).alias("total"))


# Constraints.


@query("constraint_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def _(t):
    return constraints.unique(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query("constraint_unique_nulls", "SELECT a, b, count(*) AS n FROM (SELECT nullif(o_custkey % 30, 0) AS a, o_orderkey % 100 AS b FROM {orders}) AS s GROUP BY a, b HAVING count(*) > 1")
def _(t):
    rows = t("orders").select(F.nullif(F.col("o_custkey") % 30, F.lit(0)).alias("a"), (F.col("o_orderkey") % 100).alias("b"))
    return constraints.unique(rows, ["a", "b"], nulls_distinct=False)


_R = "SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) // 86400000000 AS lo, epoch_us(o_orderdate) // 86400000000 + o_orderkey % 60 AS hi FROM {orders}"


@query("constraint_exclude", f"WITH r AS ({_R}) SELECT o_orderkey FROM r WHERE lo < hi AND EXISTS (SELECT 1 FROM r q WHERE q.o_custkey = r.o_custkey AND q.o_orderkey <> r.o_orderkey AND q.lo < q.hi AND q.lo < r.hi AND r.lo < q.hi)")
def _(t):
    day = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000)
    rows = t("orders").select("o_orderkey", "o_custkey", day.alias("lo"), (day + F.col("o_orderkey") % 60).alias("hi"))
    return constraints.overlaps(rows, PK, "lo", "hi", ["o_custkey"]).select("o_orderkey")


@query("constraint_fk", "SELECT o_orderkey, k FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN o_custkey + 10000000 WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS k FROM {orders}) AS s WHERE k IS NOT NULL AND k NOT IN (SELECT c_custkey FROM {customer})")
def _(t):
    k = F.when(F.col("o_orderkey") % 100 == 0, F.col("o_custkey") + 10_000_000).when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_custkey"))
    return constraints.foreign_key(t("orders").select("o_orderkey", k.alias("k")), t("customer"), ForeignKey(("k",), "customer", ("c_custkey",)))


@query("constraint_check", "SELECT c_custkey, b FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS b FROM {customer}) AS s WHERE NOT (b >= -500)")
def _(t):
    return constraints.check(t("customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("b")), "b >= -500")


@query("generated_cols", "SELECT p_partkey, p_size, p_size * 2 AS twice, 'new' AS state FROM {part}")
def _(t):
    d = TableDef("parts", (ColumnDef("p_partkey", "bigint"), ColumnDef("p_size", "int"), ColumnDef("twice", "int", generated="p_size * 2"), ColumnDef("state", "string", default="new")), ("p_partkey",))
    return d.complete(t("part").select("p_partkey", "p_size"))


@query("schema_evolution", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN -1 WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS extra FROM {part}")
def _(t):
    d = TableDef("parts", (ColumnDef("p_partkey", "bigint"),), ("p_partkey",)).add_column(ColumnDef("extra", "int", missing=-1))
    old = t("part").filter("p_partkey % 2 = 0").select("p_partkey", F.lit(None).cast("int").alias("extra"), F.lit(1).alias("v"))
    new = t("part").filter("p_partkey % 2 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("extra"), F.lit(2).alias("v"))
    return d.read_as(old.union(new), F.col("v"))


@query("verify_table", "SELECT 'check c_acctbal' AS \"constraint\", count(*) AS violations FROM {customer} WHERE NOT (c_acctbal > -900) HAVING count(*) > 0 UNION ALL SELECT 'enum c_mktsegment', count(*) FROM {customer} WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') HAVING count(*) > 0")
def _(t):
    d = TableDef("customer", (ColumnDef("c_custkey", "bigint"), ColumnDef("c_acctbal", "double", check="c_acctbal > -900"), ColumnDef("c_mktsegment", "string", enum=("BUILDING", "MACHINERY"))), ("c_custkey",))
    return constraints.verify(t("customer"), d)


# Versions: a log made of the orders table.


def log(t) -> DataFrame:
    """1: all rows; 2: every tenth gets a higher price; 3: every 17th goes; 4: new keys; 5: the deleted ones under 1000 come back."""
    o = orders(t)

    def part(df, op, csn, cid=0, origin=None):
        return df.select(*COLS, F.lit(op).alias("_op"), F.lit(csn).cast("long").alias("_csn"), F.lit(cid).alias("_cid"), F.lit(csn * 100).cast("long").alias("_ts"), F.lit(origin).cast("string").alias("_origin"))

    up = o.filter("o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1000)
    twice = o.filter("o_orderkey % 20 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 2000)
    new = o.filter("o_orderkey <= 500").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)
    back = o.filter("o_orderkey % 17 = 0 AND o_orderkey < 1000").withColumn("o_orderstatus", F.lit("B"))
    parts = [part(o, "I", 1), part(up, "U", 2), part(twice, "U", 2, 1), part(o.filter("o_orderkey % 17 = 0"), "D", 3, 0, "east"), part(new, "I", 4, 0, "west"), part(back, "I", 5)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


_LOG = """log AS (
SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, 'I' AS op, 1 AS csn, 0 AS cid, NULL AS origin FROM {orders}
UNION ALL SELECT o_orderkey, o_custkey, o_totalprice + 1000, o_orderstatus, 'U', 2, 0, NULL FROM {orders} WHERE o_orderkey % 10 = 0
UNION ALL SELECT o_orderkey, o_custkey, o_totalprice + 2000, o_orderstatus, 'U', 2, 1, NULL FROM {orders} WHERE o_orderkey % 20 = 0
UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, 'D', 3, 0, 'east' FROM {orders} WHERE o_orderkey % 17 = 0
UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_totalprice, o_orderstatus, 'I', 4, 0, 'west' FROM {orders} WHERE o_orderkey <= 500
UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, 'B', 'I', 5, 0, NULL FROM {orders} WHERE o_orderkey % 17 = 0 AND o_orderkey < 1000)"""


def _snap(where: str, columns: str = "o_orderkey, o_custkey, o_totalprice, o_orderstatus") -> str:
    return f"WITH {_LOG} SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY csn DESC, cid DESC) AS rn FROM log WHERE {where}) AS s WHERE rn = 1 AND op <> 'D'"


@query("snapshot_at_csn", _snap("csn < 4"))
def _(t):
    return versions.snapshot(log(t).drop("_origin"), PK, 4)


@query("snapshot_own", _snap("csn < 2 OR (csn = 2 AND cid < 1)"))
def _(t):
    return versions.snapshot(log(t).drop("_origin"), PK, 2, own_csn=2, cid=1)


@query("snapshot_lookup", _snap("csn < 3 AND o_orderkey IN (20, 30, 34, 10000001)"))
def _(t):
    keys = F.col("o_orderkey").isin(20, 30, 34, 10_000_001)
    return versions.snapshot(log(t).drop("_origin").filter(keys), PK, 3)


@query("time_travel_ts", _snap("csn * 100 <= 350"))
def _(t):
    return versions.as_of(log(t).drop("_origin"), PK, F.lit(350))


@query("rewind_to_csn", _snap("csn < 3"))
def _(t):
    whole = log(t).drop("_origin", "_ts")
    back = versions.rewind(whole.withColumn("_ts", F.lit(0)), PK, 3, 6).select(*whole.columns)
    return versions.snapshot(whole.unionByName(back), PK, 7)


@query("rewind_horizon", f"WITH {_LOG.replace('log AS (', 'log AS MATERIALIZED (', 1)}, old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY csn DESC, cid DESC) AS rn FROM log WHERE csn < 4) AS s WHERE rn = 1 AND op <> 'D') SELECT o_orderkey, op, csn FROM old UNION ALL SELECT o_orderkey, op, csn FROM log WHERE csn >= 4")
def _(t):
    out = versions.horizon(log(t).drop("_origin"), PK, 4)
    return out.select("o_orderkey", F.col("_op").alias("op"), F.col("_csn").cast("int").alias("csn"))


@query("savepoint_rollback", _snap("csn < 3 AND NOT (csn = 2 AND cid >= 1)"))
def _(t):
    return versions.snapshot(versions.rollback_to(log(t).drop("_origin"), 2, 1), PK, 3)


@query("row_history", f"WITH {_LOG} SELECT o_orderkey, op, csn, lead(csn) OVER (PARTITION BY o_orderkey ORDER BY csn, cid) AS csn_to FROM log")
def _(t):
    h = versions.history(log(t).drop("_origin"), PK)
    return h.select("o_orderkey", F.col("_op").alias("op"), F.col("_csn").cast("int").alias("csn"), F.col("_csn_to").cast("int").alias("csn_to"))


@query("undo_size", f"WITH {_LOG} SELECT csn, count(*) AS n FROM log GROUP BY csn")
def _(t):
    return log(t).groupBy(F.col("_csn").cast("int").alias("csn")).agg(F.count("*").alias("n"))


# Change feeds.


@query("cdc_changes", f"WITH {_LOG} SELECT o_orderkey, op, csn, cid, o_totalprice FROM log WHERE csn >= 2 AND csn < 5")
def _(t):
    return cdc.changes(log(t), 2, 5).select("o_orderkey", F.col("_op").alias("op"), F.col("_csn").cast("int").alias("csn"), F.col("_cid").alias("cid"), "o_totalprice")


@query("cdc_net_changes", f"""WITH {_LOG}, w AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY csn, cid) AS a, row_number() OVER (PARTITION BY o_orderkey ORDER BY csn DESC, cid DESC) AS z FROM log WHERE csn >= 2 AND csn < 6)
SELECT z.o_orderkey, CASE WHEN a.op = 'I' THEN 'I' WHEN z.op = 'D' THEN 'D' ELSE 'U' END AS op, z.o_totalprice FROM w a JOIN w z ON a.o_orderkey = z.o_orderkey AND a.a = 1 AND z.z = 1 WHERE NOT (a.op = 'I' AND z.op = 'D')""")
def _(t):
    return cdc.net_changes(log(t), PK, 2, 6).select("o_orderkey", F.col("_op").alias("op"), "o_totalprice")


@query("cdc_filter_origin", f"WITH {_LOG} SELECT o_orderkey, op, csn FROM log WHERE csn > 1 AND (origin IS NULL OR origin <> 'east')")
def _(t):
    return cdc.without_origin(log(t).filter("_csn > 1"), "east").select("o_orderkey", F.col("_op").alias("op"), F.col("_csn").cast("int").alias("csn"))


@query("cdc_before_after", f"""WITH {_LOG} SELECT o_orderkey, op, csn, CASE WHEN lag(op) OVER w <> 'D' THEN lag(o_totalprice) OVER w END AS old_o_totalprice, CASE WHEN op <> 'D' THEN o_totalprice END AS new_o_totalprice FROM log WINDOW w AS (PARTITION BY o_orderkey ORDER BY csn, cid)""")
def _(t):
    out = cdc.before_after(log(t), PK, ["o_totalprice"])
    return out.select("o_orderkey", F.col("_op").alias("op"), F.col("_csn").cast("int").alias("csn"), "old_o_totalprice", "new_o_totalprice")


@query("cdc_apply", _snap("csn < 6"))
def _(t):
    whole = log(t).drop("_origin")
    return cdc.apply_changes(versions.snapshot(whole, PK, 3), whole.filter("_csn >= 2"), PK)


# Event time.


@query("evt_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM {events} GROUP BY 1, 2")
def _(t):
    out = cdc.tumbling(t("events"), "ts", "1 hour", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "v")


@query("evt_sliding", "SELECT b - INTERVAL 1 HOUR * k AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS b, unnest([0, 1]) AS k FROM {events}) AS s GROUP BY 1")
def _(t):
    return cdc.sliding(t("events"), "ts", "2 hours", "1 hour").agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("evt_session", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM {events}), h AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS q FROM g) AS z)
SELECT user_id, min(ts) AS start, count(*) AS n FROM h GROUP BY user_id, s""")
def _(t):
    out = cdc.sessions(t("events"), "ts", "6 hours", "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")
