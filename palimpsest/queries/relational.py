"""Joins, aggregates, windows, order and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, sql_query

# Joins.

sql_query("join_inner", "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'")
# Where all pairs would be too many, each side is summed up by key before the join.
sql_query("join_dup_keys", """
SELECT l.k, l.n * r.n AS n, l.s * r.n AS s FROM (SELECT o_custkey % 3 AS k, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM {orders} GROUP BY o_custkey % 3) l
JOIN (SELECT c_custkey % 3 AS k, count(*) AS n FROM {customer} GROUP BY c_custkey % 3) r ON l.k = r.k""")
sql_query("join_inner_composite", "SELECT a.l_orderkey, a.l_linenumber, a.l_partkey AS x, b.l_partkey AS y FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber")
sql_query("join_right", "SELECT o.o_orderkey, s.s_suppkey, s.s_name FROM {orders} o RIGHT JOIN {supplier} s ON o.o_custkey = s.s_suppkey")
_L = "(SELECT o_custkey AS a, o_orderpriority AS b, count(*) AS x FROM {orders} GROUP BY o_custkey, o_orderpriority)"
_R = "(SELECT o_custkey + 7 AS a, o_orderpriority AS b, max(o_totalprice) AS y FROM {orders} GROUP BY o_custkey + 7, o_orderpriority)"
sql_query("join_full", f"SELECT a, b, l.x, r.y FROM {_L} l FULL JOIN {_R} r USING (a, b)")
sql_query("join_null_safe", """
SELECT a.k, a.n * b.n AS n FROM (SELECT nullif(c_custkey % 5, 0) AS k, count(*) AS n FROM {customer} GROUP BY nullif(c_custkey % 5, 0)) a
JOIN (SELECT nullif(s_suppkey % 5, 0) AS k, count(*) AS n FROM {supplier} GROUP BY nullif(s_suppkey % 5, 0)) b ON a.k IS NOT DISTINCT FROM b.k""")
sql_query("join_left", "SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT JOIN (SELECT * FROM {orders} WHERE o_totalprice > 400000) o ON c.c_custkey = o.o_custkey")
sql_query("join_cross", "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n")
sql_query("join_semi_in", "SELECT c_custkey, c_name FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 350000)")
sql_query("join_semi_exists", "SELECT s_suppkey FROM {supplier} s WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity >= 50)")
sql_query("join_anti", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
sql_query("join_multiway", "SELECT r.r_name, n.n_name, count(*) AS n, round(sum(o.o_totalprice), 2) AS total FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name")
sql_query("join_lateral", "SELECT c.c_custkey, t.o_orderkey, t.o_totalprice FROM {customer} c, LATERAL (SELECT o_orderkey, o_totalprice FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000) t")
sql_query("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")


@query("join_range", """
SELECT e.event_id, w.w FROM {events} e JOIN (SELECT event_id AS w, epoch_us(ts) AS lo, epoch_us(ts) + 60000000 AS hi FROM {events}) w ON epoch_us(e.ts) >= w.lo AND epoch_us(e.ts) < w.hi""")
def _(t):
    from ..operators.joins import range_join

    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = t("events").select(F.col("event_id").alias("w"), at.alias("lo"), (at + 60_000_000).alias("hi"))
    return range_join(t("events").select("event_id", at.alias("at")), "at", w, "lo", "hi", width=60_000_000).select("event_id", "w")


@query("join_asof", """
SELECT e.event_id, p.event_id AS prev_id FROM {events} e LEFT JOIN LATERAL (
  SELECT event_id FROM {events} q WHERE q.user_id = e.user_id AND q.event_type = 'purchase' AND (q.ts < e.ts OR (q.ts = e.ts AND q.event_id <= e.event_id)) ORDER BY q.ts DESC, q.event_id DESC LIMIT 1) p ON true""")
def _(t):
    from ..operators.joins import asof_join

    e = t("events")
    left = e.select("user_id", "ts", "event_id")
    right = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("prev_id"))
    return asof_join(left, right, ["user_id"], "ts", ["prev_id"], ("event_id", "prev_id")).select("event_id", "prev_id")


# Aggregates.

sql_query("agg_plain", "SELECT count(*) AS n, sum(l_linenumber) AS s, min(l_shipdate) AS lo, max(l_shipdate) AS hi, round(avg(l_quantity), 6) AS a FROM {lineitem}", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_shipdate) AS lo, max(l_shipdate) AS hi, round(avg(l_quantity), 6) AS a FROM {lineitem}")
sql_query("agg_group", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""")
sql_query("agg_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 1000000")
sql_query("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p FROM {lineitem} GROUP BY l_returnflag")
sql_query("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}")
sql_query("agg_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS big, sum(o_custkey) FILTER (WHERE o_orderpriority = '1-URGENT') AS s FROM {orders} GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS big, CAST(sum(o_custkey) FILTER (WHERE o_orderpriority = '1-URGENT') AS BIGINT) AS s FROM {orders} GROUP BY o_orderstatus")
sql_query("agg_string", "SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names, array_join(array_sort(array_agg(n_nationkey)), '-') AS ks FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, array_to_string(list_sort(array_agg(n_nationkey)), '-') AS ks FROM {nation} GROUP BY n_regionkey")
sql_query("agg_bool", "SELECT c_nationkey, bool_and(c_acctbal > -900) AS a, bool_or(c_acctbal > 9900) AS o FROM {customer} GROUP BY c_nationkey")
sql_query("agg_minmax_expr", "SELECT o_orderstatus, min(o_totalprice * 2) AS lo, max(abs(o_custkey - 700)) AS hi FROM {orders} GROUP BY o_orderstatus")
sql_query("agg_expr", "SELECT round(sum(sqrt(l_quantity)), 4) AS s, sum(length(l_returnflag) + l_linenumber % 3) AS m FROM {lineitem}", "SELECT round(sum(sqrt(l_quantity)), 4) AS s, CAST(sum(length(l_returnflag) + l_linenumber % 3) AS BIGINT) AS m FROM {lineitem}")
for _kind in ("ROLLUP", "CUBE"):
    sql_query(f"agg_{_kind.lower()}", f"SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) + 2 * grouping(o_orderpriority) AS g, count(*) AS n FROM {{orders}} GROUP BY {_kind} (o_orderstatus, o_orderpriority)", f"SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) + 2 * grouping(o_orderpriority) AS INTEGER) AS g, count(*) AS n FROM {{orders}} GROUP BY {_kind} (o_orderstatus, o_orderpriority)")
sql_query("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
sql_query("agg_percentile", "SELECT o_orderstatus, round(percentile(o_totalprice, 0.5), 4) AS med, round(stddev_samp(o_totalprice), 4) AS sd FROM {orders} GROUP BY o_orderstatus", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS med, round(stddev_samp(o_totalprice), 4) AS sd FROM {orders} GROUP BY o_orderstatus")


@query("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM {orders} ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def _(t):
    best = F.min_by(F.struct("o_orderkey", "o_totalprice"), F.struct(-F.col("o_totalprice"), "o_orderkey")).alias("b")
    return t("orders").groupBy("o_custkey").agg(best).select("o_custkey", "b.o_orderkey", "b.o_totalprice")


# Windows.

sql_query("win_lag", "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next2 FROM {orders}")
sql_query("win_sum_all", "SELECT c_custkey, c_nationkey, round(sum(c_acctbal) OVER (PARTITION BY c_nationkey), 2) AS total, count(*) OVER (PARTITION BY c_nationkey) AS n FROM {customer}")
sql_query("win_rank", """
SELECT c_custkey, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS d, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) AS BIGINT) AS rn,
       CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS BIGINT) AS q, percent_rank() OVER w AS p FROM {customer} WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)""")
sql_query("win_rows_frame", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS ma, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS m FROM {orders}")
sql_query("win_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM {part}")
sql_query("win_first_last", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS s FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")

# Order and limits.

sql_query("sort_multi", "SELECT c_custkey, c_nationkey, c_acctbal FROM {customer} ORDER BY c_nationkey NULLS LAST, c_acctbal NULLS LAST, c_custkey")
sql_query("sort_mixed", "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_suppkey < 5 ORDER BY l_quantity DESC NULLS LAST, l_orderkey ASC NULLS FIRST, l_linenumber")
sql_query("sort_nulls", "SELECT k, id FROM (SELECT nullif(o_custkey % 4, 0) AS k, o_orderkey AS id FROM {orders}) AS s ORDER BY k DESC NULLS FIRST, id LIMIT 50")
sql_query("topk", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
sql_query("offset_page", "SELECT c_custkey, c_name FROM {customer} ORDER BY c_acctbal NULLS LAST, c_custkey LIMIT 20 OFFSET 40")
sql_query("sort_union_children", "SELECT kind, k, bal FROM (SELECT 'c' AS kind, c_custkey AS k, c_acctbal AS bal FROM {customer} UNION ALL SELECT 's', s_suppkey, s_acctbal FROM {supplier}) AS u ORDER BY bal DESC NULLS LAST, kind, k LIMIT 100")

# Set operations.

_A, _B = "SELECT c_nationkey AS k FROM {customer}", "SELECT s_nationkey AS k FROM {supplier}"
sql_query("set_union_all", f"{_A} UNION ALL {_B}")
sql_query("set_union", f"{_A} UNION {_B}")
sql_query("set_except", f"SELECT n_nationkey AS k FROM {{nation}} EXCEPT {_B}")
sql_query("set_except_all", f"{_A} EXCEPT ALL {_B}")
sql_query("set_symdiff", f"(({_A}) EXCEPT ALL ({_B})) UNION ALL (({_B}) EXCEPT ALL ({_A}))")
sql_query("set_intersect", f"{_A} INTERSECT {_B}")
sql_query("set_intersect_all", f"{_A} INTERSECT ALL {_B}")
sql_query("recursive_cte", "WITH RECURSIVE r AS (SELECT 1 AS i, 1 AS f UNION ALL SELECT i + 1, f * (i + 1) FROM r WHERE i < 10) SELECT i, f FROM r")
