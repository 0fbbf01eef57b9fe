"""Scans, sources and predicates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import ranges
from ..functions.types import fts_match, tokens
from ..model import IndexDef, KeyPart
from ..operators import introspect
from ..operators.access import KeySet, index_scan, lookup, multi_lookup, scan
from ..plans.keyrange import KeyRange, all_array, all_of_ranges, any_array, any_of_ranges, distinct_leading, in_lists, ordered, row_compare
from .registry import query, sql_query

BY_DATE = IndexDef("orders_date", (KeyPart("o_orderdate", desc=True),), include=("o_totalprice",))
BY_PRICE = IndexDef("orders_price", (KeyPart("o_totalprice", desc=True),))


@query("scan_full", "SELECT * FROM {orders}")
def _(t):
    return scan(t("orders"))


@query("filter_simple", "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_quantity > 45 AND l_returnflag = 'R'")
def _(t):
    return scan(t("lineitem"), "l_orderkey", "l_linenumber", "l_quantity", where=(F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R"))


@query("pk_range_scan", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey >= 1000 AND o_orderkey < 3000 ORDER BY o_orderkey")
def _(t):
    r = KeyRange("o_orderkey", 1000, 3000, high_inclusive=False)
    return ordered(scan(t("orders"), "o_orderkey", "o_totalprice", where=r.predicate()), KeyPart("o_orderkey"))


@query("pk_lookup", "SELECT * FROM {customer} WHERE c_custkey = 42")
def _(t):
    return lookup(t("customer"), c_custkey=42)


@query("pk_multi_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} WHERE o_orderkey IN (1, 7, 500, 1234, 99999999)")
def _(t):
    return multi_lookup(t("orders"), "o_orderkey", [1, 7, 500, 1234, 99999999]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("sec_index_scan", "SELECT o_orderkey, o_custkey, o_orderdate FROM {orders} WHERE o_custkey BETWEEN 100 AND 120")
def _(t):
    return scan(t("orders"), "o_orderkey", "o_custkey", "o_orderdate", where=KeyRange("o_custkey", 100, 120).predicate())


@query("index_only_scan", "SELECT o_orderdate, o_totalprice, o_orderkey FROM {orders} WHERE o_orderdate >= TIMESTAMP '1998-01-01' ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey")
def _(t):
    return index_scan(t("orders"), BY_DATE, F.col("o_orderdate") >= dt.datetime(1998, 1, 1), pk=["o_orderkey"], only=True)


@query("sec_index_topn", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 10")
def _(t):
    return index_scan(t("orders"), BY_PRICE, limit=10, pk=["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("in_list_scan", "SELECT o_orderkey, o_orderpriority FROM {orders} WHERE o_custkey IN (3, 30, 300, 700, 1100)")
def _(t):
    return t("orders").filter(in_lists(o_custkey=[3, 30, 300, 700, 1100])).select("o_orderkey", "o_orderpriority")


@query("in_list_multi", "SELECT l_orderkey, l_linenumber, l_suppkey FROM {lineitem} WHERE l_suppkey IN (1, 5, 9, 13) AND l_linenumber IN (1, 2, 3)")
def _(t):
    return t("lineitem").filter(in_lists(l_suppkey=[1, 5, 9, 13], l_linenumber=[1, 2, 3])).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("skip_scan", "SELECT DISTINCT c_nationkey FROM {customer} WHERE c_custkey BETWEEN 10 AND 200")
def _(t):
    return distinct_leading(t("customer"), "c_nationkey", KeyRange("c_custkey", 10, 200).predicate())


@query("ordered_parallel_scan", "SELECT o_orderkey, o_orderdate FROM {orders} ORDER BY o_orderdate DESC NULLS LAST, o_orderkey")
def _(t):
    return ordered(t("orders").select("o_orderkey", "o_orderdate"), KeyPart("o_orderdate", desc=True, nulls_first=False), KeyPart("o_orderkey"))


@query("bitmap_single", "SELECT * FROM {orders} WHERE o_orderstatus = 'F'")
def _(t):
    return KeySet(t("orders"), ["o_orderkey"], F.col("o_orderstatus") == "F").fetch()


@query("bitmap_and", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'O' AND o_custkey < 300 AND o_totalprice > 100000")
def _(t):
    o = t("orders")
    a, b, c = (KeySet(o, ["o_orderkey"], p) for p in (F.col("o_orderstatus") == "O", F.col("o_custkey") < 300, F.col("o_totalprice") > 100000))
    return (a & b & c).fetch().select("o_orderkey")


@query("bitmap_or", "SELECT o_orderkey FROM {orders} WHERE o_custkey < 50 OR o_totalprice > 400000")
def _(t):
    o = t("orders")
    return (KeySet(o, ["o_orderkey"], F.col("o_custkey") < 50) | KeySet(o, ["o_orderkey"], F.col("o_totalprice") > 400000)).fetch().select("o_orderkey")


@query("bitmap_heap_semi", "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} WHERE l_quantity = 50 AND l_discount = 0.1) AND o_totalprice > 1000")
def _(t):
    keys = t("lineitem").filter("l_quantity = 50 AND l_discount = 0.1").select(F.col("l_orderkey").alias("o_orderkey"))
    return KeySet(t("orders"), ["o_orderkey"], keys=keys).fetch(F.col("o_totalprice") > 1000).select("o_orderkey", "o_custkey")


@query("range_overlap", """
SELECT o_orderkey, lo, hi FROM (SELECT o_orderkey, o_custkey AS lo, o_custkey + o_orderkey % 50 AS hi FROM {orders}) WHERE lo < hi AND lo < 130 AND hi > 100 AND NOT (lo <= 110 AND 110 < hi)""")
def _(t):
    rows = t("orders").select("o_orderkey", F.col("o_custkey").alias("lo"), (F.col("o_custkey") + F.col("o_orderkey") % 50).alias("hi"))
    r, window = ranges.make(F.col("lo"), F.col("hi")), ranges.make(F.lit(100), F.lit(130))
    return rows.filter(ranges.overlap(r, window) & ~ranges.contains(r, F.lit(110)))


@query("fts_match", """
SELECT conv_id, turn FROM (SELECT conv_id, turn, list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM {conversations})
WHERE (list_contains(w, 'the') AND NOT list_contains(w, 'and')) OR list_contains(w, 'que')""")
def _(t):
    return t("conversations").filter(fts_match(tokens(F.col("text")), "the & !and | que")).select("conv_id", "turn")


@query("analyze_stats", """
SELECT 'l_returnflag' AS "column", count(*) AS rows, count(*) FILTER (WHERE l_returnflag IS NULL) AS nulls, count(DISTINCT l_returnflag) AS distinct_values, min(l_returnflag) AS least, max(l_returnflag) AS greatest FROM {lineitem}
UNION ALL SELECT 'l_suppkey', count(*), count(*) FILTER (WHERE l_suppkey IS NULL), count(DISTINCT l_suppkey), CAST(min(l_suppkey) AS VARCHAR), CAST(max(l_suppkey) AS VARCHAR) FROM {lineitem}""")
def _(t):
    return introspect.column_stats(t("lineitem"), "l_returnflag", "l_suppkey")


# Predicates.


@query("range_bounds", """
SELECT o_orderkey FROM {orders} WHERE (o_orderkey > 100 AND o_orderkey <= 200) OR (o_orderkey >= 5000 AND o_orderkey < 5010) OR o_orderkey = 7""")
def _(t):
    r = (KeyRange("o_orderkey", 100, 200, low_inclusive=False), KeyRange("o_orderkey", 5000, 5010, high_inclusive=False), KeyRange.point("o_orderkey", 7))
    return t("orders").filter(any_of_ranges(*r)).select("o_orderkey")


@query("null_filter", """
SELECT count(*) FILTER (WHERE k IS NULL) AS nulls, count(*) FILTER (WHERE k IS NOT NULL AND k > 3) AS big, count(*) AS n FROM (SELECT nullif(o_custkey % 7, 0) AS k FROM {orders})""")
def _(t):
    k = t("orders").select(F.nullif(F.col("o_custkey") % 7, F.lit(0)).alias("k"))
    return k.agg(F.count_if(KeyRange("k", null=True).predicate()).alias("nulls"), F.count_if(KeyRange("k", 3, low_inclusive=False, null=False).predicate()).alias("big"), F.count("*").alias("n"))


_NULLABLE = "SELECT o_orderkey, nullif(o_custkey % 10, 0) AS a, nullif(o_orderkey % 7, 0) AS b FROM {orders}"


@query("row_compare", f"SELECT o_orderkey, a, b FROM ({_NULLABLE}) WHERE a < 3 OR (a = 3 AND b <= 2)")
def _(t):
    rows = t("orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 10, F.lit(0)).alias("a"), F.nullif(F.col("o_orderkey") % 7, F.lit(0)).alias("b"))
    return rows.filter(row_compare(["a", "b"], "<=", [3, 2]))


@query("any_all_array", "SELECT p_partkey, p_size FROM {part} WHERE p_size = ANY([1, 5, 9]) OR (p_size > 45 AND p_size <> 47 AND p_size <> 49)")
def _(t):
    p = F.col("p_size")
    return t("part").filter(any_array(p, "=", [1, 5, 9]) | (all_array(p, ">", [40, 45]) & all_array(p, "<>", [47, 49]))).select("p_partkey", "p_size")


@query("or_ranges", "SELECT o_orderkey, o_custkey FROM {orders} WHERE (o_orderkey < 100 AND o_custkey > 500) OR (o_orderkey > 14000 AND o_custkey < 100)")
def _(t):
    a = all_of_ranges(KeyRange("o_orderkey", high=100, high_inclusive=False), KeyRange("o_custkey", 500, low_inclusive=False))
    b = all_of_ranges(KeyRange("o_orderkey", 14000, low_inclusive=False), KeyRange("o_custkey", high=100, high_inclusive=False))
    return t("orders").filter(a | b).select("o_orderkey", "o_custkey")


@query("partial_index_scan", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = 'P' AND o_totalprice < 50000 ORDER BY o_totalprice, o_orderkey")
def _(t):
    i = IndexDef("pending", (KeyPart("o_totalprice"),), where="o_orderstatus = 'P'")
    return index_scan(t("orders"), i, F.col("o_totalprice") < 50000, pk=["o_orderkey"]).select("o_orderkey", "o_totalprice")


sql_query("series_source", "SELECT id AS i, id * id AS sq FROM range(1, 101)", "SELECT range AS i, range * range AS sq FROM range(1, 101)")
sql_query("cte_filter_agg", """
WITH big AS (SELECT o_custkey, o_totalprice FROM {orders} WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM big GROUP BY o_custkey)
SELECT o_custkey, n, top FROM per WHERE n > 2""")
sql_query("project_expr", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity * 2 AS q2 FROM {lineitem}")
sql_query("filter_residual", "SELECT o_orderkey FROM {orders} WHERE o_orderkey BETWEEN 10 AND 9000 AND o_orderkey % 13 = o_custkey % 13 AND (o_orderpriority <> '1-URGENT' OR o_totalprice > 90000)")
sql_query("between_filter", "SELECT p_partkey, p_retailprice FROM {part} WHERE p_retailprice BETWEEN 950 AND 1000 AND p_size NOT BETWEEN 10 AND 20")
sql_query("like_filter", "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%1%' AND p_brand NOT LIKE 'Brand#5_' AND p_type LIKE '%'")
sql_query("regex_filter", "SELECT p_partkey, p_brand FROM {part} WHERE p_brand RLIKE '#[1-3][2-4]$'", "SELECT p_partkey, p_brand FROM {part} WHERE regexp_matches(p_brand, '#[1-3][2-4]$')")
sql_query("case_coalesce", """
SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
       coalesce(nullif(o_custkey % 5, 0), -1) AS c, greatest(o_custkey % 5, o_orderkey % 7) AS g, least(o_custkey % 5, o_orderkey % 7) AS l FROM {orders}""")
sql_query("distinct_from", "SELECT count(*) AS n FROM (SELECT nullif(o_custkey % 5, 0) AS a, nullif(o_orderkey % 5, 0) AS b FROM {orders}) AS s WHERE a IS DISTINCT FROM b")
