"""Scalar functions by group."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import ranges
from ..functions.types import enum_order
from .registry import query, sql_query

sql_query("str_basic", "SELECT p_partkey, concat(upper(p_brand), '-', lower(p_type)) AS a, length(p_name) AS n, substring(p_name, 2, 4) AS s, left(p_type, 3) AS l, right(p_type, 3) AS r, replace(p_brand, 'Brand', 'B') AS b, reverse(p_brand) AS v, repeat('x', 3) AS x, trim('  a ') AS t, ascii('A') AS ac, chr(66) AS ch FROM {part}", "SELECT p_partkey, concat(upper(p_brand), '-', lower(p_type)) AS a, CAST(length(p_name) AS INTEGER) AS n, substring(p_name, 2, 4) AS s, left(p_type, 3) AS l, right(p_type, 3) AS r, replace(p_brand, 'Brand', 'B') AS b, reverse(p_brand) AS v, repeat('x', 3) AS x, trim('  a ') AS t, ascii('A') AS ac, chr(66) AS ch FROM {part}")
sql_query("str_regex", "SELECT p_partkey, regexp_replace(p_name, '[0-9]', '#') AS a, regexp_extract(p_brand, '#([0-9])', 1) AS d, split_part(p_brand, '#', 2) AS s, translate(p_brand, 'Bd', 'bD') AS t FROM {part}", "SELECT p_partkey, regexp_replace(p_name, '[0-9]', '#', 'g') AS a, regexp_extract(p_brand, '#([0-9])', 1) AS d, split_part(p_brand, '#', 2) AS s, translate(p_brand, 'Bd', 'bD') AS t FROM {part}")
sql_query("str_pad_case", "SELECT c_custkey, lpad(cast(c_custkey AS STRING), 8, '0') AS lp, rpad(c_mktsegment, 12, '.') AS rp, initcap(lower(c_mktsegment)) AS ic FROM {customer}", "SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS lp, rpad(c_mktsegment, 12, '.') AS rp, upper(left(c_mktsegment, 1)) || lower(substring(c_mktsegment, 2)) AS ic FROM {customer}")
sql_query("str_hash", "SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s, lower(hex(c_name)) AS h, decode(unhex(hex(c_name)), 'UTF-8') AS u FROM {customer}", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, lower(hex(c_name)) AS h, c_name AS u FROM {customer}")
sql_query("str_format", "SELECT s_suppkey, format_string('%s has %d', s_name, s_nationkey) AS f, concat_ws('|', s_name, cast(s_nationkey AS STRING)) AS w FROM {supplier}", "SELECT s_suppkey, format('{} has {}', s_name, s_nationkey) AS f, concat_ws('|', s_name, CAST(s_nationkey AS VARCHAR)) AS w FROM {supplier}")
sql_query("math_basic", "SELECT c_custkey, abs(c_acctbal) AS a, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, round(c_acctbal, 1) AS r, round(sqrt(abs(c_acctbal)), 6) AS q, c_custkey % 7 AS m, round(power(c_custkey % 10, 2), 4) AS p, sign(c_acctbal) AS g FROM {customer}", "SELECT c_custkey, abs(c_acctbal) AS a, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c, round(c_acctbal, 1) AS r, round(sqrt(abs(c_acctbal)), 6) AS q, c_custkey % 7 AS m, round(power(c_custkey % 10, 2), 4) AS p, CAST(sign(c_acctbal) AS DOUBLE) AS g FROM {customer}")
sql_query("date_basic", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, datediff(date '1999-01-01', cast(o_orderdate AS DATE)) AS n, date_add(cast(o_orderdate AS DATE), 30) AS p, quarter(o_orderdate) AS q, unix_timestamp(cast(o_orderdate AS TIMESTAMP)) AS e FROM {orders}", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS INTEGER) AS n, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS p, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(epoch(o_orderdate) AS BIGINT) AS e FROM {orders}")
sql_query("date_trunc_group", "SELECT CAST(date_trunc('MONTH', o_orderdate) AS TIMESTAMP_NTZ) AS m, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY 1", "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY 1")
sql_query("date_interval", "SELECT event_id, ts + INTERVAL '90' MINUTE AS a, ts - INTERVAL '2' DAY AS b, CAST(ts AS DATE) AS d FROM {events} WHERE ts >= TIMESTAMP_NTZ '2024-01-01 00:00:00'", "SELECT event_id, ts + INTERVAL 90 MINUTE AS a, ts - INTERVAL 2 DAY AS b, CAST(ts AS DATE) AS d FROM {events} WHERE ts >= TIMESTAMP '2024-01-01 00:00:00'")
sql_query("array_ops", "SELECT vec_id, size(embedding) AS n, round(embedding[0], 6) AS f, round(element_at(embedding, -1), 6) AS l, array_join(slice(transform(embedding, x -> cast(floor(x * 10) AS INT)), 1, 4), ',') AS s, size(filter(embedding, x -> x > 0)) AS pos FROM {embeddings}", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(embedding[1], 6) AS f, round(embedding[len(embedding)], 6) AS l, array_to_string(list_transform(embedding[1:4], lambda x: CAST(floor(x * 10) AS INTEGER)), ',') AS s, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS pos FROM {embeddings}")
sql_query("array_unnest", "SELECT vec_id, pos + 1 AS i, round(x, 5) AS x FROM {embeddings} LATERAL VIEW posexplode(slice(embedding, 1, 5)) v AS pos, x", "SELECT vec_id, CAST(unnest(range(1, 6)) AS INTEGER) AS i, round(unnest(embedding[1:5]), 5) AS x FROM {embeddings}")
sql_query("array_build", "SELECT n_regionkey, array_contains(collect_set(n_nationkey), 3) AS has3, aggregate(array_sort(collect_list(n_nationkey)), 0, (a, x) -> a + x) AS s, size(array_distinct(array_repeat(7, 3))) AS one FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, list_contains(list(n_nationkey), 3) AS has3, CAST(sum(n_nationkey) AS INTEGER) AS s, 1 AS one FROM {nation} GROUP BY n_regionkey")
sql_query("json_extract", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM {events}")
sql_query("json_build", "SELECT n_nationkey, to_json(named_struct('id', n_nationkey, 'name', n_name)) AS j FROM {nation}", "SELECT n_nationkey, CAST(json_object('id', n_nationkey, 'name', n_name) AS VARCHAR) AS j FROM {nation}")
sql_query("cast_ops", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12, 1)) AS d, CAST(o_orderkey AS STRING) AS s, try_cast(o_orderpriority AS INT) AS bad, try_cast(left(o_orderpriority, 1) AS INT) AS p, CAST(o_custkey AS DOUBLE) / 3 AS q, CAST(o_orderdate AS DATE) AS dt FROM {orders}", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12, 1)) AS d, CAST(o_orderkey AS VARCHAR) AS s, TRY_CAST(o_orderpriority AS INTEGER) AS bad, TRY_CAST(left(o_orderpriority, 1) AS INTEGER) AS p, CAST(o_custkey AS DOUBLE) / 3 AS q, CAST(o_orderdate AS DATE) AS dt FROM {orders}")
sql_query("map_ops", "SELECT n_nationkey, element_at(m, 'name') AS v, map_contains_key(m, 'region') AS has, array_join(array_sort(map_keys(m)), ',') AS ks FROM (SELECT n_nationkey, map_from_arrays(array('name', 'key'), array(n_name, cast(n_nationkey AS STRING))) AS m FROM {nation}) AS s", "SELECT n_nationkey, n_name AS v, false AS has, 'key,name' AS ks FROM {nation}")
sql_query("struct_ops", "SELECT s_suppkey, s.a.x AS x, s.b AS b FROM (SELECT s_suppkey, named_struct('a', named_struct('x', s_nationkey * 2), 'b', s_name) AS s FROM {supplier}) AS t", "SELECT s_suppkey, s_nationkey * 2 AS x, s_name AS b FROM {supplier}")


@query("range_parse", "SELECT s_suppkey, '[' || (s_suppkey + 1) || ',' || (s_suppkey + 6) || ')' AS r, true AS inside FROM {supplier}")
def _(t):
    text = F.concat(F.lit("("), F.col("s_suppkey").cast("string"), F.lit(","), (F.col("s_suppkey") + 5).cast("string"), F.lit("]"))
    rows = t("supplier").select("s_suppkey", ranges.parse(text).alias("x"))
    return rows.select("s_suppkey", ranges.show(F.col("x")).alias("r"), ranges.contains(F.col("x"), F.col("s_suppkey") + 5).alias("inside"))


_PRIORITIES = ("3-MEDIUM", "1-URGENT", "5-LOW", "2-HIGH", "4-NOT SPECIFIED")


@query("custom_order", """
SELECT o_orderkey, o_orderpriority FROM {orders}
ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '5-LOW' THEN 3 WHEN '2-HIGH' THEN 4 ELSE 5 END, o_orderkey""")
def _(t):
    o = t("orders").select("o_orderkey", "o_orderpriority")
    return o.orderBy(enum_order(F.col("o_orderpriority"), _PRIORITIES), "o_orderkey")


@udtf(returnType="i: bigint, square: bigint")
class Squares:
    """A set-returning function: 1 to n with their squares."""

    def eval(self, n: int):
        for i in range(1, n + 1):
            yield i, i * i


@query("udtf_rows", "SELECT n_nationkey, i, i * i AS square FROM (SELECT n_nationkey, unnest(range(1, CAST(n_nationkey AS BIGINT) + 1)) AS i FROM {nation}) AS s")
def _(t):
    spark = t("nation").sparkSession
    spark.udtf.register("squares", Squares)
    return spark.sql("SELECT n_nationkey, s.i, s.square FROM {n}, LATERAL squares(n_nationkey) s", n=t("nation"))


@query("udaf_geomean", "SELECT p_brand, round(exp(avg(ln(p_retailprice))), 4) AS g FROM {part} GROUP BY p_brand")
def _(t):
    return t("part").groupBy("p_brand").agg(F.round(F.exp(F.avg(F.log("p_retailprice"))), 4).alias("g"))
