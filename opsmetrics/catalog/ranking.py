"""Group F: sorts, limits, top-k."""

from pyspark.sql import functions as F

from ..operators import ranking as R
from .fixtures import money
from .registry import query


@query("f1_order_by", "SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders")
def _(t):
    late_first = F.when(F.col("o_orderstatus") == "O", 0).otherwise(1)
    return t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate").orderBy(late_first, F.desc("o_orderdate"), "o_orderkey")


@query("f2_top_n", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50""")
def _(t):
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    return R.top_n(t.lineitem.select(*cols), 50, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("f3_top_variable", """
SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25""")
def _(t):
    n = 25
    return R.top_n(t.events.select("event_id", "value"), n, F.desc("value"), "event_id")


@query("f4_page", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40""")
def _(t):
    return R.page(t.orders.select("o_orderkey", "o_totalprice"), 40, 20, F.desc("o_totalprice"), "o_orderkey")


@query("f4_deep_page", """
SELECT o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 - (SELECT count(*) // 2 FROM orders) BETWEEN 0 AND 49""")
def _(t):
    # The directory is asked for at any depth here, and its ranges are small enough for several on the given tables.
    half = t.orders.count() // 2
    return R.page(t.orders.select("o_orderkey", "o_totalprice"), half, 50, F.desc("o_totalprice"), "o_orderkey", near=0, rows=2000)


@query("f5_nth_highest", """
SELECT o_orderkey, o_orderdate FROM orders QUALIFY dense_rank() OVER (ORDER BY o_orderdate DESC) = 3""")
def _(t):
    return R.nth_highest(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", 3)


@query("f6_top_per_group", """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3""")
def _(t):
    return (R.top_k_per_group(t.orders, "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], 3)
            .select("o_custkey", "o_orderkey", "o_totalprice"))


@query("f7_top_other", """
WITH s AS (SELECT user_id, sum(CAST(value * 100 AS BIGINT)) AS cents FROM events GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY cents DESC, user_id) AS rn FROM s)
SELECT CASE WHEN rn <= 5 THEN CAST(user_id AS VARCHAR) ELSE 'Other' END AS user_id, CAST(sum(cents) AS BIGINT) AS cents FROM r GROUP BY 1""")
def _(t):
    ev = t.events.select("user_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    return R.top_k_other(ev, "user_id", "cents", 5)


@query("f8_rank_band", """
SELECT user_id, n, row_num FROM (SELECT user_id, CAST(count(*) AS BIGINT) AS n, row_number() OVER (ORDER BY count(*) DESC, user_id) AS row_num
FROM events GROUP BY 1) WHERE row_num BETWEEN 6 AND 15""")
def _(t):
    counts = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return R.rank_band(counts, 6, 15, [F.desc("n"), F.asc("user_id")]).withColumn("row_num", F.col("row_num").cast("bigint"))
