"""Group D: aggregations."""

from pyspark.sql import functions as F

from ..functions.scalars import safe_div, weighted_avg
from ..operators import aggregates as A
from ..operators.ranking import latest_per_key
from ..operators.windows import time_block
from .fixtures import money
from .registry import query


@query("d1_group_by", """
SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean, min(value) AS low, max(value) AS high
FROM events GROUP BY 1""")
def _(t):
    total = F.sum(money("value")).cast("double")
    n = F.count(F.lit(1))
    return t.events.groupBy("event_type").agg(n.alias("n"), total.alias("total"), (total / n).alias("mean"),
                                              F.min("value").alias("low"), F.max("value").alias("high"))


@query("d2_global", """
SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, max(ts) AS newest FROM events""")
def _(t):
    return t.events.agg(F.count(F.lit(1)).alias("n"), F.sum(money("value")).cast("double").alias("total"),
                        F.max("ts").alias("newest"))


@query("d3_count_distinct", """
SELECT p_brand, CAST(count(DISTINCT p_type) AS BIGINT) AS types, CAST(count(DISTINCT p_size) AS BIGINT) AS sizes FROM part GROUP BY 1""")
def _(t):
    return t.part.groupBy("p_brand").agg(F.countDistinct("p_type").alias("types"), F.countDistinct("p_size").alias("sizes"))


@query("d4_conditional", """
SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS full_n,
       CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS open_total
FROM orders GROUP BY 1""")
def _(t):
    return t.orders.groupBy("o_custkey").agg(
        A.sum_if(F.col("o_orderstatus") == "F").cast("bigint").alias("full_n"),
        A.sum_if(F.col("o_orderstatus") == "O", money("o_totalprice")).cast("double").alias("open_total"))


@query("d5_last_by_kind", """
SELECT o_custkey, max(o_orderdate) FILTER (o_orderstatus = 'F') AS last_full, max(o_orderdate) FILTER (o_orderstatus = 'O') AS last_diff,
       max(o_orderdate) FILTER (o_orderstatus = 'P') AS last_log FROM orders GROUP BY 1""")
def _(t):
    kinds = {"F": "last_full", "O": "last_diff", "P": "last_log"}
    return A.last_by_kind(t.orders, "o_custkey", "o_orderstatus", "o_orderdate", kinds)


@query("d6_having", """
SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 HAVING count(*) > 10""")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 10")


@query("d7_distinct", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def _(t):
    return t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query("d8_weighted_avg", """
SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_quantity AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS price
FROM lineitem GROUP BY 1""")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        weighted_avg(money("l_extendedprice"), F.col("l_quantity").cast("bigint")).alias("price"))


@query("d9_avg_of_avg", """
SELECT p_brand, CAST(sum(CAST(floor(a * 100 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) AS mean_cents
FROM (SELECT l_partkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS a FROM lineitem GROUP BY 1)
JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def _(t):
    # Each part counts once, whatever its number of lines; the weighted form is d8.
    per_part = t.lineitem.groupBy("l_partkey").agg((F.sum(money("l_extendedprice")).cast("double") / F.count(F.lit(1))).alias("a"))
    cents = F.floor(F.col("a") * 100 + 0.5)
    return (per_part.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
            .groupBy("p_brand").agg(F.avg(cents).alias("mean_cents")))


@query("d10_share_of_total", """
SELECT user_id, n, 100.0 * CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS share_pct
FROM (SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1)""")
def _(t):
    return A.share_of_total(t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "n")


@query("d11_ordered_text", """
SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ', ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts
FROM lineitem GROUP BY 1""")
def _(t):
    return A.joined_text(t.lineitem, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"],
                         F.col("l_partkey").cast("string"), "parts", block="l_linenumber")


@query("d11_ordered_text_blocks", """
SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS trail FROM events GROUP BY 1""")
def _(t):
    ev = t.events.withColumn("slice", time_block("ts"))
    return A.joined_text(ev, "user_id", ["ts", "event_id"], "event_type", "trail", ",", block="slice")


@query("d11_text_chunks", """
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY slice) AS chunk_no, trail FROM (
SELECT user_id, CAST(ts AS DATE) AS slice, string_agg(event_type, ',' ORDER BY ts, event_id) AS trail FROM events GROUP BY 1, 2)""")
def _(t):
    ev = t.events.withColumn("slice", F.col("ts").cast("date"))
    return A.text_chunks(ev, "user_id", ["ts", "event_id"], "event_type", "slice", "trail", ",")


@query("d12_latest_instance", """
SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""")
def _(t):
    return latest_per_key(t.orders, "o_custkey", "o_orderkey", ["o_orderkey", "o_orderstatus"])


@query("d13_pivot", """
SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'click') AS DOUBLE) AS click,
       CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'purchase') AS DOUBLE) AS purchase FROM events GROUP BY 1""")
def _(t):
    return A.pivot(t.events, "user_id", "event_type", ["click", "purchase"], F.sum(money("value")).cast("double"))


@query("d14_row_extremes", """
SELECT l_orderkey, l_partkey, greatest(l_quantity, l_discount * 100, l_tax * 100) AS high, least(l_quantity, 8) AS low FROM lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_partkey",
                             F.greatest("l_quantity", F.col("l_discount") * 100, F.col("l_tax") * 100).alias("high"),
                             F.least("l_quantity", F.lit(8.0)).alias("low"))


@query("d15_wide_sums", """
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 1048576.0 AS mb FROM lineitem GROUP BY 1""")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"),
                                                  (F.sum(money("l_extendedprice")).cast("double") / 1048576.0).alias("mb"))
