"""Group B: projections, filters and predicates."""

from pyspark.sql import functions as F

from ..functions.scalars import band, decode, has_flag, like, optional_match, since
from ..operators.filters import filter_sessions
from ..operators.joins import exists, not_exists, not_in, with_key_aggregate
from .fixtures import events_as_of, money
from .registry import query


@query("b1_project", """
SELECT l_orderkey, l_partkey, l_extendedprice * (1 - l_discount) AS net,
       l_quantity * 8.0 / 1024 AS qty_mb, l_returnflag || '-' || l_linestatus AS state FROM lineitem""")
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_partkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        (F.col("l_quantity") * 8.0 / 1024).alias("qty_mb"),
        F.concat("l_returnflag", F.lit("-"), "l_linestatus").alias("state"))


@query("b2_band", """
SELECT l_orderkey, l_partkey, CASE WHEN l_extendedprice / l_quantity < 500 THEN 'Excellent'
  WHEN l_extendedprice / l_quantity < 1000 THEN 'Good' WHEN l_extendedprice / l_quantity < 2000 THEN 'Acceptable'
  WHEN l_extendedprice / l_quantity < 5000 THEN '* Slow *' ELSE '*** VERY SLOW ***' END AS label FROM lineitem""")
def _(t):
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    steps = [(500, "Excellent"), (1000, "Good"), (2000, "Acceptable"), (5000, "* Slow *")]
    return t.lineitem.select("l_orderkey", "l_partkey", band(unit, steps, "*** VERY SLOW ***").alias("label"))


@query("b3_decode", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Full' WHEN 'O' THEN 'Differential' ELSE 'Custom' END AS kind
FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", decode("o_orderstatus", {"F": "Full", "O": "Differential"}, "Custom").alias("kind"))


@query("b4_like", r"""
SELECT p_partkey, p_name LIKE 'red%' AS starts, p_name LIKE '%ring' AS ends, p_name LIKE '%i_g%' AS holds,
       lower(p_type) LIKE 'eco%' AS any_case, p_brand LIKE 'Brand\#1_' ESCAPE '\' AS escaped FROM part""".replace(r"\#", "#"))
def _(t):
    return t.part.select(
        "p_partkey", like("p_name", "red%").alias("starts"), like("p_name", "%ring").alias("ends"),
        like("p_name", "%i_g%").alias("holds"), like("p_type", "ECO%", ignore_case=True).alias("any_case"),
        like("p_brand", "Brand#1_").alias("escaped"))


@query("b5_in_list", """
SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS urgent FROM orders
WHERE o_orderstatus NOT IN ('P')""")
def _(t):
    return (t.orders.where(~F.col("o_orderstatus").isin("P"))
            .select("o_orderkey", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("urgent")))


@query("b6_time_window", """
SELECT event_id, ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' AS inside FROM events
WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 480 HOUR""")
def _(t):
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return (t.events.where(since("ts", 480, "hour", events_as_of()))
            .select("event_id", F.col("ts").between(day("2024-01-10"), day("2024-01-12")).alias("inside")))


@query("b7_optional_filter", """
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'""")
def _(t):
    return (t.orders.where(optional_match("o_orderstatus", "F")).where(optional_match("o_orderpriority", ""))
            .select("o_orderkey"))


@query("b8_session_filter", """
SELECT c_custkey, c_name FROM customer WHERE c_mktsegment LIKE 'M%' AND NOT c_name LIKE '%7'""")
def _(t):
    columns = {"session": "c_custkey", "program": "c_mktsegment", "login": "c_name"}
    return (filter_sessions(t.customer, "program", "M%", "login", "%7", columns=columns)
            .select("c_custkey", "c_name"))


@query("b9_bit_flag", """
SELECT l_orderkey, l_linenumber, (l_linenumber & 2) = 2 AS monday, (l_linenumber & 5) = 5 AS both FROM lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", has_flag("l_linenumber", 2).alias("monday"),
                             has_flag("l_linenumber", 5).alias("both"))


@query("b10_exists", """
SELECT o_orderkey, true AS has_lines FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
UNION ALL
SELECT o_orderkey, false FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def _(t):
    on = F.col("o_orderkey") == F.col("l_orderkey")
    yes = exists(t.orders, t.lineitem, on).select("o_orderkey", F.lit(True).alias("has_lines"))
    no = not_exists(t.orders, t.lineitem, on).select("o_orderkey", F.lit(False).alias("has_lines"))
    return yes.unionByName(no)


@query("b11_in_subquery", """
SELECT doc_id, 'labelled' AS state FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'unlabelled' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(t):
    hit = exists(t.documents, t.labels, "doc_id").select("doc_id", F.lit("labelled").alias("state"))
    miss = not_in(t.documents, "doc_id", t.labels, "doc_id").select("doc_id", F.lit("unlabelled").alias("state"))
    return hit.unionByName(miss)


@query("b12_correlated_aggregate", """
SELECT c_custkey, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS last_order,
       (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders WHERE o_custkey = c_custkey) AS spent
FROM customer""")
def _(t):
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    out = with_key_aggregate(t.customer, orders, "c_custkey", F.max("o_orderdate").alias("last_order"),
                             F.sum(money("o_totalprice")).cast("double").alias("spent"))
    return out.select("c_custkey", "last_order", "spent")


@query("b13_derived_table", """
WITH counts AS (SELECT c_mktsegment, o_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS customers, CAST(max(n) AS BIGINT) AS most FROM counts WHERE n >= 2 GROUP BY 1""")
def _(t):
    counts = (t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
              .join(t.customer, F.col("o_custkey") == F.col("c_custkey")))
    return (counts.where("n >= 2").groupBy("c_mktsegment")
            .agg(F.count(F.lit(1)).alias("customers"), F.max("n").alias("most")))
