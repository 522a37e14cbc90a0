"""Group J: functions, views and table changes."""

from pyspark.sql import functions as F

from ..functions.scalars import rules
from ..operators import sets as S
from ..operators.aggregates import sum_if
from ..plans.counters import wait_category_stats
from .fixtures import money, orders_as_of
from .registry import query


@query("j1_scalar_function", """
SELECT o_orderkey, CAST(floor((20010615 - CAST(strftime(o_orderdate, '%Y%m%d') AS INT)) / 10000.0) AS BIGINT) AS years FROM orders
WHERE floor((20010615 - CAST(strftime(o_orderdate, '%Y%m%d') AS INT)) / 10000.0) > 3""")
def _(t):
    # As a SQL function, usable in SELECT and WHERE; its body is inlined into the plan.
    t.spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION completed_years(born TIMESTAMP_NTZ, as_of TIMESTAMP_NTZ) RETURNS BIGINT
        RETURN year(as_of) - year(born) - CASE WHEN month(born) * 100 + day(born) > month(as_of) * 100 + day(as_of) THEN 1 ELSE 0 END""")
    years = F.expr("completed_years(o_orderdate, timestamp_ntz'2001-06-15')")
    return t.orders.where(years > 3).select("o_orderkey", years.alias("years"))


@query("j2_table_function", """
SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'""")
def _(t):
    # A parameterised view; its body is inlined, so the argument reaches the scan as a filter.
    t.orders.createOrReplaceTempView("j2_orders")
    t.spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION orders_of_priority(priority STRING)
        RETURNS TABLE (o_orderkey BIGINT, o_custkey BIGINT, o_orderpriority STRING)
        RETURN SELECT o_orderkey, o_custkey, o_orderpriority FROM j2_orders WHERE o_orderpriority = priority""")
    return t.spark.sql("SELECT * FROM orders_of_priority('1-URGENT')")


@query("j2_lateral_function", """
SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey
WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'O'""")
def _(t):
    # Called once per row of another table; Spark turns the lateral call into an equality join.
    t.orders.createOrReplaceTempView("j2_orders")
    t.customer.createOrReplaceTempView("j2_customer")
    t.spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION orders_of_customer(customer BIGINT, status STRING)
        RETURNS TABLE (o_orderkey BIGINT, o_totalprice DOUBLE)
        RETURN SELECT o_orderkey, o_totalprice FROM j2_orders WHERE o_custkey = customer AND o_orderstatus = status""")
    return t.spark.sql("""SELECT c_custkey, o_orderkey, o_totalprice FROM j2_customer, LATERAL orders_of_customer(c_custkey, 'O')
        WHERE c_mktsegment = 'BUILDING'""")


@query("j3_multi_statement_function", """
SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) > 10 THEN 'many' ELSE 'few' END AS size FROM orders
WHERE o_orderstatus <> 'P' GROUP BY 1""")
def _(t):
    # The statements of the body become functions that call one another: pick, count, label.
    t.orders.createOrReplaceTempView("j3_orders")
    for part in ("""kept_orders(dropped STRING) RETURNS TABLE (o_custkey BIGINT)
                    RETURN SELECT o_custkey FROM j3_orders WHERE o_orderstatus <> dropped""",
                 """counted_orders(dropped STRING) RETURNS TABLE (o_custkey BIGINT, n BIGINT)
                    RETURN SELECT o_custkey, count(*) FROM kept_orders(dropped) GROUP BY o_custkey""",
                 """sized_customers(dropped STRING, many BIGINT) RETURNS TABLE (o_custkey BIGINT, n BIGINT, size STRING)
                    RETURN SELECT o_custkey, n, CASE WHEN n > many THEN 'many' ELSE 'few' END FROM counted_orders(dropped)"""):
        t.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {part}")
    return t.spark.sql("SELECT * FROM sized_customers('P', 10)")


@query("j4_view", """
SELECT CAST(ts AS DATE) AS runtime, event_type AS wait_category, CAST(count(*) AS BIGINT) AS waiting_tasks_count,
       CAST(sum(CAST(value * 100 AS BIGINT)) AS BIGINT) AS wait_time_ms FROM events WHERE event_type <> 'view' GROUP BY ALL""")
def _(t):
    t.events.createOrReplaceTempView("j4_events")
    t.spark.sql("""CREATE OR REPLACE TEMP VIEW j4_category_stats AS
        SELECT cast(ts AS date) AS runtime, event_type AS wait_category, count(*) AS waiting_tasks_count,
               sum(cast(round(value * 100) AS bigint)) AS wait_time_ms
        FROM j4_events WHERE event_type <> 'view' GROUP BY 1, 2""")
    return t.spark.table("j4_category_stats")


@query("j5_stored_column", """
SELECT event_id, CASE WHEN event_type LIKE 'p%' THEN 'Sales' WHEN event_type LIKE 's%' THEN 'Accounts' ELSE event_type END AS category FROM events""")
def _(t):
    from .scans import scratch
    from ..sources.tables import save_as

    category = rules([(F.col("event_type").like("p%"), "Sales"), (F.col("event_type").like("s%"), "Accounts")], F.col("event_type"))
    return save_as(t.events.select("event_id", category.alias("category")), scratch(t, "category"))


@query("j6_update_from", """
SELECT c_custkey, coalesce(spent, c_acctbal) AS c_acctbal FROM customer LEFT JOIN
(SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey""")
def _(t):
    spent = (t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey"))
             .agg(F.sum(money("o_totalprice")).cast("double").alias("spent")))
    return S.update_from(t.customer.select("c_custkey", "c_acctbal"), spent, "c_custkey", {"c_acctbal": "spent"})


@query("j7_audit_inserts", """
SELECT o_orderkey, 'New order with Id = ' || o_orderkey || ' is added at 2001-12-31 00:00:00' AS message FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-07-01'""")
def _(t):
    old = t.orders.where(F.col("o_orderdate") < F.lit("1998-07-01").cast("timestamp_ntz"))
    return S.audit_inserts(old, t.orders, "o_orderkey", orders_as_of(), what="order")
