"""Group E: window functions."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import instant_micros, pct, safe_div
from ..operators.aggregates import share_of_total
from ..operators.ranking import first_per_key
from ..operators.windows import BLOCK, key_totals, neighbour, numbered, range_blocks, ranked, running, time_block
from ..plans.counters import pair_passes
from .fixtures import COUNTERS_SQL, money
from .registry import query


def daily(t):
    return t.events.withColumn("day", F.col("ts").cast("date")).withColumn("slice", time_block("ts"))


@query("e1_row_number", """
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS of_user,
       row_number() OVER (ORDER BY ts, event_id) AS of_all FROM events""")
def _(t):
    one = numbered(daily(t), "user_id", ["ts", "event_id"], "slice", "of_user")
    return numbered(one, [], ["ts", "event_id"], "slice", "of_all").select("event_id", "of_user", "of_all")


@query("e2_rank", """
SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY date_trunc('month', o_orderdate) DESC) AS rank FROM orders""")
def _(t):
    orders = t.orders.select("o_orderkey", "o_orderpriority", F.trunc("o_orderdate", "month").alias("m"),
                             F.year("o_orderdate").alias("y"))
    return ranked(orders, "o_orderpriority", "m", descending=True, block="y").select("o_orderkey", "rank")


@query("e3_dense_rank", """
SELECT o_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate)) AS place,
       dense_rank() OVER (ORDER BY o_orderdate) AS day_no FROM orders""")
def _(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", F.year("o_orderdate").alias("y"))
    out = ranked(orders, "o_custkey", "y", rank=None, dense="place")
    return ranked(out, [], "o_orderdate", block="y", rank=None, dense="day_no").select("o_orderkey", "place", "day_no")


@query("e4_lag", """
SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous_order FROM orders""")
def _(t):
    # Ranges over key and order: a busy key takes as many as its rows need.
    orders = range_blocks(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey")
    return (neighbour(orders, "o_custkey", ["o_orderdate", "o_orderkey"], BLOCK, {"previous_order": "o_orderkey"})
            .select("o_orderkey", "previous_order"))


@query("e5_lead_rate", """
SELECT event_id, CASE WHEN gap <> 0 THEN (nv - value) / CAST(gap AS DOUBLE) END AS per_us FROM (
SELECT event_id, value, lead(value) OVER w AS nv, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def _(t):
    out = neighbour(daily(t), "user_id", ["ts", "event_id"], "slice", {"nv": "value", "nts": "ts"}, step="lead")
    gap = instant_micros("nts") - instant_micros("ts")
    return out.select("event_id", safe_div(F.col("nv") - F.col("value"), gap).alias("per_us"))


@query("e6_grand_share", """
SELECT event_id, 100.0 * value / (SELECT CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) FROM events) AS share_pct FROM events""")
def _(t):
    total = t.events.agg(F.sum(money("value")).cast("double")).scalar()
    return t.events.select("event_id", (100.0 * F.col("value") / total).alias("share_pct"))


@query("e7_partition_totals", """
SELECT p_partkey, CAST(count(*) OVER (PARTITION BY p_brand) AS BIGINT) AS of_brand,
       CAST(sum(p_size) OVER (PARTITION BY p_brand, p_type) AS BIGINT) AS size_of_type FROM part""")
def _(t):
    out = key_totals(t.part, "p_brand", {"of_brand": F.count(F.lit(1))})
    return (key_totals(out, ["p_brand", "p_type"], {"size_of_type": F.sum("p_size").cast("bigint")})
            .select("p_partkey", "of_brand", "size_of_type"))


@query("e8_cumulative_share", """
SELECT user_id, CAST(sum(v) OVER (ORDER BY v DESC, user_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_value,
       100.0 * CAST(sum(v) OVER (ORDER BY v DESC, user_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(v) OVER () AS DOUBLE) AS running_pct
FROM (SELECT user_id, sum(CAST(value AS DECIMAL(18,2))) AS v FROM events GROUP BY 1)""")
def _(t):
    totals = t.events.groupBy("user_id").agg(F.sum(money("value")).alias("v"))
    order = [F.desc("v"), F.asc("user_id")]
    rows = range_blocks(totals, *order)
    out = running(rows, [], order, BLOCK, {"running_value": "v"})
    total = rows.agg(F.sum("v").cast("double")).scalar()
    return out.select("user_id", F.col("running_value").cast("double").alias("running_value"),
                      pct("running_value", total).alias("running_pct"))


PASSES_SQL = f"""
SELECT counter, -1 AS pass, tasks, wait_ms FROM ({COUNTERS_SQL}) WHERE batch = DATE '2024-01-10'
UNION ALL SELECT counter, 1, tasks, wait_ms FROM ({COUNTERS_SQL}) WHERE batch = DATE '2024-01-20'"""


@query("e9_pair_passes", f"""
SELECT counter, max(tasks * pass) + min(tasks * pass) AS tasks_delta, max(wait_ms * pass) + min(wait_ms * pass) AS wait_ms_delta
FROM ({PASSES_SQL}) GROUP BY 1 HAVING count(*) = 2""")
def _(t):
    counters = t.daily_counters()
    mark = F.when(F.col("batch") == F.lit("2024-01-10"), -1).when(F.col("batch") == F.lit("2024-01-20"), 1)
    passes = counters.withColumn("pass", mark).where("pass is not null")
    return pair_passes(passes, "counter", "pass", ["tasks", "wait_ms"])


@query("e10_first_row", """
SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1""")
def _(t):
    return first_per_key(t.events, "user_id", [F.desc("value"), "event_id"]).select("user_id", "event_id", "event_type")


@query("e11_delta_share", f"""
WITH c AS ({COUNTERS_SQL}), d AS (SELECT b.counter, b.wait_ms - a.wait_ms AS delta FROM c b JOIN c a USING (counter)
WHERE a.batch = DATE '2024-01-10' AND b.batch = DATE '2024-01-20')
SELECT counter, delta, 100.0 * CAST(delta AS DOUBLE) / CAST(sum(delta) OVER () AS DOUBLE) AS share_pct FROM d""")
def _(t):
    c = t.daily_counters()
    a = c.where("batch = date'2024-01-10'").select("counter", F.col("wait_ms").alias("base"))
    d = c.where("batch = date'2024-01-20'").join(a, "counter").select("counter", (F.col("wait_ms") - F.col("base")).alias("delta"))
    return share_of_total(d, "delta")


@query("e12_default_frames", """
SELECT event_id, CAST(count(*) OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE)) AS BIGINT) AS up_to_day,
       CAST(count(*) OVER (PARTITION BY event_type) AS BIGINT) AS of_type FROM events""")
def _(t):
    # With an order the frame ends at the last row of the same order value; without, at the last row.
    per_day = daily(t).groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("event_type")
    frames = per_day.select("event_type", "day",
                            F.sum("n").over(w.orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)).alias("up_to_day"),
                            F.sum("n").over(w).alias("of_type"))
    return daily(t).join(frames, ["event_type", "day"]).select("event_id", "up_to_day", "of_type")
