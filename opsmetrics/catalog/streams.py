"""Group I: incremental and streaming forms. Streams read files and drain what is there."""

import datetime
import uuid

from pyspark.sql import functions as F

from ..operators import sets as S
from ..operators.windows import time_block
from ..plans.counters import counter_delta
from ..sources import history
from ..streaming import marks as MK
from ..streaming import snapshots as ST
from .fixtures import COUNTERS_SQL, EVENTS_SPLIT, events_as_of, money
from .registry import query


def arrivals(t, days: int = 16, closing: str | None = None):
    """The events in the order of their arrival, ``days`` at a time, as (folder, stream): one item for each arrival.

    With ``closing``, a row so long after the newest event comes with the last arrival.
    """
    path, day = ST.scratch(t.spark, "arrivals"), F.col("ts").cast("date")
    low, high = t.events.agg(F.min(day), F.max(day)).first()
    t.events.limit(0).write.parquet(path)
    if low is None:
        yield path, arrived(t, path)
    while low is not None and low <= high:
        until = low + datetime.timedelta(days=days)
        t.events.where((day >= F.lit(low)) & (day < F.lit(until))).write.mode("append").parquet(path)
        low = until
        if closing and low > high:
            ST.close_stream(t.events, path, "ts", closing)
        yield path, arrived(t, path)


def arrived(t, path):
    return ST.read_snapshots(t.spark, path, t.events.schema).withColumn("at", F.col("ts").cast("timestamp"))


def settled(t, make, name, closing):
    """Results of an aggregating stream, given out once the watermark has passed them; a closing row settles the last ones."""
    out = ST.scratch(t.spark, name)
    for _, stream in arrivals(t, closing=closing):
        kept = ST.run_once(make(stream), out)
    return kept


@query("i1_append_snapshot", """
SELECT event_id, user_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS runtime FROM events""")
def _(t):
    out = ST.scratch(t.spark, "snapshots")
    for _, stream in arrivals(t):
        kept = ST.append_snapshot(stream.select("event_id", "user_id", "ts"), out, F.date_trunc("hour", "ts"))
    return kept.select("event_id", "user_id", "runtime")


@query("i2_high_water_mark", """
SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-16')""")
def _(t):
    stored = t.events.where(F.col("ts") < F.expr(EVENTS_SPLIT))
    return ST.load_new(t.events, stored, "ts").select("event_id", "ts")


@query("i3_record_overlap", "SELECT event_id, user_id FROM events")
def _(t):
    # Two runs; of the last records before the first mark, every other one is visible only to the second run.
    cut = t.events.agg(F.percentile_approx("event_id", 0.5)).first()[0] or 0
    out, marks = ST.scratch(t.spark, "records"), ST.scratch(t.spark, "marks")
    records, at = t.events.select("event_id", "user_id"), F.col("event_id")
    hidden = (at > cut - 5) & (at % 2 != cut % 2)
    for version, visible in enumerate([records.where((at <= cut) & ~hidden), records]):
        MK.load_increment(visible, out, marks, "last_event", "event_id", version)
    return t.spark.read.schema(records.schema).parquet(f"{out}/*")


@query("i4_two_sample_delta", f"""
WITH c AS ({COUNTERS_SQL})
SELECT b.counter, b.tasks - coalesce(a.tasks, 0) AS tasks, b.wait_ms - coalesce(a.wait_ms, 0) AS wait_ms
FROM c b LEFT JOIN c a ON a.counter = b.counter AND a.batch = DATE '2024-01-10' WHERE b.batch = DATE '2024-01-20'""")
def _(t):
    c = t.daily_counters()
    at = lambda d: c.where(F.col("batch") == F.lit(d).cast("date")).drop("batch")
    return counter_delta(at("2024-01-10"), at("2024-01-20"), "counter", ["tasks", "wait_ms"])


@query("i5_latest_delta", f"""
WITH c AS ({COUNTERS_SQL})
SELECT counter, batch, wait_ms - lag(wait_ms) OVER (PARTITION BY counter ORDER BY batch) AS delta FROM c
QUALIFY lag(wait_ms) OVER (PARTITION BY counter ORDER BY batch) IS NOT NULL""")
def _(t):
    path = ST.scratch(t.spark, "counters")
    counters = t.daily_counters()
    days = ["2024-01-01", "2024-01-11", "2024-01-21", "2025-01-01"]
    for low, high in zip(days, days[1:]):  # three arrivals, oldest first
        counters.where((F.col("batch") >= low) & (F.col("batch") < high)).write.mode("append").parquet(path)
    stream = ST.read_snapshots(t.spark, path, "counter string, batch date, tasks bigint, wait_ms bigint", files_per_batch=1)
    out = ST.sample_deltas(stream, ST.scratch(t.spark, "deltas"), "counter", "batch", "wait_ms", F.trunc("batch", "week"))
    return out.select("counter", F.col("at").alias("batch"), "delta")


@query("i6_interval_rates", """
SELECT event_id, CASE WHEN gap <> 0 THEN (nv - value) / (CAST(gap AS DOUBLE) / 1e6) END AS per_second FROM (
SELECT event_id, value, lead(value) OVER w AS nv, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE nv IS NOT NULL""")
def _(t):
    ev = t.events.withColumn("slice", time_block("ts"))
    return ST.interval_rates(ev, "user_id", "ts", "value", "slice").select("event_id", "per_second")


@query("i7_event_filter", """
SELECT event_id, event_type, value FROM events WHERE value > 300 OR event_type = 'error'""")
def _(t):
    rules = [F.col("value") > 300, F.col("event_type") == "error"]
    out = ST.scratch(t.spark, "filtered")
    for _, stream in arrivals(t):
        kept = ST.run_once(ST.event_filter(stream, rules).select("event_id", "event_type", "value"), out)
    return kept


@query("i8_retention", """
SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 20 DAY""")
def _(t):
    return S.retain(t.events, "ts", 20, events_as_of()).select("event_id", "ts")


@query("i8_retention_history", """
SELECT event_id, ts, user_id FROM events WHERE ts > TIMESTAMP '2024-01-11 06:00:00'""")
def _(t):
    # Days before the border go as partitions, the border's day is written anew.
    table = f"{history.history_database(t.spark, f'history_{uuid.uuid4().hex}')}.events"
    history.append_history(t.events, table, "ts", "user_id", 8)
    kept = history.retain_history(t.spark, table, "ts", 20, datetime.datetime(2024, 1, 31, 6))
    return kept.select("event_id", "ts", "user_id")


@query("i9_tumbling", """
SELECT event_type, time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL""")
def _(t):
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(money("value")).cast("double").alias("total")]
    out = settled(t, lambda stream: ST.tumbling(stream, "at", "10 minutes", "event_type", aggs), "tumbling", "2 hours")
    return out.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "total")


@query("i10_trailing", """
SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 240 HOUR GROUP BY 1""")
def _(t):
    return S.trailing(t.events, "ts", 240, "hour", events_as_of()).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("i10_sliding", """
SELECT w AS window_start, CAST(count(*) AS BIGINT) AS n FROM (
SELECT unnest(generate_series(date_trunc('day', ts) - INTERVAL 2 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS w FROM events) GROUP BY 1""")
def _(t):
    count = [F.count(F.lit(1)).alias("n")]
    out = settled(t, lambda stream: ST.sliding(stream, "at", "3 days", "1 day", [], count), "sliding", "4 days")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("i11_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, CAST(count(*) AS BIGINT) AS events FROM s GROUP BY user_id, no""")
def _(t):
    return ST.activity_sessions(t.events, "user_id", "ts", "6 hours", id_col="event_id")


@query("i11_session_stream", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, min(ts) AS session_start, CAST(count(*) AS BIGINT) AS events FROM s GROUP BY user_id, no""")
def _(t):
    out = settled(t, lambda stream: ST.activity_sessions(stream, "user_id", "at", "6 hours"), "sessions", "8 hours")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "events")


@query("i12_unseen_only", """
SELECT event_id, ts, false AS late FROM events
UNION ALL SELECT event_id, ts, true FROM events WHERE ts < (SELECT date_trunc('day', min(ts)) + INTERVAL 2 DAY FROM events)""")
def _(t):
    # After the last arrival, rows of the last hours come again, and rows of the first two days far too late.
    out = ST.scratch(t.spark, "unseen")
    for path, stream in arrivals(t):
        MK.split_late(stream.drop("at"), out, "ts", "1 day", "event_id")
    first, last = t.events.agg(F.min("ts")).scalar(), t.events.agg(F.max("ts")).scalar()
    again = (F.col("ts") < F.date_trunc("day", first) + F.expr("interval 2 days")) | (F.col("ts") >= last - F.expr("interval 6 hours"))
    t.events.where(again).write.mode("append").parquet(path)
    kept, late = MK.split_late(arrived(t, path).drop("at"), out, "ts", "1 day", "event_id")
    return (kept.withColumn("late", F.lit(False)).union(late.withColumn("late", F.lit(True)))).select("event_id", "ts", "late")
