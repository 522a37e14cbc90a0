"""Group A: scans, sources and sinks."""

import os
import uuid
from datetime import datetime

from pyspark.sql import functions as F

from ..functions.scalars import int_div
from ..functions.xml import explode_events
from ..session import checkpoint_dir
from ..sources import history
from ..sources import tables as src
from .fixtures import money
from .registry import query


def scratch(t, name: str) -> str:
    """A new folder beside the checkpoints, on storage every executor can reach."""
    return os.path.join(checkpoint_dir(t.spark), f"{name}-{uuid.uuid4().hex}")


@query("a1_snapshot_scan", """
SELECT event_id, ts, user_id FROM events WHERE event_type = 'error'""")
def _(t):
    return src.scan(t.spark, f"{t.dir}/events.parquet", ["event_id", "ts", "user_id"],
                    batch="error", batch_col="event_type")


@query("a2_csv_load", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    path = scratch(t, "customer-csv")
    t.customer.write.option("header", True).csv(path)
    return src.load_csv(t.spark, path, t.customer.schema)


@query("a3_xml_event_files", """
SELECT event_type, ts, CAST(value AS VARCHAR) AS duration, CAST(user_id AS BIGINT) AS session_id FROM events""")
def _(t):
    path = scratch(t, "events-xml")
    value = lambda c: F.array(F.struct(F.lit("duration").alias("_name"), c.alias("value")))
    rows = t.events.select(
        F.col("event_type").alias("_name"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("_timestamp"),
        value(F.col("value").cast("string")).alias("data"),
        F.array(F.struct(F.lit("session_id").alias("_name"), F.col("user_id").cast("string").alias("value"))).alias("action"))
    rows.write.format("xml").option("rootTag", "events").option("rowTag", "event").save(path)
    doc = src.read_xml_events(t.spark, path)
    return doc.select(F.col("_name").alias("event_type"), F.col("_timestamp").cast("timestamp_ntz").alias("ts"),
                      F.col("data")[0]["value"].alias("duration"),
                      F.col("action")[0]["value"].cast("bigint").alias("session_id"))


@query("a4_ring_buffer", """
SELECT event_id // 500 AS buffer, event_type, ts, value FROM events""")
def _(t):
    # A ring buffer holds a bounded number of events: 500 here.
    docs = (t.events_xml().groupBy(int_div("event_id", 500).alias("buffer"))
            .agg(F.concat(F.lit("<RingBufferTarget>"), F.array_join(F.collect_list("event_data"), ""),
                          F.lit("</RingBufferTarget>")).alias("target_data")))
    e = explode_events(docs, "target_data")
    return e.select("buffer", F.col("event._name").alias("event_type"),
                    F.col("event._timestamp").cast("timestamp_ntz").alias("ts"),
                    F.filter("event.data", lambda d: d["_name"] == "duration")[0]["value"].cast("double").alias("value"))


@query("a5_log_search", """
SELECT line AS value, CAST(count(*) AS BIGINT) AS hits
FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
WHERE contains(lower(line), 'license') GROUP BY 1""")
def _(t):
    path = scratch(t, "log")
    english = F.col("lang") == "en"
    for generation, rows in enumerate((t.documents.where(english), t.documents.where(~english))):
        rows.select(F.replace("text", F.lit("\r"), F.lit("")).alias("value")).write.text(f"{path}/{generation}")
    lines = src.read_logs(t.spark, [f"{path}/0", f"{path}/1"], "license")
    return lines.groupBy("value").agg(F.count(F.lit(1)).alias("hits"))


@query("a6_save_as", """
SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1""")
def _(t):
    grouped = t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return src.save_as(grouped, scratch(t, "status"))


@query("a7_append_to", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    path = scratch(t, "orders")
    early = F.col("o_orderdate") < F.lit("1998-07-01").cast("timestamp_ntz")
    src.append_to(t.orders.where(early).select("o_orderkey", "o_totalprice"), path)
    return src.append_to(t.orders.where(~early).select("o_totalprice", "o_orderkey"), path)


@query("a7_history", """
SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM events JOIN orders ON o_custkey = user_id WHERE ts > TIMESTAMP '2024-01-20 12:00:00' AND o_orderdate > TIMESTAMP '1998-01-01' GROUP BY 1""")
def _(t):
    # Two histories of as many buckets: filters on time prune days, the join and the grouping need no shuffle.
    base = history.history_database(t.spark, f"history_{uuid.uuid4().hex}")
    noon = F.lit("2024-01-16 12:00:00").cast("timestamp_ntz")
    for part in (F.col("ts") < noon, F.col("ts") >= noon):
        events = history.append_history(t.events.where(part), f"{base}.events", "ts", "user_id", 8)
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("user_id"), "o_orderdate", "o_totalprice")
    orders = history.append_history(orders, f"{base}.orders", "o_orderdate", "user_id", 8, "year")
    late = history.since(events, "ts", datetime(2024, 1, 20, 12)).select("user_id")
    new = history.since(orders, "o_orderdate", datetime(1998, 1, 1), "year").select("user_id", "o_totalprice")
    return late.join(new, "user_id").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(money("o_totalprice")).cast("double").alias("total"))


@query("a8_stage", """
SELECT c_mktsegment, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM customer GROUP BY 1""")
def _(t):
    src.stage(t.customer.select("c_mktsegment", money("c_acctbal").alias("b")), "staged_customer")
    src.stage(t.customer.select("c_custkey"), "staged_keys", "global")
    return t.spark.sql("select c_mktsegment, cast(sum(b) as double) as balance from staged_customer group by 1")


@query("a9_inline_values", """
SELECT o_orderkey, label FROM orders JOIN (VALUES ('F', 'Full'), ('O', 'Differential'), ('P', 'Log')) v(code, label)
ON o_orderstatus = code""")
def _(t):
    codes = src.values_df(t.spark, [("F", "Full"), ("O", "Differential"), ("P", "Log")], "code string, label string")
    return t.orders.join(codes, F.col("o_orderstatus") == F.col("code")).select("o_orderkey", "label")
