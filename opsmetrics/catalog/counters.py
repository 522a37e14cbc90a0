"""Group K.1: waits, CPU, IO and resources."""

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.scalars import int_div
from ..plans import counters as C
from .fixtures import (CAPTURES, USER_SNAPSHOTS_SQL, USER_WAITS_SQL, _WAIT_NAME_SQL, events_as_of, fx, money, wait_name)
from .registry import query

IGNORE = ["WAITFOR", "DIRTY_PAGE_POLL"]
IGNORE_SQL = "('WAITFOR', 'DIRTY_PAGE_POLL')"
DAY = "CAST(value * 100 AS BIGINT)"


def guidance_sql(col="wait_type"):
    return ("CASE " + col + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.WAIT_GUIDANCE.items()) + " ELSE '' END")


@query("k1_top_waits", f"""
WITH w AS ({USER_WAITS_SQL}), r AS (SELECT *, sum(wait_time_ms) OVER (ORDER BY wait_time_ms DESC, wait_type ROWS UNBOUNDED PRECEDING) AS ran,
  CAST(sum(wait_time_ms) OVER () AS DOUBLE) AS total FROM w WHERE wait_type NOT IN {IGNORE_SQL})
SELECT wait_type, {fx('100.0 * CAST(wait_time_ms AS DOUBLE) / total', 2)} AS wait_pct, {fx('100.0 * CAST(ran AS DOUBLE) / total', 2)} AS running_pct,
  {fx('wait_time_ms / 1000.0', 2)} AS total_wait_sec, {fx('(wait_time_ms - signal_wait_time_ms) / 1000.0', 2)} AS resource_wait_sec,
  {fx('signal_wait_time_ms / 1000.0', 2)} AS signal_wait_sec, waiting_tasks_count AS wait_count, wait_time_ms // waiting_tasks_count AS avg_wait_ms,
  {guidance_sql()} AS recommendation FROM r WHERE 100.0 * CAST(ran - wait_time_ms AS DOUBLE) / total < 95""")
def _(t):
    return C.top_waits(t.user_waits())


@query("k2_signal_ratio", f"""
SELECT {fx('100.0 * s / w', 2)} AS signal_wait_pct, {fx('100.0 * (w - s) / w', 2)} AS resource_wait_pct,
  CASE WHEN 100.0 * s / w > 20 THEN '{V.SIGNAL_BANDS[0][1]}' WHEN 100.0 * s / w > 10 THEN '{V.SIGNAL_BANDS[1][1]}' ELSE '{V.SIGNAL_OK}' END AS assessment
FROM (SELECT CAST(sum(wait_time_ms) AS DOUBLE) AS w, CAST(sum(signal_wait_time_ms) AS DOUBLE) AS s FROM ({USER_WAITS_SQL}))""")
def _(t):
    return C.signal_ratio(t.user_waits())


@query("k3_wait_totals", f"""
SELECT wait_type, wait_time_ms AS sum_wait_time_ms, {fx('100.0 * wait_time_ms / total', 1)} AS pct_wait_time, waiting_tasks_count AS sum_waiting_tasks,
  {fx('CAST(wait_time_ms AS DOUBLE) / waiting_tasks_count', 1)} AS avg_wait_time_ms
FROM (SELECT *, CAST(sum(wait_time_ms) OVER () AS DOUBLE) AS total FROM ({USER_WAITS_SQL}) WHERE wait_type NOT IN {IGNORE_SQL})
ORDER BY wait_time_ms DESC, wait_type LIMIT 25""")
def _(t):
    ignore = t.spark.createDataFrame([(n,) for n in IGNORE], "wait_type string")
    return C.wait_totals(t.user_waits(), ignore)


def capture(t, i):
    return t.user_snapshots().where(F.col("runtime") == F.lit(CAPTURES[i]).cast("timestamp_ntz")).drop("runtime")


@query("k4_wait_delta", f"""
WITH s AS ({USER_SNAPSHOTS_SQL}), d AS (SELECT b.wait_type, b.wait_time_ms - coalesce(a.wait_time_ms, 0) AS ms, b.waiting_tasks_count - coalesce(a.waiting_tasks_count, 0) AS n,
  b.signal_wait_time_ms - coalesce(a.signal_wait_time_ms, 0) AS s FROM s b LEFT JOIN s a ON a.wait_type = b.wait_type AND a.runtime = TIMESTAMP '{CAPTURES[0]}'
  WHERE b.runtime = TIMESTAMP '{CAPTURES[2]}')
SELECT wait_type, n AS wait_count, {fx('ms / 1000.0', 2)} AS wait_time_sec, {fx('(ms - s) / 1000.0', 2)} AS resource_wait_sec, {fx('s / 1000.0', 2)} AS signal_wait_sec,
  CASE WHEN n = 0 THEN 0 ELSE {fx('CAST(ms AS DOUBLE) / n', 2)} END AS avg_wait_ms FROM d WHERE ms > 0 ORDER BY ms DESC, wait_type LIMIT 20""")
def _(t):
    return C.wait_delta(capture(t, 0), capture(t, 2))


@query("k5_latest_wait_delta", f"""
WITH s AS ({USER_SNAPSHOTS_SQL}), d AS (SELECT b.wait_type, b.wait_time_ms - a.wait_time_ms AS ms, b.waiting_tasks_count - a.waiting_tasks_count AS n
  FROM s b JOIN s a ON a.wait_type = b.wait_type AND a.runtime = TIMESTAMP '{CAPTURES[1]}' WHERE b.runtime = TIMESTAMP '{CAPTURES[2]}')
SELECT TIMESTAMP '{CAPTURES[2]}' AS second_sample_time, CAST(864000 AS BIGINT) AS sample_seconds, wait_type, {fx('ms / 1000.0', 1)} AS wait_time_sec,
  n AS number_of_waits, {fx('CAST(ms AS DOUBLE) / n', 1)} AS avg_ms_per_wait FROM d WHERE n > 0""")
def _(t):
    numbered = t.user_snapshots().withColumn("batch_id", F.array_position(
        F.array(*[F.lit(c).cast("timestamp_ntz") for c in CAPTURES]), F.col("runtime")))
    return C.latest_wait_delta(numbered.withColumnRenamed("runtime", "sample_time"))


@query("k6_wait_category", f"""
SELECT event_id, CASE WHEN w LIKE 'LCK%' THEN 'Locks' WHEN w LIKE 'PAGEIO%' THEN 'Page I/O Latch' WHEN w = 'WAITFOR' THEN 'IGNORABLE' ELSE w END AS category
FROM (SELECT event_id, {_WAIT_NAME_SQL} AS w FROM events)""")
def _(t):
    return t.events.select("event_id", C.wait_category(wait_name()).alias("category"))


@query("k7_category_stats", f"""
SELECT runtime, CASE WHEN wait_type LIKE 'LCK%' THEN 'Locks' WHEN wait_type LIKE 'PAGEIO%' THEN 'Page I/O Latch' ELSE wait_type END AS wait_category,
  CAST(sum(waiting_tasks_count) AS BIGINT) AS waiting_tasks_count, CAST(sum(wait_time_ms) AS BIGINT) AS wait_time_ms, CAST(sum(signal_wait_time_ms) AS BIGINT) AS signal_wait_time_ms,
  max(max_wait_time_ms) AS max_wait_time_ms FROM ({USER_SNAPSHOTS_SQL}) WHERE wait_type <> 'WAITFOR' GROUP BY 1, 2""")
def _(t):
    return C.wait_category_stats(t.user_snapshots().withColumn("wait_category", C.wait_category()))


@query("k8_snap_window", """
SELECT (SELECT max(ts) FROM events WHERE ts <= TIMESTAMP '2024-01-10') AS start_time, (SELECT min(ts) FROM events WHERE ts >= TIMESTAMP '2024-01-20') AS end_time""")
def _(t):
    return C.snap_window(t.events, "ts", "2024-01-10", "2024-01-20")


CATS_SQL = f"""
WITH s AS (SELECT runtime, CASE WHEN wait_type LIKE 'LCK%' THEN 'Locks' WHEN wait_type LIKE 'PAGEIO%' THEN 'Page I/O Latch' ELSE wait_type END AS wait_category,
  sum(wait_time_ms) AS ms FROM ({USER_SNAPSHOTS_SQL}) WHERE wait_type <> 'WAITFOR' GROUP BY 1, 2),
u AS (SELECT CAST(sum(c) // count(*) AS BIGINT) AS avg_cpu FROM (SELECT CAST(floor(value) AS BIGINT) % 100 AS c FROM events
  WHERE ts BETWEEN TIMESTAMP '{CAPTURES[0]}' AND TIMESTAMP '{CAPTURES[2]}')),
c AS (SELECT b.wait_category, CAST(b.ms - coalesce(a.ms, 0) AS BIGINT) AS raw_ms, CAST(1728000 AS BIGINT) AS secs,
  CAST((b.ms - coalesce(a.ms, 0)) // 1728001 AS BIGINT) AS per_sec, CAST(floor(0.01 * CAST(avg_cpu AS DOUBLE) * 3456000 * 1000) AS BIGINT) AS cpu_ms
  FROM s b LEFT JOIN s a ON a.wait_category = b.wait_category AND a.runtime = TIMESTAMP '{CAPTURES[0]}', u WHERE b.runtime = TIMESTAMP '{CAPTURES[2]}'),
l AS (SELECT *, CAST(greatest(raw_ms, 0) AS BIGINT) AS total_ms, row_number() OVER (ORDER BY per_sec DESC, wait_category) AS place,
  CAST(sum(greatest(raw_ms, 0)) OVER () + cpu_ms AS DOUBLE) AS whole FROM c)"""


def cpu_table(t):
    return t.events.select(F.col("event_id").alias("record_id"), F.col("ts").alias("event_time"),
                           (F.floor("value") % 100).alias("sql_cpu_utilization"), F.lit(0).alias("system_idle_cpu"))


@query("k9_top5_categories", f"""{CATS_SQL}
SELECT wait_category, secs AS time_interval_sec, total_ms AS total_wait_time_ms, {fx('100.0 * total_ms / whole', 2)} AS percent_of_total, per_sec AS ms_per_sec
FROM (SELECT * FROM l WHERE (per_sec > 0 OR total_ms > 0) AND wait_category NOT IN ('SOS_SCHEDULER_YIELD', 'DIRTY_PAGE_POLL') ORDER BY per_sec DESC, wait_category LIMIT 5)
WHERE {fx('100.0 * total_ms / whole', 2)} > 0
UNION ALL SELECT 'CPU', secs, total_ms + cpu_ms, 100.0 * (total_ms + cpu_ms) / whole, per_sec + cpu_ms // (secs + 1) FROM l WHERE wait_category = 'SOS_SCHEDULER_YIELD'
UNION ALL SELECT 'Other', max(secs), CAST(sum(total_ms) AS BIGINT), {fx('100.0 * sum(total_ms) / max(whole)', 2)}, CAST(sum(per_sec) AS BIGINT) FROM l
WHERE (per_sec > 0 OR total_ms > 0) AND place > 5""")
def _(t):
    waits = t.user_snapshots().withColumn("wait_category", C.wait_category())
    return C.top5_categories(waits, cpu_table(t), "2024-01-06", "2024-01-26", cpu_count=2)


@query("k10_other_categories", f"""{CATS_SQL}, w AS (SELECT *, CAST(sum(raw_ms) OVER () + cpu_ms AS DOUBLE) AS all_ms FROM l)
SELECT wait_category, secs AS time_interval_sec, raw_ms AS total_wait_time_ms, {fx('100.0 * raw_ms / all_ms', 2)} AS percent_of_total, per_sec AS ms_per_sec
FROM w WHERE (per_sec > 0 OR raw_ms > 0) AND place > 5 AND wait_category <> 'SOS_SCHEDULER_YIELD' ORDER BY per_sec DESC, wait_category LIMIT 10""")
def _(t):
    waits = t.user_snapshots().withColumn("wait_category", C.wait_category())
    return C.other_categories(waits, cpu_table(t), "2024-01-06", "2024-01-26", cpu_count=2)


@query("k11_latch_stats", f"""
SELECT wait_type AS latch_class, waiting_tasks_count AS wait_count, wait_time_ms, {fx('wait_time_ms / 1000.0', 2)} AS wait_time_sec, max_wait_time_ms, '' AS notes
FROM ({USER_WAITS_SQL}) WHERE wait_type <> 'WAITFOR'""")
def _(t):
    latches = (t.user_waits().withColumnRenamed("wait_type", "latch_class")
               .withColumnRenamed("waiting_tasks_count", "waiting_requests_count"))
    return C.latch_stats(latches, skip=("WAITFOR",))


@query("k11_spin_stats", f"""
SELECT wait_type AS name, waiting_tasks_count AS collisions, wait_time_ms AS spins, wait_time_ms // waiting_tasks_count AS spins_per_collision,
  signal_wait_time_ms AS sleep_time, max_wait_time_ms AS backoffs FROM ({USER_WAITS_SQL})""")
def _(t):
    spins = t.user_waits().select(F.col("wait_type").alias("name"), F.col("waiting_tasks_count").alias("collisions"), F.col("wait_time_ms").alias("spins"),
                                  int_div("wait_time_ms", "waiting_tasks_count").alias("spins_per_collision"),
                                  F.col("signal_wait_time_ms").alias("sleep_time"), F.col("max_wait_time_ms").alias("backoffs"))
    return C.spin_stats(spins)


@query("k12_waiting_tasks", """
SELECT o_orderkey AS task_id, o_custkey AS session_id, c_name AS login_name, command, substring(text, CAST(n_chars // 4 + 1 AS INTEGER), CAST(n_chars // 4 + 1 AS INTEGER)) AS current_statement
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT c_custkey AS sid, c_mktsegment AS command FROM customer WHERE c_acctbal > 0) ON sid = o_custkey
LEFT JOIN documents ON doc_id = sid WHERE o_custkey > 50""")
def _(t):
    tasks = t.orders.select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("session_id"))
    sessions = t.customer.select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("login_name"),
                                 F.lit("h").alias("host_name"), F.lit("p").alias("program_name"))
    quarter = int_div("n_chars", 4)
    texts = t.documents.select(F.col("doc_id").alias("sql_handle"), "text", (quarter * 2).alias("s"), (quarter * 4).alias("e"))
    requests = (t.customer.where("c_acctbal > 0").join(texts, F.col("c_custkey") == F.col("sql_handle"), "left")
                .select(F.col("c_custkey").alias("session_id"), F.col("c_mktsegment").alias("command"), F.lit("running").alias("status"),
                        F.lit("db").alias("database_name"), "sql_handle", F.col("s").alias("statement_start_offset"), F.col("e").alias("statement_end_offset")))
    return C.waiting_tasks(tasks, sessions, requests, texts).select("task_id", "session_id", "login_name", "command", "current_statement")


def wait_events(t):
    doc = F.concat(
        F.lit('<event name="wait_info"><data name="wait_type"><value>1</value><text>'), F.col("event_type"), F.lit("</text></data>"),
        F.lit('<data name="duration"><value>'), F.round(F.col("value") * 100).cast("bigint").cast("string"), F.lit("</value></data>"),
        F.lit('<data name="signal_duration"><value>'), F.floor("value").cast("string"), F.lit("</value></data>"),
        F.lit('<data name="completed_count"><value>1</value></data><action name="session_id"><value>'), F.col("user_id").cast("string"),
        F.lit("</value></action></event>"))
    return t.spread(t.events, "event_id").select(doc.alias("event_data"))


@query("k13_event_wait_totals", """
SELECT CAST(user_id AS INTEGER) AS session_id, event_type AS wait_type, CAST(sum(CAST(value * 100 AS BIGINT)) AS BIGINT) AS total_duration_ms,
  CAST(sum(floor(value)) AS BIGINT) AS total_signal_duration_ms, CAST(count(*) AS BIGINT) AS total_wait_count FROM events GROUP BY 1, 2""")
def _(t):
    return C.event_wait_totals(wait_events(t))


@query("k14_cpu_history", """
SELECT event_id AS record_id, CAST(floor(value) AS INTEGER) % 50 AS process_cpu, CAST(user_id AS INTEGER) % 50 AS system_idle,
  100 - CAST(user_id AS INTEGER) % 50 - CAST(floor(value) AS INTEGER) % 50 AS other_cpu, TIMESTAMP '2024-01-31' - to_milliseconds(100000000 - event_id * 977) AS event_time
FROM events ORDER BY event_id DESC LIMIT 256""")
def _(t):
    doc = F.concat(F.lit('<Record id="'), F.col("event_id").cast("string"), F.lit('" type="RING_BUFFER_SCHEDULER_MONITOR"><SchedulerMonitorEvent><SystemHealth><ProcessUtilization>'),
                   (F.floor("value") % 50).cast("string"), F.lit("</ProcessUtilization><SystemIdle>"), (F.col("user_id") % 50).cast("string"),
                   F.lit("</SystemIdle></SystemHealth></SchedulerMonitorEvent></Record>"))
    records = t.events.select(doc.alias("record"), (F.col("event_id") * 977).alias("timestamp"))
    return C.cpu_history(records, F.lit(100000000), events_as_of())


def cpu_stats(t):
    return (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("n_name").alias("database_name"), "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("total_worker_time")))


@query("k15_cpu_by_db", f"""
WITH d AS (SELECT n_name AS database_name, CAST(sum(CAST(o_totalprice * 100 AS BIGINT) // 1000) AS BIGINT) AS cpu_ms
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT row_number() OVER (ORDER BY cpu_ms DESC, database_name) AS cpu_rank, database_name, cpu_ms, {fx('100.0 * cpu_ms / CAST(sum(cpu_ms) OVER () AS DOUBLE)', 2)} AS cpu_ms_pct FROM d""")
def _(t):
    return C.cpu_by_db(cpu_stats(t))


@query("k15_cpu_by_db_delta", f"""
WITH d AS (SELECT n_name AS database_name, CAST(sum(CASE WHEN o_orderdate >= TIMESTAMP '1998-07-01' THEN CAST(o_totalprice * 100 AS BIGINT) END) AS BIGINT) AS cpu
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT database_name, cpu, {fx('100.0 * cpu / CAST(sum(cpu) OVER () AS DOUBLE)', 2)} AS cpu_pct FROM d""")
def _(t):
    stats = cpu_stats(t)
    first = stats.where(F.col("o_orderdate") < F.lit("1998-07-01").cast("timestamp_ntz"))
    return C.cpu_by_db_delta(first, stats).select("database_name", "cpu", "cpu_pct")


@query("k16_io_by_db", f"""
WITH d AS (SELECT n_name AS database_name, sum(CAST(l_extendedprice * 100 AS BIGINT)) AS r, sum(CAST(l_quantity AS BIGINT) * 1000000) AS w
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
m AS (SELECT database_name, CAST((r + w) // 1048576 AS BIGINT) AS total_mb, CAST(r // 1048576 AS BIGINT) AS read_mb, CAST(w // 1048576 AS BIGINT) AS write_mb FROM d)
SELECT row_number() OVER (ORDER BY total_mb DESC, database_name) AS io_rank, *, {fx('100.0 * total_mb / CAST(sum(total_mb) OVER () AS DOUBLE)', 2)} AS total_mb_pct,
  {fx('100.0 * read_mb / CAST(sum(read_mb) OVER () AS DOUBLE)', 2)} AS read_mb_pct, {fx('100.0 * write_mb / CAST(sum(write_mb) OVER () AS DOUBLE)', 2)} AS write_mb_pct FROM m""")
def _(t):
    io = (t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
          .select(F.col("n_name").alias("database_name"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("num_of_bytes_read"),
                  (F.col("l_quantity").cast("bigint") * 1000000).alias("num_of_bytes_written")))
    return C.io_by_db(io)


def resources(t):
    whole = lambda c: F.col(c).cast("double")
    return t.lineitem.select(F.col("l_shipdate").alias("end_time"), whole("l_quantity").alias("avg_cpu_percent"), (F.col("l_linenumber") * 10.0).alias("avg_data_io_percent"),
                             (F.col("l_partkey") % 100).cast("double").alias("avg_log_write_percent"), (F.col("l_suppkey") % 100).cast("double").alias("avg_memory_usage_percent"),
                             F.lit(200).alias("dtu_limit"))


@query("k17_resource_summary", """
SELECT avg(l_quantity) AS avg_cpu_percent, max(l_quantity) AS max_cpu_percent, avg(l_linenumber * 10.0) AS avg_data_io_percent, CAST(max(l_linenumber * 10.0) AS DOUBLE) AS max_data_io_percent,
  avg(l_partkey % 100) AS avg_log_write_percent, CAST(max(l_partkey % 100) AS DOUBLE) AS max_log_write_percent, avg(l_suppkey % 100) AS avg_memory_usage_percent, CAST(max(l_suppkey % 100) AS DOUBLE) AS max_memory_usage_percent
FROM lineitem WHERE l_shipdate BETWEEN (SELECT max(l_shipdate) FROM lineitem WHERE l_shipdate <= TIMESTAMP '1997-01-01') AND (SELECT min(l_shipdate) FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01')""")
def _(t):
    return C.resource_summary(resources(t), "1997-01-01", "1999-01-01")


@query("k17_resource_utilisation", """
SELECT end_time, top AS avg_percent, 200 * (top / 100.0) AS used, 200 AS dtu_limit FROM (SELECT l_shipdate AS end_time, greatest(l_quantity, CAST(l_linenumber * 10 AS DOUBLE), CAST(l_partkey % 100 AS DOUBLE)) AS top FROM lineitem)""")
def _(t):
    return C.resource_utilisation(resources(t))


@query("k18_resource_history", f"""
SELECT 'line_' || l_orderkey || '_' || l_partkey AS resource_name, l_shipdate AS end_time, {fx('r / 1048576.0', 2)} AS mb_read, {fx('100.0 * r / CAST(r + w AS DOUBLE)', 2)} AS read_pct, {fx('w / 1048576.0', 2)} AS mb_written,
  {fx('100.0 * w / CAST(r + w AS DOUBLE)', 2)} AS write_pct, {fx('(r + w) / 1048576.0', 2)} AS mb_total
FROM (SELECT *, CAST(l_extendedprice * 100 AS BIGINT) AS r, CAST(l_quantity AS BIGINT) * 100000 AS w FROM lineitem) ORDER BY end_time DESC, resource_name LIMIT 250""")
def _(t):
    rows = t.lineitem.select(F.concat(F.lit("line_"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_partkey").cast("string")).alias("resource_name"),
                             F.col("l_shipdate").alias("end_time"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("io_bytes_read"),
                             (F.col("l_quantity").cast("bigint") * 100000).alias("io_bytes_written"))
    return C.resource_history(rows)


@query("k19_key_counters", """
SELECT rtrim(c) AS counter_name, value AS cntr_value, CAST(user_id AS VARCHAR) AS instance_name, CASE c WHEN 'purchase' THEN 'Sales per second' ELSE '' END AS description
FROM (SELECT *, CASE WHEN event_type = 'signup' THEN 'Lock Waits/sec' ELSE event_type END AS c, CASE WHEN user_id = 7 THEN 'Buffer Node' ELSE 'Stats' END AS o FROM events)
WHERE c IN ('purchase', 'click') AND o NOT LIKE '%Node%' OR c = 'Lock Waits/sec' AND user_id = 0""")
def _(t):
    rows = t.events.select(F.when(F.col("event_type") == "signup", "Lock Waits/sec").otherwise(F.col("event_type")).alias("counter_name"),
                           F.col("value").alias("cntr_value"), F.when(F.col("user_id") == 0, "_Total").otherwise(F.col("user_id").cast("string")).alias("instance_name"),
                           F.when(F.col("user_id") == 7, "Buffer Node").otherwise("Stats").alias("object_name"))
    out = C.key_counters(rows, ["Purchase", "Click"], {"purchase": "Sales per second"})
    return out.withColumn("instance_name", F.when(F.col("instance_name") == "_Total", "0").otherwise(F.col("instance_name")))


@query("k20_avg_tasks", """
SELECT CAST(sum(CAST(l_quantity AS BIGINT)) // count(*) AS BIGINT) AS avg_current_tasks_count, CAST(sum(l_linenumber) // count(*) AS BIGINT) AS avg_work_queue_count,
  CAST(sum(l_partkey) // count(*) AS BIGINT) AS avg_runnable_tasks_count, CAST(sum(l_suppkey) // count(*) AS BIGINT) AS avg_pending_disk_io_count FROM lineitem WHERE l_linenumber * 40 < 255""")
def _(t):
    rows = t.lineitem.select((F.col("l_linenumber") * 40).alias("scheduler_id"), F.col("l_quantity").cast("bigint").alias("current_tasks_count"), F.col("l_linenumber").alias("work_queue_count"),
                             F.col("l_partkey").alias("runnable_tasks_count"), F.col("l_suppkey").alias("pending_disk_io_count"))
    return C.avg_tasks(rows)


@query("k21_file_count_check", """
SELECT nation, f AS data_files, c AS online_cpus, CASE WHEN f < least(c, 8) THEN '*** ADD MORE TEMPDB DATA FILES ***' ELSE 'OK' END AS recommendation
FROM (SELECT s_nationkey AS nation, CAST(count(*) AS BIGINT) AS f FROM supplier GROUP BY 1) JOIN (SELECT c_nationkey AS nation, CAST(count(*) AS BIGINT) AS c FROM customer GROUP BY 1) USING (nation)""")
def _(t):
    return C.file_count_check(t.supplier.withColumnRenamed("s_nationkey", "nation"), t.customer.withColumnRenamed("c_nationkey", "nation"), "nation")


@query("k21_memory_left_check", """
SELECT c_custkey, floor((8000000 / 1024.0 - m) * 1.0 + 0.5) / 1.0 AS left_for_os_mb, CASE WHEN m = 2147483647 THEN '*** UNLIMITED — CONFIGURE NOW ***' WHEN 8000000 / 1024.0 - m < 2048 THEN '*** LESS THAN 2 GB LEFT FOR OS ***'
  WHEN 8000000 / 1024.0 - m < 4096 THEN '* Less than 4 GB left for OS *' ELSE 'OK' END AS status
FROM (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 2147483647 ELSE CAST(floor(abs(c_acctbal)) AS BIGINT) END AS m FROM customer)""")
def _(t):
    limit = F.when(F.col("c_mktsegment") == "BUILDING", F.lit(2147483647)).otherwise(F.floor(F.abs("c_acctbal")))
    rows = t.customer.select("c_custkey", F.lit(8000000).alias("total_physical_memory_kb"), limit.alias("max_server_memory_mb"))
    return C.memory_left_check(rows).select("c_custkey", "left_for_os_mb", "status")
