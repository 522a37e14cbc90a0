"""Group K.7: jobs, agents and logs."""

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.scalars import int_div
from ..plans import jobs as P
from .fixtures import fx, orders_as_of
from .registry import query
from .scans import scratch
from ..sources.tables import read_logs


def packed(seconds):
    return (int_div(seconds, 3600) * 10000 + int_div(seconds % 3600, 60) * 100 + seconds % 60).cast("int")


def history(t):
    """Orders as job runs of their customer's job, times as packed whole numbers."""
    at = F.col("o_orderkey") % 86400
    return t.orders.select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("instance_id"), F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("step_id"),
                           F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("run_date"), packed(at).alias("run_time"), packed(F.floor("o_totalprice") % 86400).alias("run_duration"),
                           F.substring("o_orderpriority", 1, 1).cast("int").alias("run_status"), F.col("o_orderpriority").alias("message"))


def jobs(t):
    return t.customer.select(F.col("c_custkey").alias("job_id"), F.col("c_name").alias("job_name"), F.col("c_nationkey").alias("category_id"), F.col("c_mktsegment").alias("owner"))


HISTORY = """SELECT o_custkey AS job_id, o_orderkey AS instance_id, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS step_id, o_orderdate + to_seconds(o_orderkey % 86400) AS run_at, CAST(floor(o_totalprice) AS BIGINT) % 86400 AS dur,
  CAST(left(o_orderpriority, 1) AS INTEGER) AS run_status, o_orderpriority AS message, c_name AS job_name FROM orders JOIN customer ON c_custkey = o_custkey"""


@query("k86_running_jobs", """
SELECT o_orderkey AS activity_id, c_name AS job_name, date_diff('second', o_orderdate, TIMESTAMP '2001-12-31') AS elapsed_seconds, s_name AS command FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = o_custkey WHERE o_orderstatus = 'O'""")
def _(t):
    activity = t.orders.select(F.col("o_orderkey").alias("activity_id"), F.col("o_custkey").alias("job_id"), F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("start_execution_date"),
                               F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("stop_execution_date"))
    requests = t.supplier.select(F.col("s_suppkey").alias("session_id"), F.col("s_name").alias("command"))
    return P.running_jobs(activity, jobs(t), requests, orders_as_of()).select("activity_id", "job_name", "elapsed_seconds", "command")


@query("k87_job_overview", f"""
WITH l AS (SELECT * FROM ({HISTORY}) QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY instance_id DESC) = 1)
SELECT c_custkey AS job_id, n_name AS category, run_at AS last_start, printf('%02d:%02d:%02d', dur // 3600, dur % 3600 // 60, dur % 60) AS last_duration, run_status, s_name AS schedule_name
FROM customer LEFT JOIN l ON l.job_id = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN supplier ON s_suppkey = c_custkey""")
def _(t):
    categories = t.nation.select(F.col("n_nationkey").alias("category_id"), F.col("n_name").alias("category"))
    schedules = t.supplier.select(F.col("s_suppkey").alias("job_id"), F.col("s_name").alias("schedule_name"))
    return P.job_overview(jobs(t), history(t), categories, schedules).select("job_id", "category", "last_start", "last_duration", "run_status", "schedule_name")


@query("k88_job_history", f"""
SELECT job_name, run_at, message, run_status FROM ({HISTORY}) WHERE step_id = 0 AND run_at > TIMESTAMP '2001-12-31' - INTERVAL 17520 HOUR""")
def _(t):
    return P.job_history(history(t), jobs(t), orders_as_of(), hours=17520).drop("run_duration")


@query("k88_failed_steps", f"SELECT instance_id, job_name, message FROM ({HISTORY}) WHERE step_id > 0 AND run_status <> 1")
def _(t):
    return P.failed_steps(history(t), jobs(t)).select("instance_id", "job_name", "message")


@query("k88_recent_failures", f"""
SELECT job_name, run_at, step_id, run_status, message, instance_id FROM ({HISTORY}) WHERE run_status IN (0, 2, 3) AND run_at >= TIMESTAMP '2001-12-31' - INTERVAL 17520 HOUR ORDER BY run_at DESC, instance_id LIMIT 25""")
def _(t):
    return P.recent_failures(history(t), jobs(t), orders_as_of(), hours=17520)


@query("k88_last_status", f"""
SELECT job_id, job_name, run_at AS last_run, CASE run_status WHEN 1 THEN 'Success' WHEN 2 THEN 'Retry' WHEN 3 THEN 'Canceled' WHEN 4 THEN 'In progress' END AS status FROM ({HISTORY}) WHERE step_id = 0 QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY instance_id DESC) = 1""")
def _(t):
    return P.last_status(history(t), jobs(t))


@query("k88_last_runs", f"""
SELECT c_custkey AS job_id, instance_id, run_status FROM customer LEFT JOIN (SELECT * FROM ({HISTORY}) WHERE step_id = 0 QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY date_trunc('day', run_at) DESC, run_at DESC, instance_id DESC) <= 3) ON job_id = c_custkey""")
def _(t):
    return P.last_runs(jobs(t), history(t)).select("job_id", "instance_id", "run_status")


def schedules(t):
    """Lines as schedules."""
    kinds = F.element_at(F.array(*[F.lit(k) for k in (1, 4, 8, 16, 32, 64, 128)]), F.col("l_linenumber"))
    return t.lineitem.select(
        "l_orderkey", "l_partkey", kinds.alias("freq_type"), (F.col("l_partkey") % 10 + 1).alias("freq_interval"), (F.col("l_suppkey") % 4 + 1).alias("freq_recurrence_factor"), F.lit(4).alias("freq_relative_interval"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(4).alias("freq_subday_type"), (F.col("l_suppkey") % 30).alias("freq_subday_interval"), packed(F.col("l_orderkey") % 86400).alias("active_start_time"),
        F.lit(235959).alias("active_end_time"), F.when(F.col("l_linestatus") == "F", 0).otherwise(F.date_format("l_shipdate", "yyyyMMdd").cast("int")).alias("next_run_date"), packed(F.col("l_orderkey") % 86400).alias("next_run_time"))


DAYS_SQL = "concat_ws(', ', " + ", ".join(f"CASE WHEN i & {b} = {b} THEN '{d}' END" for b, d in V.WEEKDAY_BITS.items()) + ")"
RELATIVE_SQL = "CASE i " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in V.RELATIVE_DAYS.items()) + " END"
TYPE_SQL = "CASE l_linenumber WHEN 1 THEN 'Once' WHEN 2 THEN 'Daily' WHEN 3 THEN 'Weekly' WHEN 4 THEN 'Monthly' WHEN 5 THEN 'Monthly relative' WHEN 6 THEN 'When SQL Server Agent starts' ELSE 'Start whenever the CPU(s) become idle' END"


@query("k89_schedule_text", f"""
SELECT l_orderkey, l_partkey, {TYPE_SQL} AS occurs, CASE l_linenumber WHEN 1 THEN 'Once' WHEN 2 THEN 'Every ' || i || ' day(s)' WHEN 3 THEN 'Every ' || r || ' weeks(s) on ' || {DAYS_SQL} WHEN 4 THEN 'Day ' || i || ' of every ' || r || ' month(s)'
  WHEN 5 THEN 'The Third ' || {RELATIVE_SQL} || ' of every ' || r || ' month(s)' ELSE '' END AS occurs_detail,
  CASE l_returnflag WHEN 'A' THEN 'Occurs once at ' || c ELSE 'Occurs every ' || l_suppkey % 30 || CASE WHEN l_returnflag = 'N' THEN ' Seconds(s)' ELSE ' Minute(s)' END || ' between ' || c || ' and 23:59:59' END AS frequency,
  CASE WHEN l_linestatus = 'F' THEN TIMESTAMP '1900-01-01' ELSE l_shipdate + to_seconds(l_orderkey % 86400) END AS next_run
FROM (SELECT *, l_partkey % 10 + 1 AS i, l_suppkey % 4 + 1 AS r, strftime(TIMESTAMP '2000-01-01' + to_seconds(l_orderkey % 86400), '%H:%M:%S') AS c FROM lineitem)""")
def _(t):
    return P.schedule_text(schedules(t)).select("l_orderkey", "l_partkey", "occurs", "occurs_detail", "frequency", "next_run")


@query("k90_avg_duration", f"""
SELECT job_id, {fx('CAST(sum(dur) AS DOUBLE) / count(*)', 2)} AS avg_duration_sec FROM ({HISTORY}) WHERE step_id = 0 GROUP BY 1""")
def _(t):
    return P.avg_duration(history(t))


@query("k91_owner_audit", "SELECT c_custkey AS job_id, c_mktsegment AS owner FROM customer WHERE c_mktsegment <> 'BUILDING'")
def _(t):
    return P.job_audit(jobs(t), "owner", owner="BUILDING").select("job_id", "owner")


def steps(t):
    return t.orders.select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("step_id"), F.when(F.col("o_orderstatus") == "P", "CmdExec").otherwise("SQL").alias("subsystem"), F.col("o_custkey").alias("proxy_id"))


@query("k91_subsystem_audit", "SELECT o_orderkey AS step_id, c_name AS job_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P'")
def _(t):
    return P.job_audit(jobs(t), "subsystem", steps(t)).select("step_id", "job_name")


@query("k91_proxy_audit", "SELECT o_orderkey AS step_id, c_name AS job_name, coalesce(s_name, 'N/A') AS proxy_name FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = o_custkey")
def _(t):
    proxies = t.supplier.select(F.col("s_suppkey").alias("proxy_id"), F.col("s_name").alias("proxy_name"))
    return P.job_audit(jobs(t), "proxy", steps(t), proxies).select("step_id", "job_name", "proxy_name")


@query("k91_alert_audit", """
SELECT o_orderkey || ' ' || o_orderpriority AS alert_name, 'MSSQLSERVER' AS event_source, o_custkey AS message_id, CAST(left(o_orderpriority, 1) AS INTEGER) AS severity, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS enabled,
  CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS has_notification, o_orderkey % 600 AS delay_between_responses, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_orderkey % 50 END AS occurrence_count,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_seconds(o_orderkey % 86400) END AS last_occurrence FROM orders""")
def _(t):
    never, at = F.col("o_orderstatus") == "P", F.col("o_orderkey") % 86400
    alerts = t.orders.select(
        F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("alert_name"), F.lit("MSSQLSERVER").alias("event_source"), F.col("o_custkey").alias("message_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("severity"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("enabled"),
        F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0).alias("has_notification"), (F.col("o_orderkey") % 600).alias("delay_between_responses"),
        F.when(never, 0).otherwise(F.col("o_orderkey") % 50).alias("occurrence_count"),
        F.when(never, 0).otherwise(F.date_format("o_orderdate", "yyyyMMdd").cast("int")).alias("last_occurrence_date"), F.when(never, 0).otherwise(packed(at)).alias("last_occurrence_time"))
    return P.alert_audit(alerts)


@query("k92_search_logs", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license')")
def _(t):
    return P.search_logs(t.documents, "License").select("doc_id", "source")


@query("k92_store_logs", """
SELECT event_id, ts AS log_date FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 20 DAY""")
def _(t):
    log = t.events.select("event_id", F.col("ts").alias("log_date"))
    stored = log.where(F.col("log_date") < F.lit("2024-01-16").cast("timestamp_ntz"))
    return P.store_logs(stored, log, F.expr("timestamp_ntz'2024-01-31'"), days=20)
