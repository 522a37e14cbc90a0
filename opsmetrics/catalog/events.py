"""Group K.9, second part: event documents, deadlocks, triage."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import int_div
from ..plans import deadlocks as D
from ..plans import events as P
from ..plans.triage import triage
from . import backups as backup_inputs
from . import jobs as job_inputs
from . import storage as storage_inputs
from . import workload as workload_inputs
from .fixtures import USER_WAITS_SQL, orders_as_of
from .registry import query


def text(s):
    return F.lit(s)


def blocking_docs(t):
    """Events as blocked process reports, errors as deadlock reports."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    head = lambda name: F.concat(text(f'<event name="{name}" timestamp="'), stamp, text('">'))
    actions = F.concat(text('<action name="client_app_name"><value>'), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")), text('</value></action><action name="client_hostname"><value>host</value></action>'))
    data = F.concat(text('<data name="database_name"><value>db</value></data><data name="object_id"><value>'), F.col("user_id").cast("string"), text('</value></data><data name="duration"><value>'),
                    (F.col("event_id") * 1700).cast("string"), text('</value></data><data name="lock_mode"><value>5</value><text>X</text></data><data name="blocked_process"><value><blocked-process-report monitorLoop="'),
                    F.col("event_id").cast("string"), text('"><blocked-process/></blocked-process-report></value></data>'))
    graph = F.concat(text('<data name="xml_report"><value><deadlock victim="p'), F.col("event_id").cast("string"), text('"><process-list/></deadlock></value></data>'))
    blocked = F.concat(head("blocked_process_report"), data, actions, text("</event>"))
    dead = F.concat(head("xml_deadlock_report"), graph, actions, text("</event>"))
    return t.spread(t.events, "event_id").select("event_id", F.when(F.col("event_type") == "error", dead).otherwise(blocked).alias("event_data"))


@query("k113_blocking_events", """
SELECT event_id, CASE WHEN e THEN 'Deadlock' ELSE 'Blocked Process' END AS report_type, ts - INTERVAL 5 HOUR AS event_time, CASE WHEN event_type = 'view' THEN ' -- N/A -- ' ELSE event_type END AS client_app_name,
  CASE WHEN NOT e THEN 'db' END AS database_name, CASE WHEN NOT e THEN event_id * 1700 // 1000 END AS duration_ms, CASE WHEN NOT e THEN 'X' END AS lock_mode, coalesce(s_name, ' -- N/A -- ') AS table_name,
  CASE WHEN e THEN '<deadlock victim="p' || event_id || '"><process-list/></deadlock>' ELSE '<blocked-process-report monitorLoop="' || event_id || '"><blocked-process/></blocked-process-report>' END AS report
FROM (SELECT *, event_type = 'error' AS e FROM events) LEFT JOIN supplier ON s_suppkey = user_id AND NOT e""")
def _(t):
    names = t.supplier.select(F.col("s_suppkey").cast("int").alias("object_id"), F.lit("dbo").alias("schema_name"), F.col("s_name").alias("table_name"))
    return (P.blocking_events(blocking_docs(t), zone="America/New_York", names=names)
            .select("event_id", "report_type", "event_time", "client_app_name", "database_name", "duration_ms", "lock_mode", "table_name", "report"))


@query("k114_deadlocks", """
SELECT ts AS deadlock_time, '<deadlock victim="p' || event_id || '"><process-list/></deadlock>' AS deadlock_graph FROM events WHERE event_type = 'error' ORDER BY ts DESC, deadlock_graph LIMIT 20""")
def _(t):
    docs = blocking_docs(t).groupBy(int_div("event_id", 500)).agg(
        F.concat(text("<RingBufferTarget>"), F.array_join(F.collect_list("event_data"), ""), text("</RingBufferTarget>")).alias("target_data"))
    return P.deadlocks(docs).select("deadlock_time", "deadlock_graph")


def graphs(t):
    """Orders as deadlocks of two processes over two key locks; the victim is named in one of two ways."""
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    proc = lambda pid, spid, host, stmt: F.concat(text(f'<process id="{pid}" spid="'), spid, text('" ecid="0" clientapp="app" hostname="'), host, text('" loginname="u" lockMode="X" waitresource="KEY"><executionStack><frame procname="adhoc" line="1">'),
                                                  stmt, text('</frame></executionStack><inputbuf>run '), spid, text('</inputbuf></process>'))
    lock = lambda i, owner, waiter: text(f'<keylock id="lock{i}" objectname="db.t" indexname="ix{i}" mode="X"><owner-list><owner id="{owner}" mode="X"/></owner-list><waiter-list><waiter id="{waiter}" mode="S" requestType="wait"/></waiter-list></keylock>')
    old = F.col("o_orderstatus") == "F"
    root = F.when(old, text('<deadlock victim="B">')).otherwise(text('<deadlock><victim-list><victimProcess id="A"/></victim-list>'))
    body = F.concat(root, text("<process-list>"), proc("A", c, F.col("o_orderpriority"), text("UPDATE t")), proc("B", F.concat(k, text("9")), text("APP02"), F.when(old, "unknown").otherwise("")), text("</process-list><resource-list>"),
                    lock(1, "B", "A"), lock(2, "A", "B"), text("</resource-list></deadlock>"))
    wrapped = F.concat(text('<event name="xml_deadlock_report"><data name="xml_report"><value>'), body, text("</value></data></event>"))
    return t.spread(t.orders, "o_orderkey").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", wrapped).otherwise(body).alias("xml"))


def shredded(t, keep=False):
    return D.deadlock_tables(graphs(t), "o_orderkey", "xml", keep)


SIDES = "SELECT o_orderkey, 'A' AS id, CAST(o_custkey AS VARCHAR) AS spid, o_orderpriority AS hostname, o_orderstatus <> 'F' AS is_victim, 'UPDATE t' AS primary_sql FROM orders UNION ALL SELECT o_orderkey, 'B', o_orderkey || '9', 'APP02', o_orderstatus = 'F', CASE WHEN o_orderstatus = 'F' THEN 'unknown' ELSE 'run ' || o_orderkey || '9' END FROM orders"


@query("k115_deadlock_processes", SIDES)
def _(t):
    return shredded(t).processes.select("o_orderkey", "id", "spid", "hostname", "is_victim", "primary_sql")


@query("k115_deadlock_resources", "SELECT o_orderkey, 'keylock' AS kind, 'lock' || i AS id, 'ix' || i AS indexname FROM orders, (VALUES (1), (2)) v(i)")
def _(t):
    return shredded(t).resources.select("o_orderkey", "kind", "id", "indexname")


@query("k115_deadlock_links", """
SELECT o_orderkey, CAST(i AS INTEGER) AS resource_index, role, p AS process_id, mode FROM orders, (VALUES (0, 'owner', 'B', 'X'), (0, 'waiter', 'A', 'S'), (1, 'owner', 'A', 'X'), (1, 'waiter', 'B', 'S')) v(i, role, p, mode)""")
def _(t):
    return shredded(t).edges.select("o_orderkey", "resource_index", "role", "process_id", "mode")


@query("k115_deadlocks_of_a_document", """
SELECT d // 4 AS doc, CAST(row_number() OVER (PARTITION BY d // 4 ORDER BY d) - 1 AS INTEGER) AS deadlock_no, CASE WHEN d % 4 = 2 THEN 'malformed document' END AS error,
       CASE WHEN d % 4 <> 2 THEN 'oddlock' END AS kind, CASE WHEN d % 4 <> 2 THEN 'a<b ' || d END AS note FROM (SELECT o_orderkey AS d FROM orders)""")
def _(t):
    # Four deadlocks to a document, one of them malformed, over a resource of a kind and with an attribute that no list names.
    k = F.col("o_orderkey")
    lock = F.concat(text('<oddlock note="a&lt;b '), k.cast("string"), text('"/>'))
    body = F.when(k % 4 == 2, text("<process-list></resource-list>")).otherwise(F.concat(text("<process-list/><resource-list>"), lock, text("</resource-list>")))
    one = F.concat(text("<deadlock>"), body, text("</deadlock>"))
    docs = t.orders.groupBy(int_div("o_orderkey", 4).alias("doc")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", one.alias("x")))).alias("all"))
    docs = docs.select("doc", F.concat(text("<events>"), F.array_join(F.transform("all", lambda d: d["x"]), " "), text("</events>")).alias("xml"))
    found = D.deadlock_tables(docs, "doc", "xml")
    kinds = found.resources.select("doc", D.NUMBER, "kind", F.col("attributes")["note"].alias("note"))
    return found.graphs.select("doc", D.NUMBER, "error").join(kinds, ["doc", D.NUMBER], "left")


@query("k116_deadlock_summary", """
SELECT o_orderkey, CAST(2 AS BIGINT) AS processes, CAST(2 AS BIGINT) AS resources, CAST(4 AS BIGINT) AS edges, CAST(1 AS BIGINT) AS victim_ids, 'Victim process(es): SPID ' || CASE WHEN o_orderstatus = 'F' THEN o_orderkey || '9' ELSE CAST(o_custkey AS VARCHAR) END
  || '. Participants: 2; resources involved: 2. Applications seen: app. Hosts seen: ' || o_orderpriority || ', APP02. Lock modes seen: S, X.' AS summary FROM orders""")
def _(t):
    return D.deadlock_summary(shredded(t, keep=True), "o_orderkey").select("o_orderkey", "processes", "resources", "edges", "victim_ids", "summary")


@query("k116_deadlock_edges", """
SELECT o_orderkey, 'keylock • db.t • ix1' AS resource, 'SPID ' || o_custkey AS waiter, 'SPID ' || o_orderkey || '9' AS owner, 'S' AS waiter_mode, 'X' AS owner_mode FROM orders
UNION ALL SELECT o_orderkey, 'keylock • db.t • ix2', 'SPID ' || o_orderkey || '9', 'SPID ' || o_custkey, 'S', 'X' FROM orders""")
def _(t):
    return D.deadlock_edges(shredded(t, keep=True), "o_orderkey").drop("resource_index", D.NUMBER)


@query("k117_deadlock_filter", f"SELECT o_orderkey, id FROM ({SIDES}) WHERE is_victim AND contains(lower(id || ' ' || spid || ' app ' || hostname || ' u KEY X ' || primary_sql || ' run ' || spid || ' adhoc'), 'app02')")
def _(t):
    return D.deadlock_filter(shredded(t, keep=True), "o_orderkey", "APP02", "victims").select("o_orderkey", "id")


@query("k117_deadlock_owners", f"SELECT o_orderkey, id FROM ({SIDES}) WHERE contains(spid, '77') OR contains(primary_sql, '77')")
def _(t):
    return D.deadlock_filter(shredded(t, keep=True), "o_orderkey", "77", "owners").select("o_orderkey", "id")


@query("k118_event_report", """
SELECT event_id, event_type AS event_name, ts AS event_time, CAST(value AS DECIMAL(18,2))::DOUBLE AS duration, user_id AS session_id, CAST(NULL AS VARCHAR) AS sql_text FROM events""")
def _(t):
    return P.event_report(t.events_xml(), {"duration": ("data", "duration", "double"), "session_id": ("action", "session_id", "bigint"), "sql_text": ("action", "sql_text", "string")})


@query("k118_long_events", "SELECT event_id, CAST(value AS DECIMAL(18,2))::DOUBLE AS duration FROM events WHERE value > 300")
def _(t):
    return P.event_report(t.events_xml(), {"duration": ("data", "duration", "double")}).where("duration > 300").select("event_id", "duration")


@query("k119_triage", f"""
SELECT 'top_waits' AS report, CAST(count(*) AS BIGINT) AS row_count FROM (SELECT * FROM ({USER_WAITS_SQL}) WHERE wait_type NOT IN ('WAITFOR', 'DIRTY_PAGE_POLL') LIMIT 20)
UNION ALL SELECT 'top_cpu', least(count(*), 25) FROM part UNION ALL SELECT 'top_reads', least(count(*), 25) FROM part UNION ALL SELECT 'top_elapsed', least(count(*), 25) FROM part
UNION ALL SELECT 'database_posture', count(*) FROM customer UNION ALL SELECT 'last_backups', count(*) FROM customer
UNION ALL SELECT 'file_latency', count(DISTINCT l_partkey) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'N' AND p_type <> 'ECONOMY'
UNION ALL SELECT 'log_gaps', count(*) FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate + to_seconds(o_orderkey % 5000)) AS ll FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey
  WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 0 AND (ll IS NULL OR date_diff('minute', ll, TIMESTAMP '2001-12-31') > 1440)
UNION ALL SELECT 'failed_jobs', 0 UNION ALL SELECT r, -1 FROM (VALUES ('running_requests'), ('head_blockers'), ('memory'), ('temp_space'), ('volume_space')) v(r)""")
def _(t):
    tables = {"waits": t.user_waits(), "statements": workload_inputs.statement_stats(t), "databases": backup_inputs.databases(t), "backups": backup_inputs.sets(t),
              "file_io": storage_inputs.file_io(t), "files": storage_inputs.files(t), "job_history": job_inputs.history(t), "jobs": job_inputs.jobs(t)}
    done = triage(tables, orders_as_of()).run()
    counted = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("report"), "row_count") for name, df in done.reports.items()]
    failed = t.spark.createDataFrame([(name, -1) for name in done.errors], "report string, row_count bigint")
    return reduce(DataFrame.unionByName, counted + [failed])
