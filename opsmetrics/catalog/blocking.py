"""Groups K.2 and K.10: blocking, sessions and their details."""

from pyspark.sql import functions as F

from ..functions.scalars import int_div
from ..plans import blocking as B
from ..plans import sessions as S
from .fixtures import ORDERS_AS_OF, TREE_SQL, events_as_of, fx, money, orders_as_of
from .registry import query

HIERARCHY_SQL = f"""WITH RECURSIVE tree AS ({TREE_SQL}), h AS (
SELECT sid AS head, sid, blk, wait_ms, wait_type, CAST(0 AS BIGINT) AS level FROM tree WHERE blk = 0 AND sid IN (SELECT blk FROM tree WHERE blk <> 0)
UNION ALL SELECT h.head, t.sid, t.blk, t.wait_ms, t.wait_type, h.level + 1 FROM tree t JOIN h ON h.sid = t.blk AND t.sid <> h.sid)"""


@query("k22_head_blockers", f"""
WITH tree AS ({TREE_SQL}) SELECT DISTINCT blk AS sid FROM tree WHERE blk > 0 AND blk NOT IN (SELECT sid FROM tree WHERE blk > 0)""")
def _(t):
    return B.head_blockers(t.customer_tree())


@query("k22_head_blocker_rows", f"""
WITH tree AS ({TREE_SQL}) SELECT * FROM tree WHERE blk = 0 AND sid IN (SELECT blk FROM tree)""")
def _(t):
    return B.head_blocker_rows(t.customer_tree())


@query("k23_head_blocker_report", f"""
WITH tree AS ({TREE_SQL}), w AS (SELECT o_custkey AS sid, o_orderkey AS by_sid, o_orderpriority AS wait_type, CAST(floor(o_totalprice) AS BIGINT) AS ms FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice) DESC, o_orderkey) = 1)
SELECT CASE WHEN b.blk IS NOT NULL AND t.blk = 0 THEN '1' ELSE '' END AS head_blocker, t.sid AS session_id, t.wait_type AS status, w.by_sid AS blocked_by, w.wait_type, w.ms AS wait_duration_ms, d.text
FROM tree t LEFT JOIN (SELECT DISTINCT blk FROM tree WHERE blk <> 0) b ON b.blk = t.sid LEFT JOIN w ON w.sid = t.sid LEFT JOIN documents d ON d.doc_id = t.sid WHERE (b.blk IS NOT NULL AND t.blk = 0) OR t.blk > 0""")
def _(t):
    tree = t.customer_tree()
    sessions = tree.select(F.col("sid").alias("session_id"), F.lit("login").alias("login_name"), F.col("wait_type").alias("status"), F.lit(True).alias("is_user_process"))
    connections = tree.select(F.col("sid").alias("session_id"), F.col("sid").alias("most_recent_sql_handle"))
    requests = tree.select(F.col("sid").alias("session_id"), "blk", F.lit(0).alias("request_id"), F.lit("SELECT").alias("command"), F.col("sid").alias("sql_handle"))
    tasks = tree.select(F.col("sid").alias("session_id"), F.lit(0).alias("request_id"), F.col("sid").alias("task_address"))
    waits = t.orders.select(F.col("o_custkey").alias("task_address"), F.col("o_orderkey").alias("blocking_session_id"), F.col("o_orderpriority").alias("wait_type"),
                            F.floor("o_totalprice").alias("wait_duration_ms"))
    texts = t.documents.select(F.col("doc_id").alias("sql_handle"), "text")
    return (B.head_blocker_report(sessions, connections, requests, tasks, waits, texts)
            .select("head_blocker", "session_id", "status", "blocked_by", "wait_type", "wait_duration_ms", "text"))


@query("k24_blocking_hierarchy", f"""{HIERARCHY_SQL}
SELECT h.*, t.wait_type AS head_wait_type FROM h JOIN tree t ON t.sid = h.head""")
def _(t):
    return B.blocking_hierarchy(t.customer_tree(), payload=["wait_type"])


@query("k25_head_blocker_summary", f"""{HIERARCHY_SQL}
SELECT head AS head_blocker_session_id, wait_type AS blocking_resource_wait_type, CAST(count(*) AS BIGINT) AS blocked_task_count, CAST(sum(wait_ms) AS BIGINT) AS tot_wait_duration_ms,
  CAST(sum(wait_ms) // count(*) AS BIGINT) AS avg_wait_duration_ms, max(wait_ms) AS max_wait_duration_ms, max(level) AS max_blocking_chain_depth FROM h WHERE level > 0 GROUP BY 1, 2""")
def _(t):
    return B.head_blocker_summary(t.customer_tree())


@query("k25_head_statements", f"""{HIERARCHY_SQL},
s AS (SELECT head AS head_blocker_session_id, wait_type AS blocking_resource_wait_type, CAST(count(*) AS BIGINT) AS blocked_task_count FROM h WHERE level > 0 GROUP BY 1, 2),
x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'USE a' || chr(13) || chr(10) || 'CREATE PROC ' ELSE '-- ' END || text AS text, CASE WHEN doc_id % 5 <> 0 THEN doc_id END AS object_id,
  CASE WHEN doc_id % 7 <> 0 THEN doc_id % 50 * 2 ELSE 0 END AS b, CASE doc_id % 4 WHEN 0 THEN -1 WHEN 1 THEN 8192 ELSE 200 + doc_id % 300 END AS e, source FROM documents WHERE doc_id IN (SELECT head FROM h))
SELECT s.*, CASE WHEN object_id IS NULL OR text IS NULL THEN '' ELSE translate(CASE WHEN contains(left(text, 512), 'CREATE ') THEN substr(text, position('CREATE ' IN text), 50) ELSE left(text, 49) END, chr(13) || chr(10), '  ') END AS head_blocker_proc_name,
  coalesce(object_id, 0) AS head_blocker_proc_objid, coalesce(left(translate(substr(text, b // 2 + 1, CASE WHEN e <= 0 THEN 8193 ELSE e // 2 - b // 2 + 1 END), chr(13) || chr(10), '  '), 1000), '') AS stmt_text,
  source AS head_blocker_plan_handle FROM s LEFT JOIN x ON doc_id = head_blocker_session_id""")
def _(t):
    n = F.col("doc_id")
    text = F.concat(F.when(n % 3 == 0, "").when(n % 3 == 1, "USE a\r\nCREATE PROC ").otherwise("-- "), "text")
    heads = t.documents.select(
        n.alias("sid"), text.alias("text"), F.when(n % 5 != 0, n).alias("object_id"), F.when(n % 7 != 0, n % 50 * 2).alias("statement_start_offset"),
        F.when(n % 4 == 0, -1).when(n % 4 != 1, 200 + n % 300).alias("statement_end_offset"), F.col("source").alias("plan_handle"))
    return B.head_blocker_summary(t.customer_tree(), heads=heads).select(
        "head_blocker_session_id", "blocking_resource_wait_type", "blocked_task_count", "head_blocker_proc_name", "head_blocker_proc_objid", "stmt_text", "head_blocker_plan_handle")


@query("k26_blocked_counts", f"""
WITH RECURSIVE tree AS ({TREE_SQL}), c AS (SELECT sid AS top, sid FROM tree UNION ALL SELECT c.top, t.sid FROM c JOIN tree t ON t.blk = c.sid)
SELECT top AS sid, CAST(count(*) - 1 AS BIGINT) AS blocked_session_count FROM c GROUP BY 1""")
def _(t):
    return B.blocked_counts(t.customer_tree())


def captures(t):
    """Two captures of the tree: all of it, and one where sessions with a negative balance run free."""
    tree = t.customer.where("c_custkey > 0").select(F.col("c_custkey").alias("sid"), int_div("c_custkey", 8).alias("blk"), F.col("c_acctbal").alias("bal"),
                                                    F.col("c_name").alias("batch_text"))
    calm = tree.withColumn("blk", F.when(F.col("bal") < 1000, F.lit(0)).otherwise(F.col("blk")))
    return tree.withColumn("runtime", F.lit("10:00")).unionByName(calm.withColumn("runtime", F.lit("10:05"))).drop("bal")


@query("k27_blocking_tree", """
WITH RECURSIVE t AS (SELECT '10:00' AS runtime, c_custkey AS sid, c_custkey // 8 AS blk, c_name AS b FROM customer WHERE c_custkey > 0
  UNION ALL SELECT '10:05', c_custkey, CASE WHEN c_acctbal < 1000 THEN 0 ELSE c_custkey // 8 END, c_name FROM customer WHERE c_custkey > 0),
p AS (SELECT runtime, sid AS anchor, sid, CAST(0 AS BIGINT) AS depth, lpad(CAST(sid AS VARCHAR), 10, '0') AS sort_path, b FROM t
  WHERE EXISTS (SELECT 1 FROM t x WHERE x.runtime = t.runtime AND x.blk = t.sid AND x.blk <> x.sid)
  UNION ALL SELECT t.runtime, p.anchor, t.sid, p.depth + 1, p.sort_path || lpad(CAST(t.sid AS VARCHAR), 10, '0'), t.b FROM t JOIN p ON p.runtime = t.runtime AND t.blk = p.sid WHERE t.blk > 0 AND t.blk <> t.sid)
SELECT runtime, anchor, sid, depth, sort_path, runtime || repeat(' ', 17) || repeat('|   ', CAST(greatest(depth - 1, 0) AS INTEGER)) || CASE WHEN depth > 0 THEN '|-- ' ELSE '' END || sid || ' ' || b AS blocking_tree FROM p""")
def _(t):
    return B.blocking_tree(captures(t))


@query("k27_tree_numbers", f"""
WITH RECURSIVE tree AS ({TREE_SQL}),
p AS (SELECT sid, CAST(0 AS BIGINT) AS depth, [sid] AS path FROM tree WHERE blk = 0
  UNION ALL SELECT t.sid, p.depth + 1, list_append(p.path, t.sid) FROM tree t JOIN p ON t.blk = p.sid AND t.blk > 0),
s AS (SELECT a AS sid, count(*) AS size FROM (SELECT unnest(path) AS a FROM p) GROUP BY a)
SELECT sid, depth, row_number() OVER (ORDER BY path) AS number, size FROM p JOIN s USING (sid)""")
def _(t):
    return B.tree_numbers(t.customer_tree())


@query("k28_blocking_pairs", f"""
WITH tree AS ({TREE_SQL})
SELECT a.sid AS blocked_session_id, b.sid AS blocking_session_id, da.text AS blocked_sql_text, db.text AS blocking_sql_text, a.wait_type, a.wait_ms AS wait_duration_ms
FROM tree a JOIN tree b ON a.blk = b.sid JOIN documents da ON da.doc_id = a.sid JOIN documents db ON db.doc_id = b.sid""")
def _(t):
    tree = t.customer_tree()
    texts = t.documents.select(F.col("doc_id").alias("session_id"), "text")
    waits = tree.select(F.col("sid").alias("session_id"), "wait_type", F.col("wait_ms").alias("wait_duration_ms"))
    return B.blocking_pairs(tree, texts, waits)


@query("k29_lock_contention", """
SELECT l_returnflag AS resource_type, l_partkey AS entity_id, l_linestatus AS request_mode, l_orderkey AS waiter_session_id, CAST(floor(o_totalprice) AS BIGINT) AS wait_duration_ms,
  md5(w.text) AS waiter_batch, substring(w.text, 5, 30) AS waiter_statement, o_custkey AS blocker_session_id, md5(b.text) AS blocker_batch
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN documents w ON w.doc_id = l_orderkey LEFT JOIN documents b ON b.doc_id = o_custkey""")
def _(t):
    locks = t.lineitem.select(F.col("l_returnflag").alias("resource_type"), F.col("l_partkey").alias("entity_id"), F.col("l_linestatus").alias("request_mode"),
                              F.col("l_orderkey").alias("request_session_id"), F.col("l_orderkey").alias("lock_owner_address"))
    waits = t.orders.select(F.col("o_orderkey").alias("resource_address"), F.col("o_custkey").alias("blocking_session_id"), F.floor("o_totalprice").alias("wait_duration_ms"))
    requests = t.documents.select(F.col("doc_id").alias("session_id"), F.col("doc_id").alias("sql_handle"), F.lit(8).alias("statement_start_offset"), F.lit(66).alias("statement_end_offset"))
    texts = t.documents.select(F.col("doc_id").alias("sql_handle"), "text")
    # Whole texts are joined; their digests keep the compared rows small.
    return B.lock_contention(locks, waits, requests, texts).withColumns({c: F.md5(c) for c in ("waiter_batch", "blocker_batch")})


@query("k30_long_running", """
SELECT event_id, user_id AS session_id, strftime(TIMESTAMP '1900-01-01' + (TIMESTAMP '2024-01-31' - ts), '%H:%M:%S.') || lpad(CAST((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) // 1000 % 1000 AS VARCHAR), 3, '0') AS batch_duration
FROM events WHERE user_id > 50 AND event_type NOT IN ('view')""")
def _(t):
    rows = t.events.select("event_id", F.col("user_id").alias("session_id"), F.col("ts").alias("last_batch"), F.col("event_type").alias("command"),
                           F.when(F.col("event_type") == "view", "sleeping").otherwise("running").alias("status"))
    return S.long_running(rows, events_as_of()).select("event_id", "session_id", "batch_duration")


@query("k31_running_requests", """
SELECT o_orderkey AS request_id, o_custkey AS session_id, c_name AS login_name, CAST(floor(o_totalprice) AS BIGINT) AS cpu_time, substring(text, 3, 41) AS statement_text
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN documents ON doc_id = o_custkey ORDER BY cpu_time DESC, o_orderdate DESC, session_id, request_id LIMIT 25""")
def _(t):
    requests = t.orders.select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("session_id"), F.floor("o_totalprice").alias("cpu_time"), F.col("o_orderdate").alias("elapsed_ms"),
                               F.col("o_custkey").alias("sql_handle"), F.lit(4).alias("statement_start_offset"), F.lit(84).alias("statement_end_offset"))
    sessions = t.customer.select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("login_name"), F.lit("h").alias("host_name"), F.lit(True).alias("is_user_process"))
    texts = t.documents.select(F.col("doc_id").alias("sql_handle"), "text")
    return S.running_requests(requests, sessions, texts).select("request_id", "session_id", "login_name", "cpu_time", "statement_text")


@query("k32_requests_by_hash", """
SELECT l_partkey AS query_hash, CAST(sum(CAST(l_extendedprice * 100 AS BIGINT)) AS BIGINT) AS total_cpu_ms, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_logical_reads,
  min(l_shipdate) AS earliest_start, CAST(count(*) AS BIGINT) AS requests, min(l_returnflag || chr(32) || l_linestatus) AS statement_text
FROM lineitem GROUP BY 1 ORDER BY total_cpu_ms DESC, query_hash LIMIT 10""")
def _(t):
    rows = t.lineitem.select(F.col("l_partkey").alias("query_hash"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cpu_time"), F.col("l_quantity").cast("bigint").alias("logical_reads"),
                             F.col("l_shipdate").alias("start_time"), F.concat("l_returnflag", F.lit("\n"), "l_linestatus").alias("statement_text"))
    return S.requests_by_hash(rows)


def user_sessions(events):
    cents = F.round(F.col("value") * 100).cast("bigint")
    return (events.groupBy(F.col("user_id").alias("session_id"))
            .agg(F.min("ts").alias("start_time"), F.sum(cents).alias("cpu"), F.count(F.lit(1)).alias("reads"), F.count_if(F.col("event_type") == "purchase").alias("writes"),
                 F.max_by("event_type", F.struct("ts", "event_id")).alias("program_name"))
            .withColumns({"request_id": F.lit(0), "status": F.lit("running"), "open_tran_count": F.lit(0)}))


USER_SESSION_SQL = """SELECT user_id AS session_id, min(ts) AS start_time, CAST(sum(CAST(value * 100 AS BIGINT)) AS BIGINT) AS cpu, CAST(count(*) AS BIGINT) AS reads,
  CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS writes, arg_max(event_type, {'a': ts, 'b': event_id}) AS program_name FROM events"""


@query("k33_session_report", f"""
WITH a AS ({USER_SESSION_SQL} WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), b AS ({USER_SESSION_SQL} GROUP BY 1),
d AS (SELECT b.*, a.cpu AS cpu1, a.reads AS reads1, a.writes AS writes1, a.start_time = b.start_time AS same, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(b.start_time)) // 1000 AS ms
  FROM b LEFT JOIN a USING (session_id) WHERE b.program_name LIKE '%i%' AND b.program_name NOT LIKE 's%')
SELECT session_id, program_name, printf('%02d %02d:%02d:%02d.%03d', ms // 86400000, ms // 3600000 % 24, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS duration,
  CASE WHEN same THEN cpu - cpu1 END AS cpu_delta, CASE WHEN same THEN reads - reads1 END AS reads_delta, CASE WHEN same THEN writes - writes1 END AS writes_delta FROM d""")
def _(t):
    before = user_sessions(t.events.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")))
    return S.session_report(user_sessions(t.events), before, events_as_of(), kind="program", pattern="%i%", not_kind="program", not_pattern="s%",
                            columns=["session_id", "program_name", "duration", "cpu_delta", "reads_delta", "writes_delta"], sort="session_id")


@query("k33_agent_jobs", """
WITH s AS (SELECT c_custkey, lpad(printf('%X', c_custkey), 8, '0') || '-0000-0000-0000-' || lpad(printf('%X', c_nationkey), 12, '0') AS id FROM customer)
SELECT c_custkey AS session_id, CASE WHEN c_custkey % 3 > 0 THEN id END AS job_id, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 4 AS INTEGER) END AS step_id,
       CASE WHEN c_custkey % 3 > 0 AND c_custkey % 4 < 2 AND c_custkey % 5 > 0 THEN 'job?' || c_custkey END AS job_name,
       CASE WHEN c_custkey % 3 > 0 AND c_custkey % 4 < 2 AND c_custkey % 5 > 0 THEN 'step ' || c_custkey % 4 END AS step_name FROM s""")
def _(t):
    # Customers as sessions; two of three run for a job, not all jobs and steps are listed.
    key = F.col("c_custkey")
    group = F.lpad(F.hex("c_custkey"), 8, "0")
    tail = F.lpad(F.hex("c_nationkey"), 12, "0")
    turned = F.concat(*[F.substring(group, at, 2) for at in (7, 5, 3, 1)], F.lit("000000000000"), tail)
    program = F.when(key % 3 == 0, "psql").otherwise(F.concat(F.lit("SQLAgent - TSQL JobStep (Job 0x"), turned, F.lit(" : Step "), (key % 4).cast("string"), F.lit(")")))
    job = F.concat(group, F.lit("-0000-0000-0000-"), tail).alias("job_id")
    listed = t.customer.where(key % 5 > 0)
    steps = listed.select(job, F.explode(F.array(F.lit(0), F.lit(1))).alias("step_id")).withColumn("step_name", F.concat(F.lit("step "), F.col("step_id").cast("string")))
    jobs = listed.select(job, F.concat(F.lit("job\x01"), key.cast("string")).alias("job_name"))
    rows = t.customer.select(key.alias("session_id"), program.alias("program_name"))
    return S.agent_jobs(rows, jobs, steps).drop("program_name")


@query("k34_open_transactions", """
SELECT o_custkey AS session_id, c_name AS login_name, o_orderdate AS begin_time, o_orderkey AS log_records, replace(replace(left(text, 255), chr(10), ' '), chr(13), ' ') AS last_text
FROM orders JOIN customer ON c_custkey = o_custkey JOIN documents ON doc_id = o_custkey WHERE o_orderstatus = 'O'""")
def _(t):
    trans = t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("begin_time"), F.col("o_orderkey").alias("log_records"), F.lit(0).alias("log_bytes"))
    sessions = t.customer.select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("login_name"), F.col("c_custkey").alias("sql_handle"))
    requests = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("session_id"), F.lit("SELECT").alias("command"))
    texts = t.documents.select(F.col("doc_id").alias("sql_handle"), "text")
    return S.open_transactions(trans, sessions, requests, texts).select("session_id", "login_name", "begin_time", "log_records", "last_text")


@query("k35_connection_counts", "SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS connections FROM events GROUP BY ALL")
def _(t):
    return S.connection_counts(t.events, ["user_id", "event_type"])


@query("k35_insecure_connections", """
SELECT event_type AS net_transport, p AS protocol_type, CAST(count(*) AS BIGINT) AS connections FROM (SELECT *, CASE WHEN value > 100 THEN 'Database Mirroring' ELSE 'TSQL' END AS p FROM events)
WHERE event_type <> 'view' AND (user_id NOT IN (SELECT s_suppkey FROM supplier) OR p <> 'Database Mirroring') GROUP BY ALL""")
def _(t):
    rows = t.events.select(F.when(F.col("event_type") == "view", "TRUE").otherwise("FALSE").alias("encrypt_option"), F.col("event_type").alias("net_transport"), F.col("user_id").alias("client_net_address"),
                           F.when(F.col("value") > 100, "Database Mirroring").otherwise("TSQL").alias("protocol_type"), F.lit(1).alias("endpoint_id"), F.lit("NTLM").alias("auth_scheme"))
    return S.insecure_connections(rows, t.supplier.select("s_suppkey")).select("net_transport", "protocol_type", "connections")


def pages(t):
    return t.lineitem.select(F.col("l_orderkey").alias("session_id"), F.col("l_quantity").cast("bigint").alias("user_objects_alloc_page_count"), F.col("l_linenumber").cast("bigint").alias("user_objects_dealloc_page_count"),
                             F.col("l_suppkey").alias("internal_objects_alloc_page_count"), F.lit(2).alias("internal_objects_dealloc_page_count"))


@query("k36_temp_space", """
SELECT l_orderkey AS session_id, CAST(sum(CAST(l_quantity AS BIGINT) + l_suppkey) AS BIGINT) AS allocated_pages, CAST(sum(l_linenumber + 2) AS BIGINT) AS deallocated_pages,
  CAST(sum(CAST(l_quantity AS BIGINT) + l_suppkey - l_linenumber - 2) * 8 AS BIGINT) AS net_kb, any_value(o_orderstatus) AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey > 50 GROUP BY 1""")
def _(t):
    sessions = t.orders.select(F.col("o_orderkey").alias("session_id"), F.col("o_orderstatus").alias("status"))
    return S.temp_space(pages(t), sessions).select("session_id", "allocated_pages", "deallocated_pages", "net_kb", "status")


@query("k36_temp_space_running", """
SELECT o_orderkey AS session_id, CAST((o_custkey + a) // 128 AS BIGINT) AS allocated_mb, CAST((10 + d) // 128 AS BIGINT) AS deallocated_mb FROM orders
JOIN (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS a, sum(l_linenumber) AS d FROM lineitem GROUP BY 1 HAVING a > 127) ON l_orderkey = o_orderkey""")
def _(t):
    session_pages = t.orders.select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_objects_alloc_page_count"), F.lit(10).alias("user_objects_dealloc_page_count"))
    requests = t.orders.select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("sql_handle"))
    return S.temp_space_running(session_pages, pages(t), requests).drop("sql_handle")


@query("k36_temp_space_tasks", """
SELECT l_orderkey AS session_id, CAST(sum(CAST(l_quantity AS BIGINT) + l_linenumber + l_suppkey + 2) // 128 AS BIGINT) AS reserved_mb FROM lineitem GROUP BY 1 ORDER BY reserved_mb DESC, session_id LIMIT 10""")
def _(t):
    return S.temp_space_tasks(pages(t))


@query("k37_memory_grants", f"""
SELECT o_orderkey AS session_id, {fx('floor(o_totalprice) / 1024.0', 2)} AS granted_mb, o_orderdate < coalesce(shipped, TIMESTAMP '9999-12-31') AS waiting
FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def _(t):
    shipped = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("grant_time"))
    grants = t.orders.join(shipped, "o_orderkey", "left").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("request_time"), "grant_time",
                                                                 F.floor("o_totalprice").alias("granted_memory_kb"), F.lit(0).alias("used_memory_kb"))
    return S.memory_grants(grants).select("session_id", "granted_mb", "waiting")


@query("k120_wait_info", """
WITH w AS (SELECT o_custkey AS session_id, o_orderpriority AS wt, count(*) AS n, min(floor(o_totalprice)) AS lo, sum(CAST(floor(o_totalprice) AS BIGINT)) // count(*) AS mid, max(floor(o_totalprice)) AS hi,
  max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS b FROM orders GROUP BY 1, 2)
SELECT session_id, string_agg('(' || n || 'x: ' || CASE WHEN n = 1 OR lo = hi THEN CAST(CAST(hi AS BIGINT) AS VARCHAR) WHEN n = 2 THEN CAST(lo AS BIGINT) || '/' || CAST(hi AS BIGINT)
  ELSE CAST(lo AS BIGINT) || '/' || mid || '/' || CAST(hi AS BIGINT) END || 'ms)' || wt, ', ' ORDER BY b DESC, n DESC, wt) AS wait_info FROM w GROUP BY 1""")
def _(t):
    waits = t.orders.select(F.col("o_custkey").alias("session_id"), F.col("o_orderpriority").alias("wait_type"), F.floor("o_totalprice").alias("wait_duration_ms"),
                            F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("block_info"))
    return S.wait_info(waits, "session_id")


@query("k121_lock_tree", """
WITH c AS (SELECT l_orderkey AS s, l_returnflag AS d, l_linestatus AS o, CASE WHEN l_linenumber = 1 THEN 'DATABASE' ELSE 'KEY' END AS r, l_linenumber AS m, count(*) AS n FROM lineitem GROUP BY ALL),
o AS (SELECT s, d, o, string_agg(m || 'x' || n, ',' ORDER BY m) AS locks FROM (SELECT s, d, o, m, n FROM c WHERE r = 'KEY') GROUP BY 1, 2, 3),
k AS (SELECT s, d, string_agg(o || '=' || locks, ';' ORDER BY o) AS objects FROM o GROUP BY 1, 2),
b AS (SELECT s, d, string_agg(m || 'x' || n, ',' ORDER BY m, n) AS own FROM (SELECT s, d, m, sum(n) AS n FROM c WHERE r = 'DATABASE' GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT coalesce(b.s, k.s) AS session_id, coalesce(b.d, k.d) AS database_name, own, coalesce(objects, '') AS objects FROM b FULL JOIN k ON b.s = k.s AND b.d = k.d""")
def _(t):
    locks = t.lineitem.select(F.col("l_orderkey").alias("session_id"), F.col("l_returnflag").alias("database_name"), F.col("l_linestatus").alias("object_name"),
                              F.when(F.col("l_linenumber") == 1, "DATABASE").otherwise("KEY").alias("resource_type"), F.col("l_linenumber").cast("string").alias("request_mode"), F.lit("GRANT").alias("request_status"))
    brief = lambda arr: F.array_join(F.transform(arr, lambda l: F.concat(l["request_mode"], F.lit("x"), l["request_count"].cast("string"))), ",")
    return S.lock_tree(locks).select("session_id", "database_name", brief(F.col("database_locks")).alias("own"),
                                     F.array_join(F.transform("objects", lambda o: F.concat(o["object_name"], F.lit("="), brief(o["locks"]))), ";").alias("objects"))


@query("k122_tran_log_writes", """
SELECT user_id AS session_id, string_agg(event_type || ':w' || n || ' (' || b // 1024 || ' kB)', ', ' ORDER BY event_type) AS tran_log_writes
FROM (SELECT user_id, event_type, count(*) AS n, CAST(sum(CAST(value * 100 AS BIGINT)) AS BIGINT) AS b FROM events GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    return S.tran_log_writes(t.events.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("database_name"), F.lit(1).alias("log_records"), F.round(F.col("value") * 100).cast("bigint").alias("log_bytes")))


@query("k123_top_wait", """
SELECT o_custkey AS session_id, o_orderkey AS task_id, w AS wait_type FROM (SELECT *, CASE WHEN o_orderstatus = 'O' THEN 'LCK_M_X' ELSE o_orderpriority END AS w FROM orders)
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN w LIKE 'LCK%' THEN 1 ELSE 99 END, floor(o_totalprice) DESC, o_orderkey) = 1""")
def _(t):
    waits = t.orders.select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("task_id"), F.when(F.col("o_orderstatus") == "O", "LCK_M_X").otherwise(F.col("o_orderpriority")).alias("wait_type"),
                            F.floor("o_totalprice").alias("wait_time"), F.lit(0).alias("blocked"))
    return S.top_wait_per_request(waits, "session_id").select("session_id", "task_id", "wait_type")


@query("k124_memory_info", """
SELECT c_custkey AS session_id, o_totalprice AS granted, s_acctbal AS semaphore_size, n_name AS group_name, r_name AS pool_name FROM customer
LEFT JOIN orders ON o_orderkey = c_custkey LEFT JOIN supplier ON s_suppkey = o_custkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 0) ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def _(t):
    sessions = t.customer.select(F.col("c_custkey").alias("session_id"), F.col("c_nationkey").alias("group_id"))
    grants = t.orders.select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("semaphore_id"), F.col("o_totalprice").alias("granted"))
    semaphores = t.supplier.select(F.col("s_suppkey").alias("semaphore_id"), F.col("s_acctbal").alias("size"))
    groups = t.nation.where("n_regionkey <> 0").select(F.col("n_nationkey").alias("group_id"), F.col("n_regionkey").alias("pool_id"), F.col("n_name").alias("name"))
    pools = t.region.select(F.col("r_regionkey").alias("pool_id"), F.col("r_name").alias("name"))
    return S.memory_info(sessions, grants, semaphores, groups, pools).select(
        "session_id", "granted", F.col("semaphore.size").alias("semaphore_size"), F.col("workload_group.name").alias("group_name"), F.col("pool.name").alias("pool_name"))
