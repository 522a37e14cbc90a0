"""Group K.8: replication and replicas."""

from pyspark.sql import functions as F

from ..functions.scalars import int_div
from ..plans import replication as P
from .fixtures import events_as_of, fx, orders_as_of
from .registry import query


def tracers(t):
    """Orders with their first later shipment: the order is published, the shipment is its arrival."""
    later = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).where(F.col("l_shipdate") >= F.col("o_orderdate"))
    first = later.groupBy(F.col("o_orderkey").alias("tracer_id")).agg(F.min("l_shipdate").alias("subscriber_commit"))
    return first


TRACER_SQL = """SELECT o_orderkey AS tracer_id, o_custkey, o_orderdate AS pc, o_orderdate + INTERVAL 90 SECOND AS dc, (SELECT min(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate >= o_orderdate) AS sc FROM orders"""


@query("k93_tracer_latency", f"""
SELECT tracer_id, a.n_name AS publisher, b.n_name AS subscriber, CAST(90 AS BIGINT) AS pub_to_dist_sec, date_diff('second', dc, sc) AS dist_to_sub_sec, date_diff('second', pc, sc) AS total_latency_sec
FROM ({TRACER_SQL}) JOIN customer ON c_custkey = o_custkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN supplier ON s_suppkey = c_custkey % 100 JOIN nation b ON b.n_nationkey = s_nationkey WHERE sc IS NOT NULL""")
def _(t):
    tokens = t.orders.select(F.col("o_orderkey").alias("tracer_id"), F.col("o_custkey").alias("publication_id"), F.col("o_orderdate").alias("publisher_commit"), F.expr("o_orderdate + interval 90 seconds").alias("distributor_commit"))
    history = tracers(t).join(t.orders, F.col("tracer_id") == F.col("o_orderkey")).select(F.col("tracer_id").alias("parent_tracer_id"), (F.col("o_custkey") % 100).alias("agent_id"), "subscriber_commit")
    publications = t.customer.select(F.col("c_custkey").alias("publication_id"), F.col("c_nationkey").alias("publisher_id"), F.lit("db").alias("publisher_db"), F.col("c_name").alias("publication"))
    agents = t.supplier.select(F.col("s_suppkey").alias("agent_id"), F.col("s_nationkey").alias("subscriber_id"), F.lit("db").alias("subscriber_db"))
    servers = t.nation.select(F.col("n_nationkey").alias("server_id"), F.col("n_name").alias("name"))
    return P.tracer_latency(tokens, history, publications, agents, servers).select("tracer_id", "publisher", "subscriber", "pub_to_dist_sec", "dist_to_sub_sec", "total_latency_sec")


@query("k94_replication_lag", f"""
WITH x AS (SELECT o_custkey AS publication, tracer_id, pc, date_diff('second', pc, sc) AS lat FROM ({TRACER_SQL})),
u AS (SELECT * FROM x WHERE pc > TIMESTAMP '2001-12-31' - INTERVAL 17520 HOUR AND lat IS NOT NULL UNION ALL SELECT * FROM x WHERE lat IS NULL QUALIFY rank() OVER (PARTITION BY publication ORDER BY pc) = 1)
SELECT publication, tracer_id, coalesce(lat, date_diff('second', pc, TIMESTAMP '2001-12-31')) AS lag_sec, rank() OVER (PARTITION BY publication ORDER BY pc DESC) AS rank_order FROM u""")
def _(t):
    rows = t.orders.join(tracers(t), F.col("o_orderkey") == F.col("tracer_id"), "left")
    from ..functions.scalars import boundaries

    rows = rows.select(F.col("o_custkey").alias("publication"), F.col("o_orderkey").alias("tracer_id"), F.col("o_orderdate").alias("publisher_commit"), boundaries("second", "o_orderdate", "subscriber_commit").alias("total_latency_sec"))
    return P.replication_lag(rows, orders_as_of(), hours=17520, keys=["publication"]).select("publication", "tracer_id", "lag_sec", "rank_order")


def agents(t):
    """Customers as distribution agents of the database of their nation."""
    return t.customer.select(F.col("c_custkey").alias("agent_id"), F.col("c_nationkey").alias("publisher_database_id"), F.col("c_mktsegment").alias("publication"), F.col("c_custkey").alias("subscriber_db"))


def commands(t):
    return t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("publisher_database_id"), F.col("l_orderkey").alias("xact_seqno"))


@query("k95_pending_commands", """
WITH m AS (SELECT c_nationkey AS publisher_database_id, c_mktsegment AS publication, c_custkey AS subscriber_db, max(o_orderkey) FILTER (o_orderstatus = 'F') AS last_xact_seqno FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3)
SELECT m.*, CAST(count(*) AS BIGINT) AS pending_commands FROM m JOIN supplier ON s_nationkey = publisher_database_id JOIN lineitem ON l_suppkey = s_suppkey AND l_orderkey > coalesce(last_xact_seqno, -1) GROUP BY ALL""")
def _(t):
    history = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("agent_id"), F.col("o_orderkey").alias("xact_seqno"))
    return P.pending_commands(agents(t).withColumn("subscriber_db", F.col("subscriber_db").cast("string")), history, commands(t)).withColumn("subscriber_db", F.col("subscriber_db").cast("bigint"))


@query("k96_large_transactions", """
SELECT o_orderdate AS entry_time, o_orderkey AS xact_seqno, CAST(count(*) AS BIGINT) AS command_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND o_orderdate >= TIMESTAMP '1998-07-01' GROUP BY 1, 2 HAVING count(*) > 2""")
def _(t):
    cmds = t.lineitem.select(F.col("l_returnflag").alias("publisher_database_id"), F.col("l_orderkey").alias("xact_seqno"))
    trans = t.orders.select(F.lit("R").alias("publisher_database_id"), F.col("o_orderkey").alias("xact_seqno"), F.col("o_orderdate").alias("entry_time"))
    dbs = t.lineitem.select(F.col("l_returnflag").alias("publisher_database_id"), F.concat(F.lit("db_"), "l_returnflag").alias("publisher_db")).distinct()
    return P.large_transactions(cmds, trans, dbs, "db_R", F.expr("timestamp_ntz'1998-07-01 09:30:00'"), n=2)


def agent_rows(t):
    """Events as history rows of their user's agent."""
    stats = F.concat(F.lit('<stats state="1" work="'), F.floor("value").cast("string"), F.lit('" idle="2" cmds="'), (F.col("event_id") * 3).cast("string"), F.lit('"/>'))
    return t.events.select(F.col("user_id").alias("agent_id"), F.col("event_id").alias("xact_seqno"), F.col("event_id").alias("row_id"), F.col("ts").alias("time"), F.col("ts").alias("start_time"), stats.alias("comments"), F.col("event_type").alias("runstatus"))


@query("k97_agent_progress", """
WITH x AS (SELECT *, row_number() OVER (ORDER BY event_id DESC) AS rn FROM events WHERE user_id = 7 ORDER BY event_id DESC LIMIT 10)
SELECT event_id AS xact_seqno, CAST(floor(value) AS INTEGER) AS stats_work, CAST(event_id * 3 - lead(event_id * 3) OVER w AS INTEGER) AS cmd_diff, date_diff('minute', lead(ts) OVER w, ts) AS minutes_between_rows FROM x WINDOW w AS (ORDER BY rn)""")
def _(t):
    return P.agent_progress(agent_rows(t), 7).select("xact_seqno", "stats_work", "cmd_diff", "minutes_between_rows")


@query("k98_agent_history", """
SELECT user_id AS agent_id, event_id AS xact_seqno, ts AS time FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 240 HOUR ORDER BY ts DESC, event_id LIMIT 1000""")
def _(t):
    return P.agent_history(agent_rows(t), events_as_of(), hours=240).select("agent_id", "xact_seqno", "time")


@query("k98_recent_errors", "SELECT event_id AS error_id, ts AS time FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-31' - INTERVAL 14 DAY ORDER BY ts DESC, event_id LIMIT 1000")
def _(t):
    errors = t.events.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("ts").alias("time"))
    return P.recent_errors(errors, events_as_of(), days=14)


@query("k98_last_delivered", "SELECT user_id AS agent_id, max(event_id) AS last_delivered_seqno FROM events GROUP BY 1")
def _(t):
    return P.last_delivered(agent_rows(t))


@query("k98_next_after", """
SELECT user_id AS publisher_database_id, event_id AS xact_seqno, ts AS entry_time FROM events WHERE event_id > user_id * 5 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""")
def _(t):
    trans = t.events.select(F.col("user_id").alias("publisher_database_id"), F.col("event_id").alias("xact_seqno"), F.col("ts").alias("entry_time"))
    marks = t.events.select(F.col("user_id").alias("publisher_database_id"), (F.col("user_id") * 5).alias("last_seqno")).distinct()
    return P.next_after(trans, marks)


@query("k99_subscriptions", """
SELECT DISTINCT n_name AS publication, r_name AS publisher_db, s_suppkey AS agent_id, CASE WHEN c.c_mktsegment IS NULL THEN NULL WHEN c.c_mktsegment = 'BUILDING' THEN 'Subscribed' ELSE 'Active' END AS subscription_status
FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer c ON c.c_custkey = s_suppkey AND c.c_acctbal >= 0""")
def _(t):
    pubs = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("publication"), F.col("r_name").alias("publisher_db"))
    ag = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("publication"), F.col("s_suppkey").alias("agent_id"), F.col("s_suppkey").cast("string").alias("subscriber_db"))
    subs = (t.customer.where("c_acctbal >= 0").join(t.supplier, F.col("c_custkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("r_name").alias("publisher_db"), F.col("c_custkey").cast("string").alias("subscriber_db"), F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(2).alias("status")))
    dbs = t.region.select(F.col("r_name").alias("publisher_db"))
    return P.subscriptions(pubs, ag, subs, dbs).select("publication", "publisher_db", "agent_id", "subscription_status")


@query("k99_to_reinitialise", "SELECT c_custkey AS agent_id, s_name AS subscriber FROM customer JOIN supplier ON s_suppkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(t):
    subs = t.customer.select(F.col("c_custkey").alias("agent_id"), F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(2).alias("status"))
    return P.to_reinitialise(subs, t.supplier.select(F.col("s_suppkey").alias("agent_id"), F.col("s_name").alias("subscriber"))).drop("status")


@query("k99_latest_snapshot", """
SELECT c_nationkey AS publisher_db, c_mktsegment AS publication, max(o_orderdate) AS last_snapshot_start, max(o_orderkey) AS last_snapshot_commands FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey GROUP BY 1, 2""")
def _(t):
    ag = t.customer.select(F.col("c_custkey").alias("agent_id"), F.col("c_nationkey").alias("publisher_db"), F.col("c_mktsegment").alias("publication"))
    hist = t.orders.select(F.col("o_custkey").alias("agent_id"), F.when(F.col("o_orderstatus") == "P", 2).otherwise(3).alias("runstatus"), F.col("o_orderdate").alias("start_time"), F.col("o_orderkey").alias("delivered_commands"))
    return P.latest_snapshot(ag, hist)


@query("k100_topology", """
WITH p AS (SELECT r_name, n_name, n_nationkey, r_name || ' / ' || n_name AS p FROM nation JOIN region ON r_regionkey = n_regionkey),
a AS (SELECT s_nationkey, count(*) AS n, sum(s_suppkey) AS r FROM supplier GROUP BY 1),
x AS (SELECT DISTINCT 1 AS depth, 'publisher' AS node, r_name AS path, r_name AS label FROM p
UNION ALL SELECT 2, 'publication', p, n_name || ' (Publication ID: ' || n_nationkey || '; Publication type: Transactional (1-way); Publication database: ' || r_name || ')' FROM p
UNION ALL SELECT 3, 'articles', p || ' / articles', CASE WHEN n IS NULL THEN '0 article(s)' ELSE n || ' article(s); Reserved Space = ' || r || ' KB, Used Space = ' || r || ' KB, Index Space = ' || r || ' KB' END FROM p LEFT JOIN a ON s_nationkey = n_nationkey
UNION ALL SELECT 3, 'subscriber', p || ' / subscribers / ' || c_name, c_name || ' (Subscription database: ' || c_mktsegment || ')' FROM p JOIN customer ON c_nationkey = n_nationkey)
SELECT depth, node, path, label, repeat(' ', (depth - 1) * 6 + 1) || '|---- ' || label AS line FROM x""")
def _(t):
    pubs = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("publication_id"), F.col("n_name").alias("publication"), F.col("r_name").alias("publisher"),
                                                                                       F.col("r_name").alias("publication_db"), F.lit(0).alias("publication_type"), F.lit(False).alias("allow_queued"))
    kb = F.col("s_suppkey")
    articles = t.supplier.select(F.col("s_nationkey").alias("publication_id"), kb.alias("reserved_kb"), kb.alias("used_kb"), kb.alias("index_kb"))
    subs = t.customer.select(F.col("c_nationkey").alias("publication_id"), F.col("c_name").alias("subscriber"), F.col("c_mktsegment").alias("subscription_db"))
    return P.topology(pubs, articles, subs)


@query("k101_replica_health", """
SELECT s_nationkey AS database_id, CAST(sum(s_suppkey) AS DOUBLE) / count(*) AS avg_lag_seconds, CAST(count(*) FILTER (s_acctbal >= 3000) AS BIGINT) AS non_healthy, CAST(count(*) FILTER (s_acctbal < 0) AS BIGINT) AS non_online, CAST(count(*) FILTER (s_acctbal > 9000) AS BIGINT) AS suspended
FROM supplier GROUP BY 1""")
def _(t):
    states = t.supplier.select(F.col("s_nationkey").alias("database_id"), F.col("s_suppkey").alias("secondary_lag_seconds"), F.when(F.col("s_acctbal") < 3000, 2).otherwise(0).alias("synchronization_health"),
                               F.when(F.col("s_acctbal") < 0, 1).otherwise(0).alias("database_state"), F.when(F.col("s_acctbal") > 9000, 1).otherwise(0).alias("is_suspended"))
    return P.replica_health(states)


@query("k101_replica_status", """
SELECT o_orderkey AS state_id, coalesce(s_name, n_name) AS replica_role, date_diff('millisecond', o_orderdate, o_orderdate + to_seconds(o_orderkey % 100)) / 1024.0 AS last_redo_delay_sec FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey LEFT JOIN nation ON n_nationkey = o_custkey % 30""")
def _(t):
    states = t.orders.select(F.col("o_orderkey").alias("state_id"), F.col("o_custkey").alias("replica_id"), (F.col("o_custkey") % 30).alias("group_database_id"), F.col("o_orderdate").alias("last_commit_time"),
                             F.timestamp_add("SECOND", (F.col("o_orderkey") % 100).cast("int"), F.col("o_orderdate")).alias("last_redone_time"))
    fabric = t.supplier.select(F.col("s_suppkey").alias("replica_id"), F.col("s_name").alias("fabric_role"), F.col("s_name").alias("replication_endpoint_url"))
    links = t.nation.select(F.col("n_nationkey").alias("group_database_id"), F.col("n_name").alias("link_type"), F.col("n_name").alias("partner_server"))
    return P.replica_status(states, fabric, links).select("state_id", "replica_role", "last_redo_delay_sec")


@query("k101_group_replicas", "SELECT r_name AS group_name, n_name AS replica, c_custkey AS state_id FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey")
def _(t):
    groups = t.region.select(F.col("r_regionkey").alias("group_id"), F.col("r_name").alias("group_name"))
    replicas = t.nation.select(F.col("n_regionkey").alias("group_id"), F.col("n_nationkey").alias("replica_id"), F.col("n_name").alias("replica"))
    return P.group_replicas(groups, replicas, t.customer.select(F.col("c_nationkey").alias("replica_id"), F.col("c_custkey").alias("state_id"))).select("group_name", "replica", "state_id")


@query("k101_problem_replicas", "SELECT s_suppkey AS replica_id FROM supplier WHERE s_acctbal >= 3000 OR s_acctbal < 0")
def _(t):
    states = t.supplier.select(F.col("s_suppkey").alias("replica_id"), F.when(F.col("s_acctbal") < 3000, 2).otherwise(0).alias("synchronization_health"), F.when(F.col("s_acctbal") < 0, 1).otherwise(0).alias("database_state"),
                               F.lit(0).alias("is_suspended"), F.lit(0).alias("synchronization_state"), F.lit(False).alias("is_commit_participant"))
    return P.problem_replicas(states).select("replica_id")


@query("k102_seeding", """
SELECT o_orderkey AS operation_id, CAST(o_totalprice * 100 AS BIGINT) * 1000 // 1024 // 1024 AS database_mb, l.q * 1000000 // 1024 // 1024 AS transferred_mb, o_orderkey // 1000 AS disk_wait_sec FROM orders
JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""")
def _(t):
    done = t.lineitem.groupBy(F.col("l_orderkey").alias("operation_id")).agg((F.sum("l_quantity").cast("bigint") * 1000000).alias("transferred_size_bytes"))
    stats = t.orders.select(F.col("o_orderkey").alias("operation_id"), (F.round(F.col("o_totalprice") * 100).cast("bigint") * 1000).alias("database_size_bytes"), F.lit(0).alias("transfer_rate_bytes_per_second"),
                            F.col("o_orderkey").alias("disk_io_wait_ms"), F.lit(0).alias("network_wait_ms"))
    return P.seeding(stats, done).select("operation_id", "database_mb", "transferred_mb", "disk_wait_sec")


@query("k103_failover_events", """
SELECT ts AS failover_time, 'SECONDARY' AS previous_state, event_type AS current_state, 'group_' || user_id AS group_name, 'replica_' || event_id AS new_primary FROM events WHERE event_type = 'error'""")
def _(t):
    field = lambda name, value, text: F.concat(F.lit(f'<data name="{name}"><value>'), value, F.lit("</value><text>"), text, F.lit("</text></data>"))
    doc = F.concat(F.lit('<event name="availability_replica_state_change" timestamp="'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('">'), field("previous_state", F.lit("2"), F.lit("SECONDARY")),
                   field("current_state", F.when(F.col("event_type") == "error", "1").otherwise("2"), F.col("event_type")), field("availability_group_name", F.concat(F.lit("group_"), F.col("user_id").cast("string")), F.lit("")),
                   field("availability_replica_name", F.concat(F.lit("replica_"), F.col("event_id").cast("string")), F.lit("")), F.lit("</event>"))
    return P.failover_events(t.events.select(doc.alias("event_data")))
