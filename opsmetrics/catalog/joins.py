"""Group C: joins."""

from pyspark.sql import functions as F

from ..functions.xml import explode_events
from ..operators import joins as J
from ..operators.windows import neighbour, running, time_block
from .fixtures import COUNTERS_SQL, TREE_SQL, money
from .registry import query


@query("c1_inner_join", """
SELECT n_name, CAST(count(*) AS BIGINT) AS lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def _(t):
    return (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
            .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .groupBy("n_name").agg(F.count(F.lit(1)).alias("lines"),
                                   F.sum(money("l_extendedprice")).cast("double").alias("revenue")))


@query("c2_left_join", """
SELECT c_custkey, o_orderkey, o_orderdate FROM customer LEFT JOIN orders
ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-01-01'""")
def _(t):
    on = ((F.col("o_custkey") == F.col("c_custkey"))
          & (F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")))
    return t.customer.join(t.orders, on, "left").select("c_custkey", "o_orderkey", "o_orderdate")


@query("c3_anti_join", """
SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL""")
def _(t):
    return J.not_exists(t.documents, t.labels, "doc_id").select("doc_id", "source")


@query("c4_self_join", f"""
WITH tree AS ({TREE_SQL})
SELECT a.sid, a.blk, b.wait_type AS blocker_wait, b.wait_ms AS blocker_ms
FROM tree a LEFT JOIN tree b ON a.blk = b.sid""")
def _(t):
    tree = t.customer_tree()
    return (J.parent_of(tree, "sid", "blk", {"blocker_wait": "wait_type", "blocker_ms": "wait_ms"})
            .select("sid", "blk", "blocker_wait", "blocker_ms"))


@query("c5_running_total", """
SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE)
  AS running_value FROM events""")
def _(t):
    ev = t.events.select("event_id", "ts", money("value").alias("v"), time_block("ts").alias("slice"))
    return (running(ev, [], ["ts", "event_id"], "slice", {"running_value": "v"})
            .select("event_id", F.col("running_value").cast("double").alias("running_value")))


@query("c6_past_mark", """
WITH marks AS (SELECT c_custkey, max(o_orderkey) AS mark FROM customer
  LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey, o_orderkey FROM marks JOIN orders ON o_custkey = c_custkey AND o_orderkey > coalesce(mark, -1)""")
def _(t):
    done = t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("mark"))
    marks = t.customer.select("c_custkey").join(done, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "mark")
    facts = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return J.newer_than_mark(marks, facts, "c_custkey", "mark", "o_orderkey").select("c_custkey", "o_orderkey")


@query("c7_row_offset", """
SELECT event_id, lag(event_id) OVER w AS previous_event, value - lag(value) OVER w AS step
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def _(t):
    ev = t.events.withColumn("slice", time_block("ts"))
    out = neighbour(ev, "user_id", ["ts", "event_id"], "slice", {"previous_event": "event_id", "pv": "value"})
    return out.select("event_id", "previous_event", (F.col("value") - F.col("pv")).alias("step"))


@query("c8_batch_offset", f"""
WITH c AS ({COUNTERS_SQL})
SELECT b.counter, b.batch, b.wait_ms - a.wait_ms AS wait_ms FROM c b JOIN c a
ON a.counter = b.counter AND a.batch = b.batch - 1""")
def _(t):
    now = t.daily_counters()
    before = now.select("counter", F.date_add("batch", 1).alias("batch"), F.col("wait_ms").alias("base"))
    return now.join(before, ["counter", "batch"]).select("counter", "batch", (F.col("wait_ms") - F.col("base")).alias("wait_ms"))


@query("c9_scalar_cross", """
SELECT event_id, value / (SELECT max(value) FROM events) AS of_max FROM events""")
def _(t):
    top = t.events.agg(F.max("value")).scalar()
    return t.events.select("event_id", (F.col("value") / top).alias("of_max"))


TIERS = [(5, 500, 100), (10, 2300, 150), (20, 5000, 200), (45, 7500, 250)]


@query("c10_ceiling_lookup", """
SELECT p_partkey, tier, iops FROM part, LATERAL (SELECT * FROM (VALUES (5, 500), (10, 2300), (20, 5000), (45, 7500)) v(tier, iops)
WHERE tier >= p_size ORDER BY tier LIMIT 1)""")
def _(t):
    return (J.ceiling_lookup(t.part, TIERS, ["tier", "iops", "mbps"], "p_size")
            .select("p_partkey", "tier", "iops"))


@query("c10_ceiling_join", """
SELECT c_custkey, s_acctbal AS bound FROM customer ASOF JOIN (SELECT DISTINCT s_acctbal FROM supplier) ON s_acctbal >= c_acctbal""")
def _(t):
    bounds = t.supplier.select("s_acctbal").distinct()
    return (J.ceiling_join(t.customer.select("c_custkey", "c_acctbal"), bounds, "c_acctbal", "s_acctbal")
            .select("c_custkey", F.col("s_acctbal").alias("bound")))


@query("c11_last_n", """
SELECT c_custkey, o_orderkey, o_orderdate FROM customer LEFT JOIN
(SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3)
ON o_custkey = c_custkey""")
def _(t):
    facts = (t.orders.where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))
             .select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate"))
    order = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    return (J.last_n_per_key(t.customer, facts, "c_custkey", order, 3)
            .select("c_custkey", "o_orderkey", "o_orderdate"))


@query("c12_lookup", """
SELECT l_orderkey, l_partkey, p_name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_type = 'ECONOMY') ON l_partkey = p_partkey""")
def _(t):
    texts = t.part.where("p_type = 'ECONOMY'").select("p_partkey", "p_name")
    return (J.lookup(t.lineitem, texts, F.col("l_partkey") == F.col("p_partkey"), keep_unmatched=True)
            .select("l_orderkey", "l_partkey", "p_name"))


@query("c13_shred", """
SELECT event_id, unnest(['duration', 'props']) AS field, unnest([CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), props]) AS text
FROM events""")
def _(t):
    rows = explode_events(t.events_xml(), "event_data", tag="data", schema="_name string, value string")
    return rows.select("event_id", F.col("data._name").alias("field"), F.col("data.value").alias("text"))


@query("c14_apply_aggregate", """
SELECT c_custkey, o_orderstatus, n FROM customer JOIN
(SELECT o_custkey, o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL) ON o_custkey = c_custkey""")
def _(t):
    counts = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return (t.customer.join(counts, F.col("c_custkey") == F.col("o_custkey"))
            .select("c_custkey", "o_orderstatus", "n"))


@query("c15_contains_join", """
SELECT d.doc_id, n_name FROM documents d JOIN (SELECT DISTINCT lang AS n_name FROM documents) ON contains(lower(d.text), lower(n_name))""")
def _(t):
    names = t.documents.select(F.col("lang").alias("n_name")).distinct()
    return J.contains_join(t.documents.select("doc_id", "text"), names, "text", "n_name", ignore_case=True).select("doc_id", "n_name")


@query("c15_contains_join_many", """
SELECT c_custkey, word FROM customer JOIN (SELECT DISTINCT s_name[-3:] AS word FROM supplier) ON contains(c_name, word)""")
def _(t):
    words = t.supplier.select(F.right("s_name", F.lit(3)).alias("word")).distinct()
    return J.contains_join(t.customer, words, "c_name", "word", few=20).select("c_custkey", "word")


LISTS_SQL = """
SELECT o_custkey AS grp, o_orderkey AS id, list(l_partkey % 3 ORDER BY l_linenumber, l_partkey, l_suppkey) AS keys
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"""


@query("c16_prefix_join", f"""
WITH x AS ({LISTS_SQL})
SELECT a.grp, a.id, min(b.id) AS covered_by, CAST(count(*) AS BIGINT) AS covering FROM x a JOIN x b
ON a.grp = b.grp AND len(a.keys) < len(b.keys) AND a.keys = b.keys[1:len(a.keys)] GROUP BY 1, 2""")
def _(t):
    return J.prefix_join(line_lists(t), "grp", "keys", "id").select("grp", "id", "covered_by", "covering")


def line_lists(t):
    """One key list per order, grouped by customer: stands for the indexes of a table."""
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 3).alias("k"))
    return (lines.groupBy(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("id"))
            .agg(F.transform(F.sort_array(F.collect_list(entry)), lambda r: r["k"]).alias("keys")))


@query("c17_equal_payload", f"""
WITH x AS ({LISTS_SQL})
SELECT grp, id, min(id) OVER w AS first_id, CAST(count(*) OVER w AS BIGINT) AS copies FROM x
WINDOW w AS (PARTITION BY grp, keys) QUALIFY count(*) OVER w > 1""")
def _(t):
    return J.first_of_equals(line_lists(t), ["grp", "keys"], "id").select("grp", "id", "first_id", "copies")


@query("c18_either_key", """
SELECT l_orderkey, l_partkey, l_suppkey, s_suppkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey OR s_suppkey = l_partkey""")
def _(t):
    pairs = [("l_suppkey", "s_suppkey"), ("l_partkey", "s_suppkey")]
    return (J.either_key_join(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey"), t.supplier, pairs)
            .select("l_orderkey", "l_partkey", "l_suppkey", "s_suppkey"))


@query("c19_role_join", """
SELECT l_orderkey, l_partkey, cn.n_name AS buyer_n_name, sn.n_name AS seller_n_name
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN nation sn ON sn.n_nationkey = s_nationkey""")
def _(t):
    lines = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
             .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
             .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")))
    return (J.role_join(lines, t.nation, "n_nationkey", {"buyer": "c_nationkey", "seller": "s_nationkey"}, ["n_name"])
            .select("l_orderkey", "l_partkey", "buyer_n_name", "seller_n_name"))


@query("c20_right_join", """
SELECT c_custkey, n_name, r_name FROM region RIGHT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) ON n_regionkey = r_regionkey
RIGHT JOIN customer ON c_nationkey = n_nationkey""")
def _(t):
    nations = t.nation.where("n_regionkey <> 1")
    return (t.region.join(nations, F.col("n_regionkey") == F.col("r_regionkey"), "right")
            .join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "right")
            .select("c_custkey", "n_name", "r_name"))
