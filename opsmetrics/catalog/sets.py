"""Group G: set operations."""

from pyspark.sql import functions as F

from ..operators import sets as S
from .fixtures import EVENTS_SPLIT
from .registry import query


@query("g1_union", """
SELECT c_nationkey AS nation, c_mktsegment AS kind FROM customer UNION SELECT s_nationkey, 'SUPPLIER' FROM supplier""")
def _(t):
    a = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("kind"))
    b = t.supplier.select(F.col("s_nationkey").alias("nation"), F.lit("SUPPLIER").alias("kind"))
    return S.union_distinct(a, b)


@query("g2_union_all", """
SELECT o_orderkey, 'done' AS branch FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, 'open' FROM orders WHERE o_orderstatus <> 'F'""")
def _(t):
    done = F.col("o_orderstatus") == "F"
    part = lambda cond, label: t.orders.where(cond).select("o_orderkey", F.lit(label).alias("branch"))
    return part(done, "done").unionByName(part(~done, "open"))


@query("g3_set_diff", """
SELECT DISTINCT c.name, s.name IS NOT NULL AS in_both FROM (SELECT DISTINCT right(c_name, 3) AS name FROM customer) c
LEFT JOIN (SELECT DISTINCT right(s_name, 3) AS name FROM supplier) s ON s.name = c.name""")
def _(t):
    tail = lambda df, c: df.select(F.right(c, F.lit(3)).alias("name")).distinct()
    return S.set_diff(tail(t.customer, "c_name"), tail(t.supplier, "s_name"), "name", "report")


@query("g4_append_new", """
SELECT e.event_id, e.user_id FROM events e WHERE e.user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02')""")
def _(t):
    seen = t.events.where(F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz"))
    return S.append_new(seen, t.events, "user_id").select("event_id", "user_id")


@query("g5_unique_key", """
SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS kept FROM documents""")
def _(t):
    docs = t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))
    kept, rejected = S.split_dup_key(docs, "digest", "doc_id")
    return (kept.select("doc_id", F.lit(True).alias("kept"))
            .unionByName(rejected.select("doc_id", F.lit(False).alias("kept"))))
