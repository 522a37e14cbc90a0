"""Group K.3: workload statistics and plan history."""

from pyspark.sql import functions as F

from ..functions.scalars import int_div
from ..plans import workload as P
from .fixtures import fx, orders_as_of
from .registry import query


def cents(c):
    return F.round(F.col(c) * 100).cast("bigint")


def statement_stats(t, lines=None):
    """One row per part: stands for a cached statement."""
    lines = t.lineitem if lines is None else lines
    g = lines.groupBy(F.col("l_partkey").alias("query_id")).agg(
        F.count(F.lit(1)).alias("execution_count"), F.sum(cents("l_extendedprice")).alias("total_worker_time"), F.sum(F.col("l_quantity").cast("bigint")).alias("total_logical_reads"),
        F.sum("l_linenumber").alias("total_logical_writes"), F.sum("l_suppkey").alias("total_elapsed_time"), F.min("l_shipdate").alias("creation_time"))
    return g


STATS_SQL = """SELECT l_partkey AS query_id, CAST(count(*) AS BIGINT) AS execution_count, CAST(sum(CAST(l_extendedprice * 100 AS BIGINT)) AS BIGINT) AS total_worker_time,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_logical_reads, CAST(sum(l_linenumber) AS BIGINT) AS total_logical_writes, CAST(sum(l_suppkey) AS BIGINT) AS total_elapsed_time,
  min(l_shipdate) AS creation_time FROM lineitem {where} GROUP BY 1"""
STATS = STATS_SQL.format(where="")
AVGS = """total_worker_time // execution_count AS avg_worker_time, total_elapsed_time // execution_count AS avg_elapsed_time, total_logical_reads // execution_count AS avg_logical_reads,
  total_logical_writes // execution_count AS avg_logical_writes"""


@query("k38_top_statements", f"""
SELECT s.*, {AVGS}, total_worker_time AS ranked_by, execution_count // date_diff('minute', creation_time, TIMESTAMP '2001-12-31') AS calls_per_minute, p_name AS short_text,
  CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE 0 END AS has_missing_index FROM ({STATS}) s JOIN part ON p_partkey = query_id ORDER BY total_worker_time DESC, query_id LIMIT 50""")
def _(t):
    plan = F.when(F.col("p_type") == "ECONOMY", "<Plan><MissingIndexes></Plan>").otherwise("<Plan/>")
    texts = t.part.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text"), plan.alias("query_plan"))
    return P.top_statements(statement_stats(t).join(texts, "query_id"), "worker_time", 50, orders_as_of())


@query("k38_top_average_io", f"""
SELECT s.*, {AVGS}, (total_logical_reads + total_logical_writes) // execution_count AS ranked_by FROM ({STATS}) s ORDER BY ranked_by DESC, query_id LIMIT 10""")
def _(t):
    return P.top_statements(statement_stats(t), "io", 10)


@query("k39_top_procedures", f"""
SELECT 'proc_' || query_id AS name, execution_count, total_logical_writes, total_logical_writes // execution_count AS avg_logical_writes, execution_count // date_diff('minute', creation_time, TIMESTAMP '2001-12-31') AS calls_per_minute
FROM ({STATS}) ORDER BY total_logical_writes DESC, name LIMIT 25""")
def _(t):
    procs = statement_stats(t).withColumn("name", F.concat(F.lit("proc_"), F.col("query_id").cast("string"))).withColumnRenamed("creation_time", "cached_time")
    return P.top_procedures(procs, "logical_writes", 25, orders_as_of()).select("name", "execution_count", "total_logical_writes", "avg_logical_writes", "calls_per_minute")


@query("k39_procedure_delta", f"""
WITH a AS (SELECT *, total_worker_time // execution_count AS w, total_elapsed_time // execution_count AS e FROM ({STATS_SQL.format(where="WHERE l_shipdate < TIMESTAMP '1998-07-01'")})),
b AS (SELECT *, total_worker_time // execution_count AS w, total_elapsed_time // execution_count AS e FROM ({STATS}))
SELECT query_id AS name, CAST(10 AS BIGINT) AS seconds_between, b.execution_count - a.execution_count AS delta_execution_count, b.total_worker_time - a.total_worker_time AS delta_total_worker_time,
  b.total_elapsed_time - a.total_elapsed_time AS delta_total_elapsed_time, b.w - a.w AS delta_avg_worker_time, b.e - a.e AS delta_avg_elapsed_time,
  CASE WHEN query_id % 7 = 0 THEN 0 ELSE b.execution_count // (query_id % 7) END AS calls_per_second FROM a JOIN b USING (query_id) ORDER BY b.total_worker_time DESC, query_id LIMIT 100""")
def _(t):
    late = F.lit("2001-12-31 00:00:10").cast("timestamp_ntz")
    cached = late - F.make_dt_interval(secs=F.col("query_id") % 7)
    sample = lambda df, at: df.withColumns({"sample_time": F.lit(at).cast("timestamp_ntz"), "cached_time": cached}).withColumnRenamed("query_id", "name")
    early = t.lineitem.where(F.col("l_shipdate") < F.lit("1998-07-01").cast("timestamp_ntz"))
    return P.procedure_delta(sample(statement_stats(t, early), "2001-12-31 00:00:00"), sample(statement_stats(t), "2001-12-31 00:00:10"))


@query("k40_top_functions", f"""
SELECT query_id AS name, total_worker_time, execution_count, total_elapsed_time // execution_count AS avg_elapsed_time FROM ({STATS}) ORDER BY total_worker_time DESC, query_id LIMIT 25""")
def _(t):
    return P.top_functions(statement_stats(t).withColumnRenamed("query_id", "name")).select("name", "total_worker_time", "execution_count", "avg_elapsed_time")


def plans(t):
    """Parts as cached plans."""
    return t.part.select(F.col("p_partkey").alias("plan_id"), F.when(F.col("p_size") < 20, "Adhoc").when(F.col("p_size") < 35, "Prepared").otherwise("Proc").alias("objtype"),
                         F.when(F.col("p_type") == "ECONOMY", "Parse Tree").otherwise("Compiled Plan").alias("cacheobjtype"),
                         (F.col("p_size") % 4).cast("bigint").alias("usecounts"), cents("p_retailprice").alias("size_in_bytes"), F.col("p_name").alias("text"))


PLANS = """SELECT p_partkey AS plan_id, CASE WHEN p_size < 20 THEN 'Adhoc' WHEN p_size < 35 THEN 'Prepared' ELSE 'Proc' END AS objtype, CASE WHEN p_type = 'ECONOMY' THEN 'Parse Tree' ELSE 'Compiled Plan' END AS cacheobjtype,
  CAST(p_size % 4 AS BIGINT) AS usecounts, CAST(round(p_retailprice * 100) AS BIGINT) AS size_in_bytes, p_name AS text FROM part"""


@query("k41_cache_composition", f"""
SELECT objtype, cacheobjtype, n AS plans, {fx('s / 1048576.0', 2)} AS size_mb, u AS uses, u // n AS avg_uses, CAST(u AS DOUBLE) / n AS avg_used, o AS single_use_plans, {fx('100.0 * o / CAST(n AS DOUBLE)', 2)} AS single_use_pct, {fx('(s // n) / 1024.0', 2)} AS avg_size_kb
FROM (SELECT objtype, cacheobjtype, CAST(count(*) AS BIGINT) AS n, CAST(sum(size_in_bytes) AS BIGINT) AS s, CAST(sum(usecounts) AS BIGINT) AS u, CAST(count(*) FILTER (usecounts = 1) AS BIGINT) AS o FROM ({PLANS}) GROUP BY 1, 2)""")
def _(t):
    return P.cache_composition(plans(t))


@query("k41_cache_bloat", f"""
SELECT o AS single_use_plans, n AS plans, {fx('100.0 * o / CAST(n AS DOUBLE)', 2)} AS single_use_pct, {fx('s1 / 1048576.0', 2)} AS single_use_mb, {fx('s / 1048576.0', 2)} AS cache_mb,
  CASE WHEN 100.0 * o / n > 50 THEN '*** ENABLE optimize for ad hoc workloads ***' ELSE 'OK' END AS recommendation
FROM (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(size_in_bytes) AS BIGINT) AS s, CAST(sum(size_in_bytes) FILTER (usecounts = 1) AS BIGINT) AS s1, CAST(count(*) FILTER (usecounts = 1) AS BIGINT) AS o FROM ({PLANS}))""")
def _(t):
    return P.cache_bloat(plans(t))


@query("k41_cache_pollution", f"""
SELECT objtype, n AS plans, s / 1048576.0 AS total_mb, u // n AS avg_uses, s1 / 1048576.0 AS single_use_mb, o AS single_use_plans, CAST(s1 AS DOUBLE) / CAST(s AS DOUBLE) * 100 AS wasted_pct
FROM (SELECT objtype, CAST(count(*) AS BIGINT) AS n, CAST(sum(size_in_bytes) AS BIGINT) AS s, CAST(sum(usecounts) AS BIGINT) AS u, CAST(sum(CASE WHEN usecounts = 1 THEN size_in_bytes ELSE 0 END) AS BIGINT) AS s1, CAST(count(*) FILTER (usecounts = 1) AS BIGINT) AS o FROM ({PLANS}) GROUP BY 1)""")
def _(t):
    return P.cache_pollution(plans(t))


@query("k42_cache_single_use", f"""
SELECT plan_id, objtype, usecounts, size_in_bytes // 1024 AS size_kb, text AS short_text FROM ({PLANS}) WHERE cacheobjtype = 'Compiled Plan' AND objtype IN ('Adhoc', 'Prepared') AND usecounts = 1 ORDER BY size_in_bytes DESC, plan_id LIMIT 50""")
def _(t):
    return P.cache_top(plans(t), "single_use")


@query("k42_cache_most_used", f"""
SELECT plan_id, objtype, usecounts, size_in_bytes // 1024 AS size_kb, text AS short_text FROM ({PLANS}) WHERE cacheobjtype = 'Compiled Plan' ORDER BY usecounts DESC, plan_id LIMIT 25""")
def _(t):
    return P.cache_top(plans(t), "use", 25)


@query("k43_multi_plan", """
SELECT p_brand AS query_hash, CAST(count(DISTINCT p_type) AS BIGINT) AS distinct_plans, CAST(count(*) AS BIGINT) AS entries, CAST(sum(p_size) AS BIGINT) AS executions, min(left(p_name, 200)) AS sample_text FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1""")
def _(t):
    return P.multi_plan(t.part.select(F.col("p_brand").alias("query_hash"), F.col("p_type").alias("query_plan_hash"), F.col("p_size").alias("execution_count"), F.col("p_name").alias("text")))


@query("k44_recompiles", f"""
SELECT query_id, p_size AS recompilations, execution_count, total_worker_time // execution_count AS avg_worker_time, creation_time FROM ({STATS}) JOIN part ON p_partkey = query_id WHERE p_size > 1 ORDER BY p_size DESC, query_id LIMIT 25""")
def _(t):
    gen = t.part.select(F.col("p_partkey").alias("query_id"), F.col("p_size").alias("plan_generation_num"))
    return P.recompiles(statement_stats(t).join(gen, "query_id"))


@query("k44_forced_plans", """
SELECT l_partkey * 100000 + l_suppkey AS plan_id, l_partkey AS query_id, CAST(count(*) FILTER (l_tax > 0.04) AS BIGINT) AS force_failure_count, p_name AS query_sql_text, CAST(sum(l_linenumber) AS BIGINT) / 1000.0 AS avg_duration_ms
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_partkey, l_suppkey, p_name HAVING max(l_discount) > 0.09""")
def _(t):
    pl = (t.lineitem.groupBy((F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("plan_id"), F.col("l_partkey").alias("query_id"))
          .agg((F.max("l_discount") > 0.09).alias("is_forced_plan"), F.count_if(F.col("l_tax") > 0.04).alias("force_failure_count"), F.sum("l_linenumber").alias("avg_duration"),
               F.max("l_shipdate").alias("last_execution_time"), F.count(F.lit(1)).alias("count_executions")).withColumn("last_force_failure_reason", F.lit("NONE")))
    texts, queries = t.part.select(F.col("p_partkey").alias("query_text_id"), F.col("p_name").alias("query_sql_text")), t.part.select(F.col("p_partkey").alias("query_id"), F.col("p_partkey").alias("query_text_id"))
    return P.forced_plans(pl, queries, texts).select("plan_id", "query_id", "force_failure_count", "query_sql_text", "avg_duration_ms")


def store(t):
    """Parts as queries, part and supplier pairs as plans, lines as runs, orders as intervals."""
    texts = t.part.select(F.col("p_partkey").alias("query_text_id"), F.col("p_name").alias("query_sql_text"))
    queries = t.part.select(F.col("p_partkey").alias("query_id"), F.col("p_partkey").alias("query_text_id"), F.col("p_brand").alias("query_hash"))
    plan_id = (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("plan_id")
    pl = t.lineitem.select(plan_id, F.col("l_partkey").alias("query_id"), (F.col("l_suppkey") % 5).alias("query_plan_hash"), F.lit(1).alias("count_compiles")).distinct()
    kind = F.when(F.col("l_returnflag") == "A", "Aborted").when(F.col("l_returnflag") == "N", "Regular").otherwise("Exception")
    runs = t.lineitem.select(plan_id, F.col("l_orderkey").alias("interval_id"), F.col("l_quantity").cast("bigint").alias("count_executions"), cents("l_extendedprice").alias("avg_cpu_time"),
                             (cents("l_extendedprice") * 2).alias("max_cpu_time"), F.col("l_suppkey").alias("max_logical_io_reads"), F.col("l_suppkey").alias("avg_logical_io_reads"), F.col("l_linenumber").alias("avg_physical_io_reads"),
                             F.col("l_partkey").alias("avg_duration"), kind.alias("execution_type_desc"), F.col("l_shipdate").alias("last_execution_time"))
    return texts, queries, pl, runs


def intervals(t):
    return t.orders.select(F.col("o_orderkey").alias("interval_id"), F.col("o_orderdate").alias("start_time"))


RUNS = "lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey"
CPU = "CAST(l_quantity AS BIGINT) * CAST(l_extendedprice * 100 AS BIGINT)"


@query("k45_history_top_cpu", f"""
SELECT p_brand AS query_hash, CAST(sum({CPU}) AS BIGINT) / 1000.0 AS total_cpu_ms, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS executions, max(CAST(l_extendedprice * 100 AS BIGINT)) * 2 / 1000.0 AS max_cpu_ms, max(l_suppkey) AS max_logical_reads,
  CAST(count(DISTINCT l_partkey * 100000 + l_suppkey) AS BIGINT) AS plans, CAST(count(DISTINCT l_partkey) AS BIGINT) AS queries, CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS aborted,
  CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS regular, CAST(sum(CASE WHEN l_returnflag NOT IN ('A', 'N') THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS exceptions,
  min(p_name) AS sample_text, CAST(sum({CPU}) AS BIGINT) / 1000.0 / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS avg_cpu_ms, CAST(row_number() OVER (ORDER BY sum({CPU}) DESC, p_brand) AS INTEGER) AS place
FROM {RUNS} WHERE o_orderdate >= TIMESTAMP '2001-12-31' - INTERVAL 43800 HOUR GROUP BY p_brand ORDER BY total_cpu_ms DESC, query_hash LIMIT 15""")
def _(t):
    return P.query_history_top_cpu(*store(t), intervals(t), orders_as_of(), hours=43800)


@query("k46_history_top", f"""
SELECT l_partkey AS query_id, p_name AS query_sql_text, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS executions, CAST(sum({CPU}) AS BIGINT) / 1000.0 AS total_cpu_ms, avg(CAST(l_extendedprice * 100 AS BIGINT)) / 1000.0 AS avg_cpu_ms,
  avg(l_suppkey) AS avg_logical_reads, avg(l_linenumber) AS avg_physical_reads, avg(l_partkey) / 1000.0 AS avg_duration_ms, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS plan_count,
  CASE WHEN count(DISTINCT l_suppkey) > 1 THEN '* Multiple plans — possible parameter sniffing *' ELSE '' END AS plan_stability_note
FROM {RUNS} WHERE o_orderdate >= TIMESTAMP '2001-12-31' - INTERVAL 43800 HOUR GROUP BY 1, 2 ORDER BY total_cpu_ms DESC, query_id LIMIT 25""")
def _(t):
    return P.query_history_top(*store(t), intervals(t), orders_as_of(), hours=43800)


@query("k47_history_by_hash", """
WITH r AS (SELECT l_partkey AS query_id, p_brand AS query_hash, l_suppkey % 5 AS query_plan_hash, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS executions, avg(CAST(l_extendedprice * 100 AS BIGINT)) / 1000.0 AS avg_cpu_ms,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) * avg(CAST(l_extendedprice * 100 AS BIGINT)) / 1000.0 AS total_cpu_ms, avg(l_suppkey) / 1000.0 AS avg_logical_reads, avg(l_linenumber) / 1000.0 AS avg_physical_reads, any_value(p_name) AS query_sql_text
  FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand IN ('Brand#2', 'Brand#17') GROUP BY 1, 2, 3)
SELECT r.*, l_partkey * 100000 + l_suppkey AS plan_id, 1 AS count_compiles FROM r JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_partkey = query_id AND l_suppkey % 5 = query_plan_hash""")
def _(t):
    return P.query_history_by_hash(*store(t), ["Brand#2", "Brand#17"])


@query("k48_history_search", """
SELECT p_name AS query_sql_text, l_partkey * 100000 + l_suppkey AS plan_id, l_shipdate AS last_execution_time, CAST(l_quantity AS BIGINT) AS count_executions, CAST(l_extendedprice * 100 AS BIGINT) AS avg_cpu_time,
  l_suppkey AS avg_logical_io_reads, l_linenumber AS avg_physical_io_reads FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_name LIKE '%widget%'""")
def _(t):
    return P.query_history_search(*store(t), "%Widget%")


@query("k49_text_token", "SELECT doc_id, CASE WHEN contains(text, 'license') THEN 1 ELSE 0 END AS found FROM documents")
def _(t):
    return t.documents.select("doc_id", P.has_token("text", "license").alias("found"))
