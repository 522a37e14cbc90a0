"""Statements, procedures, plan cache and query history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.scalars import bytes_to, boundaries, fixed, int_avg, int_div, like, pct, rules, safe_div, shift, short_text
from ..operators.ranking import rank_band
from ..operators.windows import as_list

METRICS = ["worker_time", "elapsed_time", "logical_reads", "logical_writes", "physical_reads"]


def has_token(column, token: str = V.MISSING_INDEX_TOKEN) -> Column:
    """1 when the text holds the token, exact case."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.contains(c, F.lit(token)), 1).otherwise(0)


def per_call(metric: str) -> Column:
    """Average per execution, as a whole number."""
    return int_div(f"total_{metric}", "execution_count")


def calls_per(unit: str, as_of, since: str) -> Column:
    return F.coalesce(int_div("execution_count", boundaries(unit, since, as_of)), F.lit(0))


def ranking_column(metric: str, how: str) -> Column:
    if metric == "executions":
        return F.col("execution_count")
    if metric == "io":
        return int_div(F.col("total_logical_reads") + F.col("total_logical_writes"), "execution_count")
    return per_call(metric) if how == "avg" else F.col(f"total_{metric}")


def top_statements(stats: DataFrame, metric: str = "worker_time", n: int = 50, as_of=None, how: str = "total",
                   id_col: str = "query_id", cut: int = 255) -> DataFrame:
    """Largest statements by a total or average. Texts, if present, are cut to one short line.

    With ``as_of``, statements cached for less than a minute are left out and calls per minute shown.
    """
    rows = stats
    if as_of is not None:
        rows = rows.where(boundaries("minute", "creation_time", as_of) > 0)
    top = rows.withColumn("_rank", ranking_column(metric, how)).orderBy(F.desc("_rank"), id_col).limit(n)
    avgs = {f"avg_{m}": per_call(m) for m in METRICS if f"total_{m}" in stats.columns}
    top = top.withColumns({"ranked_by": F.col("_rank"), **avgs})
    if as_of is not None:
        top = top.withColumn("calls_per_minute", calls_per("minute", as_of, "creation_time"))
    if "query_plan" in stats.columns:
        top = top.withColumn("has_missing_index", has_token("query_plan")).drop("query_plan")
    if "text" in stats.columns:
        top = top.withColumn("short_text", short_text("text", cut)).drop("text")
    return top.drop("_rank")


def top_procedures(stats: DataFrame, metric: str = "logical_writes", n: int = 25, as_of=None, how: str = "total") -> DataFrame:
    """Procedures of the plan cache; ones that never used the metric are left out."""
    used = stats if metric in ("executions", "io") else stats.where(F.col(f"total_{metric}") > 0)
    rows = used.withColumnRenamed("cached_time", "creation_time")
    return top_statements(rows, metric, n, as_of, how, id_col="name").withColumnRenamed("creation_time", "cached_time")


def procedure_delta(first: DataFrame, last: DataFrame, n: int = 100) -> DataFrame:
    """Differences between two samples of the procedures in both, for the ``n`` with most worker time in the later one.

    ``calls_per_second`` is the later sample's, since the plan was cached; 0 within the first second.
    """
    def sample(df):
        return df.select("name", "sample_time", "execution_count", "total_worker_time", "total_elapsed_time",
                         calls_per("second", "sample_time", "cached_time").alias("calls_per_second"), per_call("worker_time").alias("avg_worker_time"), per_call("elapsed_time").alias("avg_elapsed_time"))

    a, b = sample(first).alias("a"), sample(last).alias("b")
    diff = lambda c: (F.col(f"b.{c}") - F.col(f"a.{c}")).alias(f"delta_{c}")
    return a.join(b, F.col("a.name") == F.col("b.name")).orderBy(F.desc("b.total_worker_time"), "b.name").limit(n).select(
        F.col("a.name").alias("name"), boundaries("second", "a.sample_time", "b.sample_time").alias("seconds_between"),
        *[diff(c) for c in ("execution_count", "total_worker_time", "total_elapsed_time", "avg_worker_time", "avg_elapsed_time")],
        "b.calls_per_second")


def top_functions(stats: DataFrame, n: int = 25) -> DataFrame:
    return top_statements(stats, "worker_time", n, id_col="name")


# --- plan cache ------------------------------------------------------------

def _single(value=1) -> Column:
    return F.sum(F.when(F.col("usecounts") == 1, F.col(value) if isinstance(value, str) else F.lit(value)).otherwise(0))


def cache_composition(plans: DataFrame) -> DataFrame:
    g = plans.groupBy("objtype", "cacheobjtype").agg(
        F.count(F.lit(1)).alias("plans"), F.sum("size_in_bytes").alias("_size"), F.sum("usecounts").alias("uses"),
        int_avg("usecounts").alias("avg_uses"), _single().alias("single_use_plans"), int_avg("size_in_bytes").alias("_avg_size"))
    return g.select("objtype", "cacheobjtype", "plans", bytes_to("_size").alias("size_mb"), "uses", "avg_uses",
                    safe_div("uses", "plans").alias("avg_used"), "single_use_plans", pct("single_use_plans", "plans", 2).alias("single_use_pct"),
                    bytes_to("_avg_size", "kb").alias("avg_size_kb"))


def cache_bloat(plans: DataFrame) -> DataFrame:
    """Single-use plans of the whole cache, with advice above half."""
    g = plans.agg(F.count(F.lit(1)).alias("plans"), _single().alias("single_use_plans"), _single("size_in_bytes").alias("_one"),
                  F.sum("size_in_bytes").alias("_all"))
    share = pct("single_use_plans", "plans")
    return g.select("single_use_plans", "plans", fixed(share, 2).alias("single_use_pct"), bytes_to("_one").alias("single_use_mb"),
                    bytes_to("_all").alias("cache_mb"), rules([(share > 50, "*** ENABLE optimize for ad hoc workloads ***")], "OK").alias("recommendation"))


def cache_pollution(plans: DataFrame) -> DataFrame:
    g = plans.groupBy("objtype").agg(F.count(F.lit(1)).alias("plans"), F.sum("size_in_bytes").alias("_all"), int_avg("usecounts").alias("avg_uses"),
                                     _single("size_in_bytes").alias("_one"), _single().alias("single_use_plans"))
    return g.select("objtype", "plans", (F.col("_all") / 1048576.0).alias("total_mb"), "avg_uses", (F.col("_one") / 1048576.0).alias("single_use_mb"),
                    "single_use_plans", (safe_div("_one", "_all") * 100).alias("wasted_pct"))


def cache_top(plans: DataFrame, by: str = "size", n: int = 50) -> DataFrame:
    """``single_use``: ad hoc and prepared plans used once, largest first. ``size``: largest. ``use``: most used."""
    compiled = F.col("cacheobjtype") == "Compiled Plan"
    if by == "single_use":
        plans = plans.where(compiled & F.col("objtype").isin("Adhoc", "Prepared") & (F.col("usecounts") == 1))
    elif by == "use":
        plans = plans.where(compiled)
    order = "usecounts" if by == "use" else "size_in_bytes"
    return (plans.orderBy(F.desc(order), "plan_id").limit(n)
            .select("plan_id", "objtype", "usecounts", int_div("size_in_bytes", 1024).alias("size_kb"),
                    *([short_text("text", 255).alias("short_text")] if "text" in plans.columns else [])))


def multi_plan(stats: DataFrame) -> DataFrame:
    """Queries with more than one plan."""
    return (stats.groupBy("query_hash").agg(F.countDistinct("query_plan_hash").alias("distinct_plans"), F.count(F.lit(1)).alias("entries"),
                                            F.sum("execution_count").alias("executions"), F.min(F.left("text", F.lit(200))).alias("sample_text"))
            .where("distinct_plans > 1"))


def recompiles(stats: DataFrame, n: int = 25) -> DataFrame:
    return (stats.where("plan_generation_num > 1").orderBy(F.desc("plan_generation_num"), "query_id").limit(n)
            .select("query_id", F.col("plan_generation_num").alias("recompilations"), "execution_count", per_call("worker_time").alias("avg_worker_time"), "creation_time"))


def forced_plans(plans: DataFrame, queries: DataFrame, texts: DataFrame) -> DataFrame:
    return (plans.where("is_forced_plan").join(queries, "query_id").join(texts, "query_text_id")
            .select("plan_id", "query_id", "force_failure_count", "last_force_failure_reason", "query_sql_text", "last_execution_time",
                    (F.col("avg_duration") / 1000.0).alias("avg_duration_ms"), "count_executions"))


# --- query history ---------------------------------------------------------

def history(texts: DataFrame, queries: DataFrame, plans: DataFrame, runs: DataFrame) -> DataFrame:
    return runs.join(plans, "plan_id").join(queries, "query_id").join(texts, "query_text_id")


def recent(runs: DataFrame, intervals: DataFrame, hours: int, as_of) -> DataFrame:
    """Runs of intervals that started in the last ``hours``; the intervals are filtered first."""
    kept = intervals.where(F.col("start_time") >= shift(as_of, "hour", -hours))
    return runs.join(kept.select("interval_id"), "interval_id")


def per_plan(runs: DataFrame) -> DataFrame:
    """Runs summed per plan, so that the joins to plans, queries and texts see one row per plan."""
    outcome = lambda kind: F.sum(F.when(F.col("execution_type_desc") == kind, F.col("count_executions")).otherwise(0))
    total = lambda c: F.sum(c).alias(f"sum_{c}")
    return runs.groupBy("plan_id").agg(
        F.sum(F.col("count_executions") * F.col("avg_cpu_time")).alias("cpu"), F.sum("count_executions").alias("n"), F.count(F.lit(1)).alias("rows"),
        F.max("max_cpu_time").alias("max_cpu"), F.max("max_logical_io_reads").alias("max_reads"),
        outcome("Aborted").alias("aborted"), outcome("Regular").alias("regular"), outcome("Exception").alias("exceptions"),
        total("avg_cpu_time"), total("avg_logical_io_reads"), total("avg_physical_io_reads"), total("avg_duration"))


def mean(column: str) -> Column:
    """Average over runs, from sums per plan."""
    return safe_div(F.sum(f"sum_{column}"), F.sum("rows"))


def query_history_top_cpu(texts, queries, plans, runs, intervals, as_of, hours: int = 2, n: int = 15) -> DataFrame:
    """Most CPU per query hash: averages weighted by executions, outcomes counted apart."""
    used = recent(runs.where(F.col("execution_type_desc").isin("Regular", "Aborted", "Exception")), intervals, hours, as_of)
    g = (per_plan(used).join(plans.select("plan_id", "query_id"), "plan_id").join(queries, "query_id").join(texts, "query_text_id").groupBy("query_hash")
         .agg((F.sum("cpu") / 1000.0).alias("total_cpu_ms"), F.sum("n").alias("executions"), (F.max("max_cpu") / 1000.0).alias("max_cpu_ms"),
              F.max("max_reads").alias("max_logical_reads"), F.count(F.lit(1)).alias("plans"), F.countDistinct("query_id").alias("queries"),
              F.sum("aborted").alias("aborted"), F.sum("regular").alias("regular"), F.sum("exceptions").alias("exceptions"),
              F.min("query_sql_text").alias("sample_text"))
         .withColumn("avg_cpu_ms", safe_div("total_cpu_ms", "executions")))
    return rank_band(g, 1, n, [F.desc("total_cpu_ms"), F.asc("query_hash")], "place")


def query_history_top(texts, queries, plans, runs, intervals, as_of, hours: int = 24, n: int = 25) -> DataFrame:
    """Most CPU per query; averages here are averages of interval averages."""
    g = (per_plan(recent(runs, intervals, hours, as_of)).join(plans.select("plan_id", "query_id"), "plan_id").groupBy("query_id")
         .agg(F.sum("n").alias("executions"), (F.sum("cpu") / 1000.0).alias("total_cpu_ms"), (mean("avg_cpu_time") / 1000.0).alias("avg_cpu_ms"),
              mean("avg_logical_io_reads").alias("avg_logical_reads"), mean("avg_physical_io_reads").alias("avg_physical_reads"),
              (mean("avg_duration") / 1000.0).alias("avg_duration_ms"), F.count(F.lit(1)).alias("plan_count")))
    note = rules([(F.col("plan_count") > 1, "* Multiple plans — possible parameter sniffing *")], "")
    top = g.withColumn("plan_stability_note", note).orderBy(F.desc("total_cpu_ms"), "query_id").limit(n)
    return top.join(queries.select("query_id", "query_text_id"), "query_id").join(texts, "query_text_id").drop("query_text_id")


def query_history_by_hash(texts, queries, plans, runs, hashes: list) -> DataFrame:
    """All plans of the given query hashes."""
    wanted = queries.where(F.col("query_hash").isin(*hashes))
    known = plans.join(wanted.select("query_id", "query_hash"), "query_id")
    g = (per_plan(runs.join(known.select("plan_id"), "plan_id", "left_semi")).join(known, "plan_id").groupBy("query_id", "query_hash", "query_plan_hash")
         .agg(F.sum("n").alias("executions"), (mean("avg_cpu_time") / 1000.0).alias("avg_cpu_ms"), (F.sum("n") * mean("avg_cpu_time") / 1000.0).alias("total_cpu_ms"),
              (mean("avg_logical_io_reads") / 1000.0).alias("avg_logical_reads"), (mean("avg_physical_io_reads") / 1000.0).alias("avg_physical_reads")))
    texted = wanted.select("query_id", "query_text_id").join(texts, "query_text_id").drop("query_text_id")
    return g.join(texted, "query_id").join(known.select("query_id", "query_plan_hash", "plan_id", "count_compiles"), ["query_id", "query_plan_hash"])


def query_history_search(texts, queries, plans, runs, pattern: str) -> DataFrame:
    """Runs of queries whose text matches; the texts are filtered first."""
    found = texts.where(like("query_sql_text", pattern, ignore_case=True))
    return (history(found, queries, plans, runs)
            .select("query_sql_text", "plan_id", "last_execution_time", "count_executions", "avg_cpu_time", "avg_logical_io_reads", "avg_physical_io_reads"))
