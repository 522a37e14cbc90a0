"""Counters, shares and deltas: waits, CPU, IO, resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.scalars import (boundaries, decode, fixed, int_avg, int_div, like, pct, rules, safe_div,
                                 slice_statement, ticks_to_time)
from ..functions.xml import RECORD_SCHEMA, entry, parse_events, parse_xml
from ..operators.aggregates import share_of_total
from ..operators.windows import BLOCK, as_list, grand_total, range_blocks, running
from ..session import materialise


def without(df: DataFrame, key: str, ignore) -> DataFrame:
    """Drop listed keys; ``ignore`` is a list or a one-column DataFrame."""
    if ignore is None:
        return df
    if isinstance(ignore, DataFrame):
        return df.join(ignore.select(F.col(ignore.columns[0]).alias(key)), key, "left_anti")
    return df.where(~F.col(key).isin(*ignore)) if ignore else df


def per_type(waits: DataFrame, key: str = "wait_type") -> DataFrame:
    return waits.groupBy(key).agg(F.sum("waiting_tasks_count").alias("wait_count"),
                                  F.sum("wait_time_ms").alias("wait_ms"),
                                  F.sum("signal_wait_time_ms").alias("signal_ms"))


def seconds(ms) -> Column:
    return fixed(F.col(ms) / 1000.0 if isinstance(ms, str) else ms / 1000.0, 2)


# --- waits -----------------------------------------------------------------

def top_waits(waits: DataFrame, ignore=V.BENIGN_WAITS, cutoff: float = 95) -> DataFrame:
    """Largest waits until ``cutoff`` percent is covered; the row that crosses it is kept."""
    totals = without(waits.where("waiting_tasks_count > 0"), "wait_type", ignore)
    order = [F.desc("wait_ms"), F.asc("wait_type")]
    rows = range_blocks(per_type(totals), *order)
    ran = running(rows, [], order, BLOCK, {"ran_ms": "wait_ms"})
    total = grand_total(rows, F.sum("wait_ms"))
    before = 100.0 * (F.col("ran_ms") - F.col("wait_ms")).cast("double") / total
    return ran.where(before < cutoff).select(
        "wait_type", pct("wait_ms", total, 2).alias("wait_pct"), pct("ran_ms", total, 2).alias("running_pct"),
        seconds("wait_ms").alias("total_wait_sec"),
        seconds(F.col("wait_ms") - F.col("signal_ms")).alias("resource_wait_sec"),
        seconds("signal_ms").alias("signal_wait_sec"), "wait_count",
        int_div("wait_ms", "wait_count").alias("avg_wait_ms"),
        decode("wait_type", V.WAIT_GUIDANCE, "").alias("recommendation"))


def signal_ratio(waits: DataFrame, ignore=None) -> DataFrame:
    """Share of signal time in all wait time, with an assessment."""
    sums = without(waits, "wait_type", ignore).agg(F.sum("wait_time_ms").alias("w"),
                                                   F.sum("signal_wait_time_ms").alias("s"))
    signal = pct("s", "w")
    verdict = rules([(signal > cut, text) for cut, text in V.SIGNAL_BANDS], V.SIGNAL_OK)
    return sums.select(fixed(signal, 2).alias("signal_wait_pct"),
                       pct(F.col("w") - F.col("s"), "w", 2).alias("resource_wait_pct"),
                       verdict.alias("assessment"))


def wait_totals(waits: DataFrame, ignore=V.IGNORABLE_WAITS, n: int = 25) -> DataFrame:
    totals = materialise(per_type(without(waits, "wait_type", ignore)))
    total = grand_total(totals, F.sum("wait_ms"))
    return (totals.orderBy(F.desc("wait_ms"), "wait_type").limit(n)
            .select("wait_type", F.col("wait_ms").alias("sum_wait_time_ms"),
                    pct("wait_ms", total, 1).alias("pct_wait_time"),
                    F.col("wait_count").alias("sum_waiting_tasks"),
                    fixed(safe_div("wait_ms", "wait_count", 0), 1).alias("avg_wait_time_ms")))


def counter_delta(first: DataFrame, last: DataFrame, keys, measures: list[str], mode: str = "raw",
                  new_keys: bool = True) -> DataFrame:
    """``last - first`` per key; a key the first sample lacks starts at 0.

    A counter that was reset gives a negative delta: kept (``raw``), set to 0 (``floor``),
    or its row removed (``drop``, judged on the first measure, which must have grown).
    """
    keys = as_list(keys)
    base = first.select(*keys, *[F.col(m).alias(f"_b_{m}") for m in measures])
    both = last.join(base, keys, "left" if new_keys else "inner")
    delta = {m: F.col(m) - F.coalesce(f"_b_{m}", F.lit(0)) for m in measures}
    if mode == "drop":
        both = both.where(delta[measures[0]] > 0)
    elif mode == "floor":
        delta = {m: F.greatest(d, F.lit(0)) for m, d in delta.items()}
    elif mode != "raw":
        raise ValueError(f"unknown mode {mode}")
    return both.withColumns(delta).drop(*[f"_b_{m}" for m in measures])


def wait_delta(first: DataFrame, last: DataFrame, n: int = 20) -> DataFrame:
    """Waits between two samples, growing ones only."""
    d = counter_delta(first, last, "wait_type", ["wait_time_ms", "waiting_tasks_count", "signal_wait_time_ms"], "drop")
    return (d.orderBy(F.desc("wait_time_ms"), "wait_type").limit(n)
            .select("wait_type", F.col("waiting_tasks_count").alias("wait_count"),
                    seconds("wait_time_ms").alias("wait_time_sec"),
                    seconds(F.col("wait_time_ms") - F.col("signal_wait_time_ms")).alias("resource_wait_sec"),
                    seconds("signal_wait_time_ms").alias("signal_wait_sec"),
                    fixed(safe_div("wait_time_ms", "waiting_tasks_count", 0), 2).alias("avg_wait_ms")))


def latest_wait_delta(samples: DataFrame, batch: str = "batch_id", time: str = "sample_time") -> DataFrame:
    """Delta of the latest batch against the one numbered just before it."""
    newest = samples.agg(F.max(batch)).scalar()
    pair = samples.where(F.col(batch) >= newest - 1)
    part = lambda cond, c: F.max(F.when(cond, F.col(c)))
    is_new = F.col(batch) == newest
    sums = lambda cond, c: F.sum(F.when(cond, F.col(c)))
    d = pair.groupBy("wait_type").agg(
        part(is_new, time).alias("t2"), part(~is_new, time).alias("t1"),
        (sums(is_new, "wait_time_ms") - sums(~is_new, "wait_time_ms")).alias("ms"),
        (sums(is_new, "waiting_tasks_count") - sums(~is_new, "waiting_tasks_count")).alias("n"))
    return d.where("n > 0").select(
        F.col("t2").alias("second_sample_time"), boundaries("second", "t1", "t2").alias("sample_seconds"),
        "wait_type", fixed(F.col("ms") / 1000.0, 1).alias("wait_time_sec"), F.col("n").alias("number_of_waits"),
        fixed(safe_div("ms", "n", 0), 1).alias("avg_ms_per_wait"))


def wait_category(wait_type="wait_type") -> Column:
    """Ordered patterns, then the ignorable names, else the wait type itself."""
    c = F.col(wait_type) if isinstance(wait_type, str) else wait_type
    steps = [(like(c, p), label) for p, label in V.CATEGORY_PATTERNS]
    return rules(steps + [(c.isin(*V.CATEGORY_IGNORABLE), "IGNORABLE")], c)


def wait_category_stats(waits: DataFrame, batch: str = "runtime") -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (waits.where("wait_category <> 'IGNORABLE'").groupBy(batch, "wait_category")
            .agg(F.sum(zero("waiting_tasks_count")).alias("waiting_tasks_count"),
                 F.sum(zero("wait_time_ms")).alias("wait_time_ms"),
                 F.sum(zero("signal_wait_time_ms")).alias("signal_wait_time_ms"),
                 F.max(zero("max_wait_time_ms")).alias("max_wait_time_ms")))


def snap_window(df: DataFrame, ts: str, start=None, end=None) -> DataFrame:
    """Requested window moved to real samples, as one row: start_time, end_time.

    The last sample at or before the start, the first at or after the end; where that
    or the request is missing, the first and last sample.
    """
    c = F.col(ts)
    lit = lambda v: F.lit(v).cast("timestamp_ntz") if not isinstance(v, Column) else v
    begin = F.min(c) if start is None else F.coalesce(F.max(F.when(c <= lit(start), c)), F.min(c))
    stop = F.max(c) if end is None else F.coalesce(F.min(F.when(c >= lit(end), c)), F.max(c))
    return df.agg(begin.alias("start_time"), stop.alias("end_time"))


def snapped(df: DataFrame, ts: str, start, end) -> tuple[Column, Column]:
    """The snapped window as two scalars that share one pass."""
    window = snap_window(df, ts, start, end)
    both = window.select(F.struct("start_time", "end_time").alias("w")).scalar()
    return both["start_time"], both["end_time"]


def category_window(waits: DataFrame, cpu: DataFrame, start, end, cpu_count: int) -> DataFrame:
    """Per category over a snapped window: raw delta, ms per second, interval, and the CPU total.

    Few rows that the reports read several times, so they are written once.
    """
    t1, t2 = snapped(waits, "runtime", start, end)
    stats = wait_category_stats(waits)
    ms = lambda t: F.sum(F.when(F.col("runtime") == t, F.col("wait_time_ms")))
    both = (stats.where((F.col("runtime") == t1) | (F.col("runtime") == t2)).groupBy("wait_category")
            .agg(ms(t2).alias("end_ms"), ms(t1).alias("start_ms")).where("end_ms is not null"))
    used = (cpu.where(F.col("event_time").between(t1, t2))
            .dropDuplicates(["record_id", "system_idle_cpu", "sql_cpu_utilization"])
            .agg(int_avg("sql_cpu_utilization")).scalar())
    secs = boundaries("second", t1, t2)
    cats = (both.withColumn("raw_ms", F.col("end_ms") - F.coalesce("start_ms", F.lit(0)))
            .withColumn("time_interval_sec", secs)
            .withColumn("ms_per_sec", int_div("raw_ms", F.col("time_interval_sec") + 1))
            .withColumn("cpu_used_ms", F.coalesce(
                F.floor(0.01 * used * (cpu_count * F.col("time_interval_sec")) * 1000), F.lit(0))))
    return materialise(cats)


def largest(cats: DataFrame, n: int) -> DataFrame:
    return cats.orderBy(F.desc("ms_per_sec"), "wait_category").limit(n)


def top5_categories(waits: DataFrame, cpu: DataFrame, start=None, end=None, cpu_count: int = 1) -> DataFrame:
    """Five largest categories, a CPU row and the rest.

    The rest is measured against the five largest of all categories, ignored ones included,
    so it can differ from "all but the rows above".
    """
    cats = (category_window(waits, cpu, start, end, cpu_count)
            .withColumn("total_wait_time_ms", F.greatest("raw_ms", F.lit(0))))
    total = grand_total(cats, F.sum("total_wait_time_ms") + F.max("cpu_used_ms"))
    cats = cats.withColumn("_all", total).where("_all <> 0")
    live = cats.where("ms_per_sec > 0 or total_wait_time_ms > 0")
    cols = ["wait_category", "time_interval_sec", "total_wait_time_ms", "percent_of_total", "ms_per_sec"]
    share = lambda c: pct(c, "_all")
    top = (largest(live.where(~F.col("wait_category").isin(*V.TOP_CATEGORY_IGNORE)), 5)
           .withColumn("percent_of_total", fixed(share("total_wait_time_ms"), 2)).where("percent_of_total > 0"))
    with_cpu = F.col("total_wait_time_ms") + F.col("cpu_used_ms")
    cpu_row = cats.where(F.col("wait_category") == V.CPU_WAIT).select(
        F.lit("CPU").alias("wait_category"), "time_interval_sec", with_cpu.alias("total_wait_time_ms"),
        share(with_cpu).alias("percent_of_total"),
        (F.col("ms_per_sec") + int_div("cpu_used_ms", F.col("time_interval_sec") + 1)).alias("ms_per_sec"))
    rest = (live.join(largest(cats, 5).select("wait_category"), "wait_category", "left_anti")
            .groupBy("time_interval_sec", "_all")
            .agg(F.sum("total_wait_time_ms").alias("total_wait_time_ms"), F.sum("ms_per_sec").alias("ms_per_sec"))
            .withColumn("wait_category", F.lit("Other"))
            .withColumn("percent_of_total", fixed(share("total_wait_time_ms"), 2)).where("percent_of_total > 0"))
    return top.select(*cols).unionByName(cpu_row.select(*cols)).unionByName(rest.select(*cols))


def other_categories(waits: DataFrame, cpu: DataFrame, start=None, end=None, cpu_count: int = 1,
                     n: int = 10) -> DataFrame:
    """The ``n`` categories after the five largest; negative deltas stay."""
    cats = category_window(waits, cpu, start, end, cpu_count).withColumn("total_wait_time_ms", F.col("raw_ms"))
    total = grand_total(cats, F.sum("total_wait_time_ms") + F.max("cpu_used_ms"))
    rest = (cats.where("ms_per_sec > 0 or total_wait_time_ms > 0")
            .join(largest(cats, 5).select("wait_category"), "wait_category", "left_anti")
            .where(F.col("wait_category") != V.CPU_WAIT).withColumn("_all", total).where("_all <> 0"))
    return largest(rest, n).select("wait_category", "time_interval_sec", "total_wait_time_ms",
                                   pct("total_wait_time_ms", "_all", 2).alias("percent_of_total"), "ms_per_sec")


def latch_stats(df: DataFrame, skip: tuple = ("BUFFER",)) -> DataFrame:
    return (df.where("waiting_requests_count > 0").where(~F.col("latch_class").isin(*skip))
            .select("latch_class", F.col("waiting_requests_count").alias("wait_count"), "wait_time_ms",
                    seconds("wait_time_ms").alias("wait_time_sec"), "max_wait_time_ms",
                    decode("latch_class", V.LATCH_NOTES, "").alias("notes")))


def spin_stats(df: DataFrame) -> DataFrame:
    return df.where("collisions > 0").select("name", "collisions", "spins", "spins_per_collision", "sleep_time", "backoffs")


def waiting_tasks(tasks: DataFrame, sessions: DataFrame, requests: DataFrame, texts: DataFrame,
                  first_user_session: int = 50) -> DataFrame:
    """Waiting tasks with their session, request and current statement, where known."""
    r = requests.select("session_id", "command", F.col("status").alias("request_status"), "database_name",
                        "sql_handle", "statement_start_offset", "statement_end_offset")
    return (tasks.where(F.col("session_id") > first_user_session)
            .join(sessions.select("session_id", "login_name", "host_name", "program_name"), "session_id", "left")
            .join(r, "session_id", "left").join(texts.select("sql_handle", "text"), "sql_handle", "left")
            .withColumn("current_statement", slice_statement("text", "statement_start_offset", "statement_end_offset"))
            .drop("sql_handle", "text", "statement_start_offset", "statement_end_offset"))


def event_wait_totals(events: DataFrame, xml: str = "event_data") -> DataFrame:
    """Wait time per session and type, from wait event documents."""
    e = parse_events(events, xml)
    return (e.select(entry("actions", "session_id", "int").alias("session_id"),
                     F.col("labels")["wait_type"].alias("wait_type"),
                     entry("data", "duration", "bigint").alias("duration"),
                     entry("data", "signal_duration", "bigint").alias("signal_duration"),
                     entry("data", "completed_count", "bigint").alias("completed_count"))
            .groupBy("session_id", "wait_type")
            .agg(F.sum("duration").alias("total_duration_ms"),
                 F.sum("signal_duration").alias("total_signal_duration_ms"),
                 F.sum("completed_count").alias("total_wait_count")))


# --- CPU, IO and resources -------------------------------------------------

def cpu_history(records: DataFrame, now_ticks, now, n: int = 256) -> DataFrame:
    """Newest ``n`` health records: process, idle and other CPU percent, with wall clock times."""
    health = "SchedulerMonitorEvent.SystemHealth"
    parsed = (records.where(F.contains(F.col("record"), F.lit("<SystemHealth>")))
              .withColumn("_r", parse_xml("record", RECORD_SCHEMA)))
    return (parsed.select(F.col("_r._id").alias("record_id"), "timestamp",
                          F.col(f"_r.{health}.SystemIdle").alias("system_idle"),
                          F.col(f"_r.{health}.ProcessUtilization").alias("process_cpu"))
            .orderBy(F.desc("record_id")).limit(n)
            .select("record_id", "process_cpu", "system_idle",
                    (100 - F.col("system_idle") - F.col("process_cpu")).alias("other_cpu"),
                    ticks_to_time("timestamp", now_ticks, now).alias("event_time")))


def ranked_share(totals: DataFrame, key: str, measures: list[str], name: str) -> DataFrame:
    """Rank by the first measure and each measure's share of its column, two decimals."""
    order = [F.desc(measures[0]), F.asc(key)]
    rows = range_blocks(totals, *order)
    placed = running(rows.withColumn("_one", F.lit(1)), [], order, BLOCK, {name: "_one"})
    whole = {m: grand_total(rows, F.sum(m)) for m in measures}
    return placed.select(F.col(name).cast("bigint").alias(name), key, *measures,
                         *[pct(m, whole[m], 2).alias(f"{m}_pct") for m in measures])


def cpu_by_db(stats: DataFrame, skip: tuple = ()) -> DataFrame:
    totals = stats.groupBy("database_name").agg(F.sum(int_div("total_worker_time", 1000)).alias("cpu_ms"))
    return ranked_share(without(totals, "database_name", list(skip)), "database_name", ["cpu_ms"], "cpu_rank")


def cpu_by_db_delta(first: DataFrame, last: DataFrame) -> DataFrame:
    """Share of the CPU used between two samples, keys of both samples only."""
    total = lambda df: df.groupBy("database_name").agg(F.sum("total_worker_time").alias("cpu"))
    d = counter_delta(total(first), total(last), "database_name", ["cpu"], new_keys=False)
    return share_of_total(d, "cpu", "cpu_pct").withColumn("cpu_pct", fixed("cpu_pct", 2))


def io_by_db(io: DataFrame) -> DataFrame:
    read, written = F.sum("num_of_bytes_read"), F.sum("num_of_bytes_written")
    mb = lambda c: int_div(c, 1048576)
    totals = io.groupBy("database_name").agg(mb(read + written).alias("total_mb"), mb(read).alias("read_mb"),
                                             mb(written).alias("write_mb"))
    return ranked_share(totals, "database_name", ["total_mb", "read_mb", "write_mb"], "io_rank")


RESOURCES = ["avg_cpu_percent", "avg_data_io_percent", "avg_log_write_percent", "avg_memory_usage_percent"]


def in_window(df: DataFrame, ts: str, start, end) -> DataFrame:
    return df.where(F.col(ts).between(*snapped(df, ts, start, end)))


def resource_summary(df: DataFrame, start=None, end=None) -> DataFrame:
    aggs = [f(c).cast("double").alias(f"{n}_{c[4:]}") for c in RESOURCES for f, n in ((F.avg, "avg"), (F.max, "max"))]
    return in_window(df, "end_time", start, end).agg(*aggs)


def resource_utilisation(df: DataFrame, start=None, end=None) -> DataFrame:
    """Highest of CPU, data IO and log write percent per row, also as units of the limit."""
    top = F.greatest(*RESOURCES[:3])
    return in_window(df, "end_time", start, end).select(
        "end_time", top.alias("avg_percent"), (F.col("dtu_limit") * (top / 100.0)).alias("used"), "dtu_limit")


def resource_history(df: DataFrame, n: int = 250) -> DataFrame:
    read, written = F.col("io_bytes_read"), F.col("io_bytes_written")
    mb = lambda c: fixed(c / 1048576.0, 2)
    return (df.where((read > 0) & (written > 0)).orderBy(F.desc("end_time"), "resource_name").limit(n)
            .select("resource_name", "end_time", mb(read).alias("mb_read"), pct(read, read + written, 2).alias("read_pct"),
                    mb(written).alias("mb_written"), pct(written, read + written, 2).alias("write_pct"),
                    mb(read + written).alias("mb_total")))


def key_counters(df: DataFrame, names=V.KEY_COUNTERS, descriptions: dict | None = None) -> DataFrame:
    """Listed counters of plain objects, or the lock-wait total of any object.

    AND binds before OR: the lock-wait rows skip the object tests.
    """
    listed = F.lower("counter_name").isin(*[n.lower() for n in names])
    plain = ~like("object_name", "%Partition%", ignore_case=True) & ~like("object_name", "%Node%", ignore_case=True)
    locks = (F.lower("counter_name") == "lock waits/sec") & (F.lower("instance_name") == "_total")
    return df.where((listed & plain) | locks).select(
        F.rtrim("counter_name").alias("counter_name"), "cntr_value", "instance_name",
        decode("counter_name", descriptions or {}, "").alias("description"))


def avg_tasks(schedulers: DataFrame, hidden_from: int = 255) -> DataFrame:
    """Whole-number averages over the visible schedulers."""
    counts = ["current_tasks_count", "work_queue_count", "runnable_tasks_count", "pending_disk_io_count"]
    return schedulers.where(F.col("scheduler_id") < hidden_from).agg(*[int_avg(c).alias(f"avg_{c}") for c in counts])


def file_count_check(files: DataFrame, schedulers: DataFrame, key: str, most: int = 8) -> DataFrame:
    """Files per key against the smaller of the online schedulers and ``most``."""
    have = files.groupBy(key).agg(F.count(F.lit(1)).alias("data_files"))
    need = schedulers.groupBy(key).agg(F.count(F.lit(1)).alias("online_cpus"))
    low = F.col("data_files") < F.least("online_cpus", F.lit(most))
    return have.join(need, key).withColumn("recommendation", rules([(low, "*** ADD MORE TEMPDB DATA FILES ***")], "OK"))


def memory_left_check(memory: DataFrame) -> DataFrame:
    """Memory left for the host under the configured maximum."""
    left = F.col("total_physical_memory_kb") / 1024.0 - F.col("max_server_memory_mb")
    status = rules([(F.col("max_server_memory_mb") == V.UNLIMITED_MEMORY_MB, "*** UNLIMITED — CONFIGURE NOW ***"),
                    (left < 2048, "*** LESS THAN 2 GB LEFT FOR OS ***"),
                    (left < 4096, "* Less than 4 GB left for OS *")], "OK")
    return memory.withColumn("left_for_os_mb", fixed(left, 0)).withColumn("status", status)


def pair_passes(df: DataFrame, keys, pass_col: str, measures: list[str]) -> DataFrame:
    """Second pass (+1) minus first pass (-1) per key; keys seen in one pass only are left out."""
    aggs = [F.sum(F.col(m) * F.col(pass_col)).alias(f"{m}_delta") for m in measures]
    return (df.groupBy(*as_list(keys)).agg(*aggs, F.countDistinct(pass_col).alias("_passes"))
            .where("_passes = 2").drop("_passes"))
