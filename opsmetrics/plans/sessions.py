"""Sessions, requests, transactions, memory grants and their details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.scalars import (decode, fixed, format_duration, instant_micros, int_avg, int_div, like, short_text,
                                 slice_statement)
from ..operators.filters import filter_sessions
from ..operators.ranking import top_k_per_group
from ..operators.windows import as_list


def elapsed_ms(start, as_of) -> Column:
    return int_div(instant_micros(as_of) - instant_micros(start), 1000)


def long_running(processes: DataFrame, as_of, first_user_session: int = 50) -> DataFrame:
    """Working sessions with the time since their last batch, as a clock that wraps each day."""
    ms = elapsed_ms("last_batch", as_of)
    text = F.concat(format_duration(int_div(ms, 1000), "hms"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
    return (processes.where((F.col("session_id") > first_user_session) & ~F.col("status").isin(*V.IDLE_STATUS)
                            & ~F.col("command").isin(*V.IDLE_COMMANDS))
            .withColumn("batch_duration", text))


def threadpool_waits(tasks: DataFrame) -> DataFrame:
    return tasks.where("wait_type = 'THREADPOOL'")


def running_requests(requests: DataFrame, sessions: DataFrame, texts: DataFrame, n: int = 25) -> DataFrame:
    """Largest running requests by CPU, then elapsed time, with their current statement."""
    users = sessions.where("is_user_process").select("session_id", "login_name", "host_name")
    top = requests.join(users, "session_id").orderBy(F.desc("cpu_time"), F.desc("elapsed_ms"), "session_id", "request_id").limit(n)
    statement = slice_statement("text", "statement_start_offset", "statement_end_offset")
    return (top.join(texts, "sql_handle", "left").withColumn("statement_text", statement)
            .drop("statement_start_offset", "statement_end_offset", "sql_handle"))


def requests_by_hash(requests: DataFrame, n: int = 10, cut: int = 256) -> DataFrame:
    g = (requests.groupBy("query_hash")
         .agg(F.sum("cpu_time").alias("total_cpu_ms"), F.sum("logical_reads").alias("total_logical_reads"),
              F.min("start_time").alias("earliest_start"), F.count(F.lit(1)).alias("requests"),
              F.min("statement_text").alias("_text")))
    return (g.orderBy(F.desc("total_cpu_ms"), "query_hash").limit(n)
            .withColumn("statement_text", F.left(F.replace(F.replace("_text", F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" ")), F.lit(cut)))
            .drop("_text"))


def agent_jobs(rows: DataFrame, jobs: DataFrame, steps: DataFrame, program: str = "program_name") -> DataFrame:
    """Adds the job and step that a session runs for, where its program name says so: job_id, step_id, job_name, step_name.

    The name holds the job's id as 32 hexadecimal digits, the first three groups of its text form with their bytes reversed. Control
    characters in names show as ``?``. Sessions of other programs, and of jobs that are not there any more, keep
    nulls in the names.
    """
    mark = r"^SQLAgent - .*\(Job 0x([0-9A-Fa-f]{32}) : Step (\d{1,9})\)"
    digits = F.upper(F.regexp_extract(program, mark, 1))
    turned = [F.concat(*[F.substring(digits, at, 2) for at in places]) for places in ((7, 5, 3, 1), (11, 9), (15, 13))]
    job_id = F.concat_ws("-", *turned, F.substring(digits, 17, 4), F.substring(digits, 21, 12))
    shown = lambda c: F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "?")
    names = jobs.select(F.upper(F.col("job_id").cast("string")).alias("job_id"), shown("job_name").alias("job_name"))
    parts = steps.select(F.upper(F.col("job_id").cast("string")).alias("job_id"), F.col("step_id").cast("int").alias("step_id"), shown("step_name").alias("step_name"))
    known = names.join(parts, "job_id")
    step = F.regexp_extract(program, mark, 2).try_cast("int")
    return rows.withColumns({"job_id": F.when(digits != "", job_id), "step_id": F.when(digits != "", step)}).join(known, ["job_id", "step_id"], "left")


COUNTS = ["cpu", "reads", "writes", "physical_io", "tempdb_allocations", "tempdb_current", "used_memory"]


def session_report(now: DataFrame, before: DataFrame | None = None, as_of=None, *, kind: str = "session", pattern="",
                   not_kind: str = "session", not_pattern="", sleeping: int = 1, columns=None, sort=None,
                   history: DataFrame | None = None) -> DataFrame:
    """Sessions of one capture, with differences to an earlier capture if one is given.

    ``sleeping``: 0 leaves sleeping sessions out, 1 keeps those with an open transaction,
    2 keeps all. A difference is shown for a request that is the same in both captures
    and did not shrink; only the current tempdb use may go down. ``history`` holds past
    elapsed times per query_hash, shown as an average. ``columns`` and ``sort`` pick and
    order the output.
    """
    rows = filter_sessions(now, kind, pattern, not_kind, not_pattern)
    awake = F.col("status") != "sleeping"
    if sleeping == 0:
        rows = rows.where(awake)
    elif sleeping == 1:
        rows = rows.where(awake | (F.col("open_tran_count") > 0))
    if as_of is not None:
        rows = rows.withColumn("duration", format_duration(elapsed_ms("start_time", as_of), "days"))
    if before is not None:
        counts = [c for c in COUNTS if c in now.columns]
        old = before.select("session_id", "request_id", F.col("start_time").alias("_start"), *[F.col(c).alias(f"_{c}") for c in counts])
        rows = rows.join(old, ["session_id", "request_id"], "left")
        same = F.col("_start") == F.col("start_time")
        delta = lambda c: F.col(c) - F.col(f"_{c}")
        shown = lambda c: same if c == "tempdb_current" else same & (delta(c) >= 0)
        rows = rows.withColumns({f"{c}_delta": F.when(shown(c), delta(c)) for c in counts})
        rows = rows.drop("_start", *[f"_{c}" for c in counts])
    if history is not None:
        past = history.groupBy("query_hash").agg(int_avg("elapsed_ms").alias("avg_elapsed_ms"))
        rows = rows.join(past, "query_hash", "left")
    if columns:
        rows = rows.select(*columns)
    return rows.orderBy(*as_list(sort)) if sort else rows


def open_transactions(transactions: DataFrame, sessions: DataFrame, requests: DataFrame, texts: DataFrame) -> DataFrame:
    """Open transactions with their session, last text and, if running, their command. Sort by begin_time."""
    return (transactions.join(sessions.select("session_id", "login_name", "sql_handle"), "session_id")
            .join(requests.select("session_id", "command"), "session_id", "left")
            .join(texts, "sql_handle").select("session_id", "login_name", "begin_time", "log_records", "log_bytes", "command",
                                              short_text("text", 255, " ").alias("last_text")))


def snapshot_transactions(transactions: DataFrame, sessions: DataFrame) -> DataFrame:
    return (transactions.join(sessions.select("session_id", "host_name", "login_name", "isolation_level"), "session_id")
            .withColumn("isolation_level", decode("isolation_level", V.ISOLATION_LEVELS)))


def connection_counts(connections: DataFrame, keys) -> DataFrame:
    return connections.groupBy(*as_list(keys)).agg(F.count(F.lit(1)).alias("connections"))


def insecure_connections(connections: DataFrame, own_nodes: DataFrame) -> DataFrame:
    """Connections in plain text that are neither local nor traffic between own nodes."""
    own = own_nodes.select(F.col(own_nodes.columns[0]).alias("client_net_address")).distinct().withColumn("_own", F.lit(True))
    kept = (connections.where("encrypt_option <> 'TRUE' and net_transport <> 'Shared memory'")
            .join(own, "client_net_address", "left")
            .where(F.col("_own").isNull() | (F.col("protocol_type") != "Database Mirroring")))
    return connection_counts(kept, ["net_transport", "protocol_type", "endpoint_id", "auth_scheme"])


def temp_space(session_pages: DataFrame, sessions: DataFrame, first_user_session: int = 50) -> DataFrame:
    """Pages allocated, freed and kept per session."""
    total = lambda kind: F.sum(F.col(f"user_objects_{kind}_page_count") + F.col(f"internal_objects_{kind}_page_count"))
    pages = (session_pages.where(F.col("session_id") > first_user_session).groupBy("session_id")
             .agg(total("alloc").alias("allocated_pages"), total("dealloc").alias("deallocated_pages")))
    return (pages.withColumn("net_pages", F.col("allocated_pages") - F.col("deallocated_pages"))
            .withColumn("net_kb", F.col("net_pages") * 8).join(sessions, "session_id"))


def temp_space_running(session_pages: DataFrame, task_pages: DataFrame, requests: DataFrame, min_pages: int = 127) -> DataFrame:
    """Session plus task pages of running requests whose tasks hold more than ``min_pages``, in MB."""
    tasks = task_pages.groupBy("session_id").agg(F.sum("user_objects_alloc_page_count").alias("_a"),
                                                 F.sum("user_objects_dealloc_page_count").alias("_d"))
    mb = lambda c, t: int_div(F.col(c) + F.col(t), 128)
    return (session_pages.join(tasks.where(F.col("_a") > min_pages), "session_id")
            .join(requests.select("session_id", "sql_handle"), "session_id")
            .select("session_id", "sql_handle", mb("user_objects_alloc_page_count", "_a").alias("allocated_mb"),
                    mb("user_objects_dealloc_page_count", "_d").alias("deallocated_mb")))


def temp_space_tasks(task_pages: DataFrame, n: int = 10) -> DataFrame:
    """Sessions whose tasks touched most pages, in MB."""
    pages = sum((F.col(c) for c in ("user_objects_alloc_page_count", "user_objects_dealloc_page_count",
                                    "internal_objects_alloc_page_count", "internal_objects_dealloc_page_count")), F.lit(0))
    return (task_pages.groupBy("session_id").agg(int_div(F.sum(pages), 128).alias("reserved_mb"))
            .orderBy(F.desc("reserved_mb"), "session_id").limit(n))


def memory_grants(grants: DataFrame) -> DataFrame:
    """Grants in MB; ``waiting`` is a request without a grant, or asked for before it was given."""
    never = F.lit("9999-12-31").cast("timestamp_ntz")
    return (grants.withColumn("granted_mb", fixed(F.col("granted_memory_kb") / 1024.0, 2))
            .withColumn("used_mb", fixed(F.col("used_memory_kb") / 1024.0, 2))
            .withColumn("waiting", F.col("request_time") < F.coalesce("grant_time", never)))


def wait_info(waits: DataFrame, keys=("session_id", "request_id")) -> DataFrame:
    """One text per request: ``(n x: times)type`` per wait type, blocked ones first, then by count."""
    keys = as_list(keys)
    per = (waits.groupBy(*keys, "wait_type")
           .agg(F.count("wait_duration_ms").alias("n"), F.min("wait_duration_ms").alias("low"),
                int_avg("wait_duration_ms").alias("mid"), F.max("wait_duration_ms").alias("high"),
                F.max("block_info").alias("block_info")).where("n > 0"))
    text = lambda c: F.col(c).cast("string")
    spread = F.when(F.col("n") == 2, F.concat_ws("/", text("low"), text("high"))).otherwise(
        F.concat_ws("/", text("low"), text("mid"), text("high")))
    times = F.when((F.col("n") == 1) | (F.col("low") == F.col("high")), text("high")).otherwise(spread)
    entry = F.concat(F.lit("("), text("n"), F.lit("x: "), times, F.lit("ms)"), F.col("wait_type"))
    order = F.struct((-F.coalesce(F.col("block_info"), F.lit(-1))).alias("b"), (-F.col("n")).alias("n"), F.col("wait_type").alias("w"),
                     entry.alias("entry"))
    return per.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda r: r["entry"]), ", ").alias("wait_info"))


def lock_counts(locks: DataFrame) -> DataFrame:
    """Requests per session, database, object and kind of lock."""
    return (locks.groupBy("session_id", "database_name", F.coalesce("object_name", F.lit("(null)")).alias("object_name"),
                          "resource_type", "request_mode", "request_status").agg(F.count(F.lit(1)).alias("request_count")))


def lock_tree(locks: DataFrame) -> DataFrame:
    """Per session and database: its own locks, and its objects with theirs, as nested arrays.

    Rows are first counted per kind of lock, so an array is as long as there are kinds and
    names, not requests.
    """
    own = F.col("resource_type") == "DATABASE"
    named = F.when(~own, F.coalesce("object_name", F.lit("(null)")))
    base = ["session_id", "database_name"]
    counts = (locks.groupBy(*base, named.alias("object_name"), "resource_type", "request_mode", "request_status")
              .agg(F.count(F.lit(1)).alias("request_count")))
    lock = F.struct("resource_type", "request_mode", "request_status", "request_count")
    per_object = counts.groupBy(*base, "object_name").agg(F.sort_array(F.collect_list(lock)).alias("locks"))
    is_base = F.col("object_name").isNull()
    return per_object.groupBy(*base).agg(
        F.first(F.when(is_base, F.col("locks")), ignorenulls=True).alias("database_locks"),
        F.sort_array(F.collect_list(F.when(~is_base, F.struct("object_name", "locks")))).alias("objects"))


def tran_log_writes(log: DataFrame) -> DataFrame:
    """One text per session: ``database:wN (K kB)`` per database."""
    per = log.groupBy("session_id", "database_name").agg(F.sum("log_records").alias("n"), F.sum("log_bytes").alias("b"))
    entry = F.concat("database_name", F.lit(":w"), F.col("n").cast("string"), F.lit(" ("), int_div("b", 1024).cast("string"), F.lit(" kB)"))
    rows = F.sort_array(F.collect_list(F.struct("database_name", entry.alias("e"))))
    return per.groupBy("session_id").agg(F.array_join(F.transform(rows, lambda r: r["e"]), ", ").alias("tran_log_writes"))


def top_wait_per_request(waits: DataFrame, keys=("session_id", "request_id"), tie="task_id") -> DataFrame:
    """One wait per request: lock waits first, then the longest, then the blocked."""
    order = [F.when(like("wait_type", "LCK\\_%", escape="\\"), 1).otherwise(99), F.desc("wait_time"), F.desc("blocked"), F.asc(tie)]
    return top_k_per_group(waits, as_list(keys), order, 1)


def memory_info(sessions: DataFrame, grants: DataFrame, semaphores: DataFrame, groups: DataFrame, pools: DataFrame) -> DataFrame:
    """Grant, semaphore, workload group and pool of every session, as structs; null where unknown."""
    part = lambda df, name, *keys: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    return (part(pools, "pool", "pool_id")
            .join(part(groups.withColumnRenamed("pool_id", "_gp").withColumn("pool_id", F.col("_gp")).drop("_gp"), "workload_group", "group_id", "pool_id"), "pool_id", "right")
            .drop("pool_id")
            .join(part(semaphores, "semaphore", "semaphore_id")
                  .join(sessions.join(grants, "session_id", "left"), "semaphore_id", "right"), "group_id", "right"))
