"""Reports on small literal tables: cuts, resets, ties, empty input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsmetrics.functions import fixed_values as V
from opsmetrics.plans import backups, counters, indexes, jobs, replication, security, sessions, storage, triage, workload

WAITS = "wait_type string, waiting_tasks_count bigint, wait_time_ms bigint, signal_wait_time_ms bigint"


def waits(spark, rows):
    return spark.createDataFrame(rows, WAITS)


def test_pareto_keeps_the_row_that_crosses_the_line(spark):
    df = waits(spark, [("A", 1, 94, 0), ("B", 1, 2, 0), ("C", 1, 4, 0), ("WAITFOR", 1, 1000, 0), ("Z", 0, 500, 0)])
    out = {r.wait_type: r.running_pct for r in counters.top_waits(df).collect()}
    assert out == {"A": 94.0, "C": 98.0}
    assert set(r.wait_type for r in counters.top_waits(df, cutoff=99).collect()) == {"A", "B", "C"}


def test_shares_sum_to_one_hundred(spark):
    df = waits(spark, [(f"W{i}", i + 1, 25 * (i + 1), i) for i in range(8)])
    out = counters.top_waits(df, cutoff=101)
    assert round(out.agg(F.sum("wait_pct")).first()[0], 1) == 100.0


def test_top_waits_of_nothing(spark):
    assert counters.top_waits(waits(spark, [])).count() == 0


def test_signal_bands(spark):
    word = lambda s: counters.signal_ratio(waits(spark, [("A", 1, 100, s)])).first().assessment
    assert word(21) == V.SIGNAL_BANDS[0][1] and word(20) == word(11) == V.SIGNAL_BANDS[1][1] and word(10) == V.SIGNAL_OK
    assert counters.signal_ratio(waits(spark, [("A", 1, 0, 0)])).first().signal_wait_pct is None


@pytest.mark.parametrize("mode,want", [("raw", {"a": 5, "b": -9, "n": 3}), ("floor", {"a": 5, "b": 0, "n": 3}), ("drop", {"a": 5, "n": 3})])
def test_counter_resets(spark, mode, want):
    first = spark.createDataFrame([("a", 10), ("b", 10)], "k string, v bigint")
    last = spark.createDataFrame([("a", 15), ("b", 1), ("n", 3)], "k string, v bigint")
    assert {r.k: r.v for r in counters.counter_delta(first, last, "k", ["v"], mode).collect()} == want


def test_delta_with_itself_is_empty(spark):
    df = waits(spark, [("A", 1, 94, 0), ("B", 1, 2, 0)])
    assert counters.wait_delta(df, df).count() == 0


def test_wait_categories(spark):
    names = {"LCK_M_X": "Locks", "PAGEIOLATCH_SH": "Page I/O Latch", "PAGELATCH_EX": "Page Latch (non-I/O)", "LATCH_EX": "Latch (non-buffer)", "RESOURCE_SEMAPHORE": "Memory",
             "RESOURCE_SEMAPHORE_QUERY_COMPILE": "Compilation", "WRITELOG": "Writelog", "XE_TIMER_EVENT": "IGNORABLE", "OTHER": "OTHER"}
    df = spark.createDataFrame([(n,) for n in names], "wait_type string")
    assert {r.wait_type: r.c for r in df.select("wait_type", counters.wait_category().alias("c")).collect()} == names


def test_snapped_window_defaults(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    df = spark.createDataFrame([(t(1),), (t(3),), (t(5),)], "at timestamp_ntz")
    snap = lambda *a: tuple(counters.snap_window(df, "at", *a).first())
    assert snap() == (t(1), t(5)) and snap(t(2), t(4)) == (t(1), t(5)) and snap(t(3), t(3)) == (t(3), t(3))


def test_file_latency_cuts(spark):
    files = spark.createDataFrame([(1, i, f"f{i}", "ROWS") for i in range(5)], "database_id int, file_id int, name string, type_desc string")
    io = spark.createDataFrame([(1, 0, 10, 49, 0), (1, 1, 10, 50, 0), (1, 2, 10, 200, 0), (1, 3, 10, 500, 0), (1, 4, 0, 0, 0)],
                               "database_id int, file_id int, num_of_reads bigint, io_stall_read_ms bigint, num_of_bytes_read bigint").withColumns({"num_of_writes": F.lit(0), "io_stall_write_ms": F.lit(0)})
    got = {r.file_id: r.performance for r in storage.file_latency(io, files).collect()}
    assert got == {0: "Excellent (<5ms)", 1: "Good (5-10ms)", 2: "* Slow (20-50ms) *", 3: V.READ_SLOWEST}
    smooth = {r.file_id: r.avg_read_ms for r in storage.file_latency(io, files, smooth=True).collect()}
    assert smooth[1] == 4.5 and smooth[4] == 0.0


def test_backup_alerts(spark):
    as_of = F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")
    dbs = spark.createDataFrame([(n, "FULL", "ONLINE") for n in "abc"] + [("s", "SIMPLE", "ONLINE"), ("off", "FULL", "OFFLINE")], "database_name string, recovery_model_desc string, state_desc string")
    at = lambda **k: dt.datetime(2024, 1, 31, 12) - dt.timedelta(**k)
    sets = spark.createDataFrame([("a", "D", at(hours=168)), ("a", "L", at(minutes=60)), ("b", "D", at(hours=169)), ("b", "L", at(minutes=61)), ("s", "D", at(hours=1))],
                                 "database_name string, type string, backup_finish_date timestamp_ntz")
    got = {r.database_name: (r.full_status, r.log_status) for r in backups.backup_status(dbs, sets, as_of).collect()}
    assert got == {"a": ("OK", "OK"), "b": ("*** FULL BACKUP OVERDUE ***", "*** LOG BACKUP OVERDUE ***"),
                   "c": ("*** NO FULL BACKUP ***", "*** NO LOG BACKUP (FULL recovery!) ***"), "s": ("OK", "OK")}
    assert sorted(r[0] for r in backups.log_gaps(dbs, sets, as_of).collect()) == ["b", "c"]


def test_chain_break(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    rows = [("x", "L", 1, at(25), 1, 5), ("x", "L", 2, at(26), 5, 9), ("x", "L", 3, at(27), 10, 12), ("x", "D", 4, at(28), 1, 1), ("y", "L", 5, at(27), 3, 4)]
    sets = spark.createDataFrame(rows, "database_name string, type string, backup_set_id int, backup_finish_date timestamp_ntz, first_lsn bigint, last_lsn bigint")
    got = backups.chain_breaks(sets, F.lit("2024-01-30").cast("timestamp_ntz")).collect()
    assert [(r.database_name, r.first_lsn, r.prev_last_lsn) for r in got] == [("x", 10, 9)]


def test_schedule_text(spark):
    df = spark.createDataFrame([(8, 62, 2, 0, 4, 15, 90000, 170000, 0, 0), (32, 9, 1, 16, 1, 0, 500, 0, 20240205, 130000), (4, 1, 0, 0, 8, 2, 0, 235959, 20240205, 0)],
                               "freq_type int, freq_interval int, freq_recurrence_factor int, freq_relative_interval int, freq_subday_type int, freq_subday_interval int, active_start_time int, active_end_time int, next_run_date int, next_run_time int")
    got = [(r.occurs, r.occurs_detail, r.frequency, r.next_run) for r in jobs.schedule_text(df).collect()]
    assert got[0] == ("Weekly", "Every 2 weeks(s) on Monday, Tuesday, Wednesday, Thursday, Friday", "Occurs every 15 Minute(s) between 09:00:00 and 17:00:00", dt.datetime(1900, 1, 1))
    assert got[1] == ("Monthly relative", "The Last Weekday of every 1 month(s)", "Occurs once at 00:05:00", dt.datetime(2024, 2, 5, 13))
    assert got[2][1:3] == ("Every 1 day(s)", "Occurs every 2 Hour(s) between 00:00:00 and 23:59:59")


def test_wait_text(spark):
    df = spark.createDataFrame([(1, "A", 5, 0), (1, "A", 7, 0), (1, "B", 3, 1), (1, "C", 1, 0), (1, "C", 2, 0), (1, "C", 9, 0), (2, "D", 4, None), (2, "D", 4, None)],
                               "session_id int, wait_type string, wait_duration_ms bigint, block_info int")
    got = {r.session_id: r.wait_info for r in sessions.wait_info(df, "session_id").collect()}
    assert got == {1: "(1x: 3ms)B, (3x: 1/4/9ms)C, (2x: 5/7ms)A", 2: "(2x: 4ms)D"}


def index_columns(spark, indexes_):
    rows = [(1, i, f"ix{i}", n + 1, n + 1, c.strip("-"), c.startswith("-"), False) for i, cols, _ in indexes_ for n, c in enumerate(cols)]
    rows += [(1, i, f"ix{i}", 0, 50 + n, c, False, True) for i, _, inc in indexes_ for n, c in enumerate(inc)]
    return spark.createDataFrame(rows, "object_id int, index_id int, index_name string, key_ordinal int, column_id int, column_name string, is_descending_key boolean, is_included_column boolean")


def test_duplicate_and_redundant_indexes(spark):
    cols = index_columns(spark, [(1, ["a"], []), (2, ["a"], ["z"]), (3, ["b", "c"], []), (4, ["b", "c"], []), (5, ["b"], []), (6, ["-b", "c"], []), (7, ["d"], [])])
    dup = {r.index_id: r.duplicate_of for r in indexes.duplicate_indexes(cols).collect()}
    assert dup == {2: 1, 4: 3}
    red = {r.index_id: (r.covered_by, r.covering, r.same_keys) for r in indexes.redundant_indexes(cols).collect()}
    assert red == {1: (None, 0, 1), 3: (None, 0, 1), 4: (None, 0, 1), 5: (3, 3, 0), 6: (None, 0, 2)}


def test_pending_commands(spark):
    agents = spark.createDataFrame([(1, 10, "p", "s1"), (2, 10, "p", "s2"), (3, 10, "p", "virtual"), (4, 11, "p", "s1")], "agent_id int, publisher_database_id int, publication string, subscriber_db string")
    history = spark.createDataFrame([(1, 5), (1, 7), (4, 99)], "agent_id int, xact_seqno bigint")
    commands = spark.createDataFrame([(10, s) for s in (1, 5, 7, 7, 8, 9)] + [(11, 50)], "publisher_database_id int, xact_seqno bigint")
    got = {(r.publisher_database_id, r.subscriber_db): r.pending_commands for r in replication.pending_commands(agents, history, commands).collect()}
    assert got == {(10, "s1"): 2, (10, "s2"): 6}


def test_config_rules(spark):
    df = spark.createDataFrame([("max degree of parallelism", 0), ("max degree of parallelism", 9), ("max degree of parallelism", 8), ("max server memory (MB)", 4096), ("fill factor (%)", 80), ("unknown", 1), ("Agent XPs", 1)], "name string, value_in_use bigint")
    got = {(r.name, r.value_in_use): r.recommendation for r in security.config_audit(df).collect()}
    assert got[("max degree of parallelism", 9)] == "* Consider <=8 for OLTP workloads *" and got[("max degree of parallelism", 8)] == "OK"
    assert got[("max server memory (MB)", 4096)] == "OK - set to 4096 MB" and got[("fill factor (%)", 80)] == "Set to 80%"
    assert ("unknown", 1) not in got and got[("Agent XPs", 1)] == "Review manually"


def test_storage_tiers(spark):
    files = spark.createDataFrame([(1, 1, "f", 129 * 131072), (1, 2, "g", 130 * 131072), (1, 3, "h", 9000 * 131072)], "database_id int, file_id int, name string, size bigint")
    samples = spark.createDataFrame([(1, f, ms, n, n * 1048576) for f in (1, 2, 3) for ms, n in ((0, 0), (1000, 450), (3000, 1349))],
                                    "database_id int, file_id int, sample_ms bigint, transfer_count bigint, byte_count bigint").withColumn("b", F.lit(0))
    got = {r.file_id: (r.tier_gb, r.max_iops, r.iops_near_limit, r.mbps_near_limit) for r in storage.near_limit(samples, files, "b").collect()}
    assert got == {1: (129, 450.0, 1, 2), 2: (513, 450.0, 0, 2)}


def test_triage_goes_on_after_a_failure(spark):
    dbs = spark.createDataFrame([("a", "FULL", "ONLINE")], "database_name string, recovery_model_desc string, state_desc string")
    out = triage.triage({"databases": dbs, "waits": dbs}, F.lit("2024-01-01").cast("timestamp_ntz"))
    assert "database_posture" in out.reports and "top_waits" in out.errors
    assert out.errors["file_latency"] == "table not collected: file_io"


def test_triage_goes_on_when_a_report_fails_as_it_runs(spark):
    dbs = spark.createDataFrame([("a", "FULL", "ONLINE", "x")], "database_name string, recovery_model_desc string, state_desc string, extra string")
    broken = spark.createDataFrame([("a", "D")], "database_name string, type string").select(
        "database_name", "type", F.raise_error(F.lit("torn page")).cast("timestamp_ntz").alias("backup_finish_date"))
    built = triage.Triage({"database_posture": triage.posture(dbs), "last_backups": broken, "again": triage.posture(dbs)}, {"memory": "not collected"})
    out = built.run()
    assert list(out.reports) == ["database_posture", "again"] and set(out.errors) == {"memory", "last_backups"}
    assert [tuple(r) for r in out.reports["again"].collect()] == [("a", "ONLINE", "FULL")]


def test_procedures_in_both_samples_count_whatever_their_rank(spark):
    schema = "name string, execution_count bigint, total_worker_time bigint, total_elapsed_time bigint, sample_time string, cached_time string"
    def sample(rows, at):
        df = spark.createDataFrame([(name, n, w, w, at, "2024-01-01 00:00:00") for name, n, w in rows], schema)
        return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("sample_time", "cached_time")})
    first = sample([("a", 1, 1), ("b", 5, 100)], "2024-01-01 00:00:00")
    last = sample([("a", 41, 900), ("b", 6, 120), ("c", 9, 999)], "2024-01-01 00:00:10")
    got = [(r.name, r.delta_total_worker_time, r.calls_per_second) for r in workload.procedure_delta(first, last, n=1).collect()]
    assert got == [("a", 899, 4)]
    assert [r.calls_per_second for r in workload.procedure_delta(first, first).collect()] == [0, 0]


def test_session_filters(spark):
    df = spark.createDataFrame([(1, "app_a", "db", "u", "h", "running", 0), (2, "appXa", "db", "u", "h", "sleeping", 1), (3, "other", "db", "u", "h", "sleeping", 0)],
                               "session_id int, program_name string, database_name string, login_name string, host_name string, status string, open_tran_count int")
    ids = lambda **k: sorted(r.session_id for r in sessions.session_report(df, **k).collect())
    assert ids() == [1, 2] and ids(sleeping=2) == [1, 2, 3] and ids(sleeping=0) == [1]
    assert ids(kind="program", pattern="app_a") == [1, 2] and ids(not_kind="program", not_pattern="app%", sleeping=2) == [3] and ids(pattern=0, sleeping=2) == [1, 2, 3]


def test_small_reports(spark):
    from opsmetrics.operators import sets
    from opsmetrics.plans import blocking

    requests = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "sid int, blk int")
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "session_id int, text string")
    assert [(r.sid, r.text) for r in blocking.blocked_processes(requests, texts).collect()] == [(2, "b")]

    commands = spark.createDataFrame([(5, 1), (5, 1), (5, 2), (6, 1)], "xact_seqno bigint, publisher_database_id int")
    assert replication.commands_of(commands, 5, 1).first().command_count == 2

    tasks = spark.createDataFrame([(1, "THREADPOOL"), (2, "WRITELOG")], "session_id int, wait_type string")
    assert [r.session_id for r in sessions.threadpool_waits(tasks).collect()] == [1]

    users = spark.createDataFrame([(1, "h", "l", 2), (2, "h", "l", 9)], "session_id int, host_name string, login_name string, isolation_level int")
    trans = spark.createDataFrame([(1, 10), (2, 11)], "session_id int, transaction_id int")
    assert sorted((r.session_id, r.isolation_level) for r in sessions.snapshot_transactions(trans, users).collect()) == [(1, "ReadCommitted"), (2, None)]

    locks = spark.createDataFrame([(1, "d", "o", "KEY", "X", "GRANT"), (1, "d", "o", "KEY", "X", "GRANT"), (1, "d", None, "PAGE", "S", "WAIT")],
                                  "session_id int, database_name string, object_name string, resource_type string, request_mode string, request_status string")
    assert sorted((r.object_name, r.request_count) for r in sessions.lock_counts(locks).collect()) == [("(null)", 1), ("o", 2)]

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, city string")
    assert sorted(r.id for r in sets.drop_dup_key(rows, "city", "id").collect()) == [1, 3]
    kept, rejected = sets.split_dup_key(rows, "city", "id")
    assert sorted(r.id for r in kept.collect()) == [1, 3] and [r.id for r in rejected.collect()] == [2]


def test_contains_join_gives_the_same_rows_for_few_and_many_names(spark):
    from opsmetrics.operators.joins import contains_join

    df = spark.createDataFrame([(1, "red apple"), (1, "red apple"), (2, "Green"), (3, None), (4, "")], "i int, t string")
    names = spark.createDataFrame([("red",), ("app",), ("green",), ("long name that fits nowhere",), (None,), ("",)], "n string")
    for ignore_case in (False, True):
        one, other = (sorted(map(tuple, contains_join(df, names, "t", "n", few, ignore_case).collect())) for few in (200, 1))
        assert one == other and len(one) == 4 + ignore_case


def test_triage_lists_what_fails_or_hangs(spark):
    """A failing and a hanging report are noted, the hanging one's job is cancelled, the others run."""
    import time

    from pyspark.sql import functions as F

    from opsmetrics.plans.triage import Triage

    good = spark.range(5)
    bad = spark.range(5).select(F.raise_error(F.lit("broken")).cast("int").alias("x"))
    slow = spark.range(0, 1 << 44, 1, 4).select(F.max(F.hash("id")).alias("x"))
    start = time.time()
    done = Triage({"good": good, "bad": bad, "slow": slow, "after": good}, {"none": "table not collected: x"}).run(limit=20)
    assert time.time() - start < 60
    assert list(done.reports) == ["good", "after"] and done.reports["after"].count() == 5
    assert done.errors["slow"] == "stopped after 20 s" and "broken" in done.errors["bad"] and done.errors["none"].endswith("x")
    tracker = spark.sparkContext.statusTracker()
    for _ in range(30):
        if not tracker.getActiveJobsIds():
            break
        time.sleep(1)
    assert not tracker.getActiveJobsIds()


def test_agent_jobs(spark):
    from opsmetrics.plans.sessions import agent_jobs

    jobs = spark.createDataFrame([("0102aabb-0304-0506-0708-090a0b0c0d0e", "nightly\x02")], "job_id string, job_name string")
    steps = spark.createDataFrame([("0102AABB-0304-0506-0708-090A0B0C0D0E", 2, "load")], "job_id string, step_id int, step_name string")
    name = "SQLAgent - TSQL JobStep (Job 0xBBAA0201040306050708090A0B0C0D0E : Step {})"
    rows = spark.createDataFrame([(1, name.format(2)), (2, name.format(3)), (3, "other"), (4, None), (5, name.format("x"))], "s int, program_name string")
    got = {r.s: (r.job_id, r.step_id, r.job_name, r.step_name) for r in agent_jobs(rows, jobs, steps).collect()}
    job = "0102AABB-0304-0506-0708-090A0B0C0D0E"
    assert got == {1: (job, 2, "nightly?", "load"), 2: (job, 3, None, None), 3: (None,) * 4, 4: (None,) * 4, 5: (None,) * 4}
