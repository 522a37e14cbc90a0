"""Streams give what the batch form gives, late rows aside."""

import datetime as dt

from pyspark.sql import functions as F

from opsmetrics.sources import tables as src
from opsmetrics.streaming import marks as MK
from opsmetrics.streaming import snapshots as ST


def test_deltas_and_late_samples(spark, tmp_path):
    schema = "counter string, at timestamp_ntz, value bigint"
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    arrivals = [[("a", t(1), 10), ("a", t(2), 15), ("b", t(1), 1)], [("a", t(4), 11), ("b", t(3), 6)], [("a", t(3), 99), ("a", t(5), 12)]]
    for rows in arrivals:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ST.read_snapshots(spark, f"{tmp_path}/in", schema, files_per_batch=1)
    out = ST.sample_deltas(stream, f"{tmp_path}/out", "counter", "at", "value", F.col("at").cast("date"))
    got = sorted((r.counter, r.at, r.delta, r.seconds) for r in out.collect())
    assert got == [("a", t(2), 5, 60.0), ("a", t(4), -4, 120.0), ("a", t(5), 1, 60.0), ("b", t(3), 5, 120.0)]
    late = spark.read.parquet(f"{tmp_path}/out/late").collect()
    assert [(r.counter, r.value) for r in late] == [("a", 99)]


def test_captures_carry_their_own_time(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"{tmp_path}/out"
    for n in (1, 2):
        spark.createDataFrame([(n, dt.datetime(2024, 1, n))], "id int, at timestamp_ntz").coalesce(1).write.mode("append").parquet(source)
        stream = ST.read_snapshots(spark, source, "id int, at timestamp_ntz")
        got = ST.append_snapshot(stream, path)
    times = [r.runtime for r in got.orderBy("id").collect()]
    assert len(times) == 2 and times[0] < times[1]
    named = ST.append_snapshot(ST.read_snapshots(spark, source, "id int, at timestamp_ntz"), f"{tmp_path}/named", F.col("at"))
    assert sorted(r.runtime for r in named.collect()) == [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)]


def test_append_matches_by_name(spark, tmp_path):
    path = f"{tmp_path}/t"
    src.append_to(spark.createDataFrame([(1, "x")], "a int, b string"), path)
    out = src.append_to(spark.createDataFrame([("y", 2)], "b string, a int"), path)
    assert sorted((r.a, r.b) for r in out.collect()) == [(1, "x"), (2, "y")]


def test_marks(spark):
    rows = spark.createDataFrame([(i, dt.datetime(2024, 1, i)) for i in range(1, 6)], "id int, at timestamp_ntz")
    assert ST.load_new(rows, rows.limit(0), "at").count() == 5
    assert ST.load_new(rows, rows.where("id <= 3"), "at").count() == 2
    assert ST.load_since_id(rows, None, "id").count() == 5 and ST.load_since_id(rows, 5, "id", overlap=2).count() == 2


SAMPLES = "counter string, at timestamp_ntz, value bigint"
AT = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)


def arrive(spark, path, rows, schema=SAMPLES):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def windows(spark, path, out, progress):
    stream = ST.read_snapshots(spark, path, SAMPLES).withColumn("time", F.col("at").cast("timestamp"))
    made = ST.tumbling(stream, "time", "10 minutes", "counter", [F.count(F.lit(1)).alias("n")], delay="5 minutes")
    rows = ST.run_once(made, out, progress=progress).select("counter", "window_start", "n").collect()
    return sorted((r.counter, r.window_start.minute + 60 * r.window_start.hour, r.n) for r in rows if r.counter)


def test_windows_settle_and_leave_the_state(spark, tmp_path):
    path, out, progress = f"{tmp_path}/in", f"{tmp_path}/out", []
    arrive(spark, path, [("a", AT(m), 1) for m in range(0, 30)] + [("b", AT(m), 1) for m in range(0, 30, 3)])
    assert windows(spark, path, out, progress) == [("a", 0, 10), ("a", 10, 10), ("b", 0, 4), ("b", 10, 3)]
    arrive(spark, path, [("a", AT(100), 1), ("a", AT(3), 1)])  # the second comes too late
    assert windows(spark, path, out, progress)[2:] == [("a", 20, 10), ("b", 0, 4), ("b", 10, 3), ("b", 20, 3)]
    ST.close_stream(spark.read.parquet(path), path, "at", "1 hour")
    assert windows(spark, path, out, progress)[3:] == [("a", 100, 1), ("b", 0, 4), ("b", 10, 3), ("b", 20, 3)]
    state = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in (x if isinstance(x, dict) else __import__("json").loads(x.json) for x in progress)]
    assert max(state) == 6 and state[-1] == 1  # the closing row's own window


def test_deltas_write_changed_counters_and_fold(spark, tmp_path):
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    arrive(spark, path, [(f"c{i}", AT(0), i) for i in range(50)])
    for k in range(1, 8):
        arrive(spark, path, [("c1", AT(k), 100 * k)])
    stream = ST.read_snapshots(spark, path, SAMPLES, files_per_batch=1)
    got = ST.sample_deltas(stream, out, "counter", "at", "value", F.col("at").cast("date"), fold=3).collect()
    assert sorted((r.counter, r.at, r.delta) for r in got) == [("c1", AT(k), 100 if k > 1 else 99) for k in range(1, 8)]
    sizes = {k: spark.read.parquet(f"{out}/changed/{k}").count() for k in (3, 4, 5, 6, 7)}
    assert set(sizes.values()) == {1} and not (tmp_path / "out/changed/0").exists()
    assert spark.read.parquet(f"{out}/folded/6").count() == 50 and not (tmp_path / "out/folded/0").exists()


def test_increments_from_a_committed_mark(spark, tmp_path):
    out, marks, schema = f"{tmp_path}/out", f"{tmp_path}/marks", "id bigint, v string"
    source = lambda ids: spark.createDataFrame([(i, str(i)) for i in ids], schema)
    load = lambda ids, version: MK.load_increment(source(ids), out, marks, "ring", "id", version)
    read = lambda: sorted(r.id for r in spark.read.schema(schema).parquet(f"{out}/*").collect())
    load([], 0)
    load([1, 2, 4, 6, 7], 1)
    assert read() == [1, 2, 4, 6, 7] and MK.read_mark(spark, marks, "ring", 2) == 7
    for _ in range(2):  # a run that is repeated gives the same
        load([1, 2, 3, 4, 5, 6, 7, 8, 9], 2)
        assert read() == list(range(1, 10)) and MK.read_mark(spark, marks, "ring", 3) == 9
    load([8, 9], 3)
    assert read() == list(range(1, 10)) and MK.read_mark(spark, marks, "ring", 9) == 9
    load([20, 3], 4)  # 3 lies before the overlap
    assert read() == [*range(1, 10), 20] and MK.read_mark(spark, marks, "other", 9) is None


def test_late_rows_go_aside(spark, tmp_path):
    path, out, schema = f"{tmp_path}/in", f"{tmp_path}/out", "id int, at timestamp_ntz"
    for rows in ([(1, AT(0)), (2, AT(60)), (2, AT(60))], [(2, AT(60)), (3, AT(50)), (4, AT(49)), (5, AT(90)), (6, None)], [(7, AT(79)), (5, AT(90)), (8, AT(80))]):
        arrive(spark, path, rows, schema)
        kept, late = MK.split_late(ST.read_snapshots(spark, path, schema), out, "at", "10 minutes", "id")
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3, 5, 6, 8]
    assert sorted(r.id for r in late.collect()) == [4, 7]
