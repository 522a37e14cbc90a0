"""Streaming forms of the polling collectors.

Every function takes a streaming (or batch) DataFrame; ``run_once`` drains what has
arrived, with its progress kept in the checkpoint folder.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import instant_micros, safe_div
from ..operators.ranking import latest_per_key
from ..operators.windows import as_list, neighbour, running, time_block
from ..session import checkpoint_dir, drop_tables

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def read_snapshots(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, outside the JVM's memory, and write changes only."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run_once(stream: DataFrame, path: str, mode: str = "append", partition_by=None, progress: list | None = None) -> DataFrame:
    """Process everything that has arrived, append it as parquet, and read the table back.

    ``progress`` collects what the engine reports of each batch.
    """
    writer = (stream.writeStream.format("parquet").outputMode(mode).trigger(availableNow=True)
              .option("path", path).option("checkpointLocation", f"{path}-progress"))
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with state_on_disk(stream.sparkSession):
        running_query = writer.start()
        running_query.awaitTermination()
    if progress is not None:
        progress += running_query.recentProgress
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, path: str, write, mode: str = "append") -> None:
    """Process what has arrived with ``write(batch, batch_id)``."""
    with state_on_disk(stream.sparkSession):
        (stream.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True)
         .option("checkpointLocation", f"{path}-progress").start().awaitTermination())


def close_stream(source: DataFrame, path: str, ts: str, after: str) -> None:
    """Let one row arrive in ``path`` that lies ``after`` the newest time and is null otherwise.

    It moves the watermark past the end, so that the next run gives out every window that is still open. Its own window
    stays open and is never given out. For a stream that has ended: later rows would come too late.
    """
    last = source.agg((F.max(F.col(ts)) + F.expr(f"interval {after}")).alias(ts)).where(F.col(ts).isNotNull())
    columns = [F.col(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in source.schema]
    last.select(*columns).coalesce(1).write.mode("append").parquet(path)


def append_snapshot(stream: DataFrame, path: str, at: Column | None = None, trigger: str | None = None):
    """Append each arriving snapshot with the time it was collected; one folder per batch.

    ``at`` is that time as an expression of the arriving rows; without it, the clock at the start of the batch.
    A batch that runs again after a failure replaces its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("runtime", (F.localtimestamp() if at is None else at).cast("timestamp_ntz"))
         .write.mode("overwrite").parquet(f"{path}/capture={batch_id}"))

    if trigger is None:
        run_batches(stream, path, write)
        return stream.sparkSession.read.parquet(path)
    return (stream.writeStream.foreachBatch(write).trigger(processingTime=trigger)
            .option("checkpointLocation", f"{path}-progress").start())


def event_filter(df: DataFrame, rules: list[Column]) -> DataFrame:
    """Rows that meet any rule."""
    keep = rules[0]
    for rule in rules[1:]:
        keep = keep | rule
    return df.where(keep)


def load_new(source: DataFrame, target: DataFrame, ts: str) -> DataFrame:
    """Batch form of the mark: rows newer than the newest stored; all of them on the first run."""
    mark = target.agg(F.max(ts)).scalar()
    return source.where(mark.isNull() | (F.col(ts) > mark))


def load_since_id(source: DataFrame, mark: int | None, record_id: str, overlap: int = 5) -> DataFrame:
    """Rows past the last id, read with an overlap. Duplicates from the overlap are left to the reader."""
    return source if mark is None else source.where(F.col(record_id) > mark - overlap)


def unique_records(stream: DataFrame, keys, ts: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each record once; with a time column, state older than ``delay`` is dropped."""
    if ts is None:
        return stream.dropDuplicates(as_list(keys))
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(as_list(keys))


def tumbling(stream: DataFrame, ts: str, width: str, keys, aggs: list[Column], delay: str = "1 hour") -> DataFrame:
    return (stream.withWatermark(ts, delay).groupBy(F.window(ts, width), *as_list(keys)).agg(*aggs)
            .withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")}).drop("window"))


def sliding(stream: DataFrame, ts: str, width: str, slide: str, keys, aggs: list[Column], delay: str = "1 hour") -> DataFrame:
    return (stream.withWatermark(ts, delay).groupBy(F.window(ts, width, slide), *as_list(keys)).agg(*aggs)
            .withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")}).drop("window"))


def activity_sessions(df: DataFrame, key: str, ts: str, gap: str, delay: str = "1 hour", id_col: str | None = None) -> DataFrame:
    """Runs of activity with no pause of ``gap`` or more; the end is the last event plus the gap.

    A stream uses session windows. In batch the same runs come from windows cut by time, so
    the events of one busy key spread over many tasks; ``id_col`` tells events of one time apart.
    """
    if df.isStreaming:
        return (df.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events"))
                .select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events"))
    order = [ts] + ([id_col] if id_col else [])
    span = F.expr(f"interval {gap}")
    rows = df.select(key, *order, time_block(ts).alias("_slice"))
    rows = neighbour(rows, key, order, "_slice", {"_before": ts})
    fresh = F.col("_before").isNull() | (F.col(ts) >= F.col("_before") + span)
    rows = running(rows.withColumn("_fresh", fresh.cast("int")), key, order, "_slice", {"_session": "_fresh"})
    return (rows.groupBy(key, "_session").agg(F.min(ts).alias("session_start"), (F.max(ts) + span).alias("session_end"), F.count(F.lit(1)).alias("events"))
            .drop("_session"))


def _stored_samples(spark: SparkSession, path: str, fields, batch_id: int, fold: int) -> DataFrame:
    """The newest sample of each counter before a batch: the last folded table and the changes since."""
    base = batch_id // fold * fold
    parts = [f"{path}/folded/{base}"] * (base > 0) + [f"{path}/changed/{i}" for i in range(base, batch_id)]
    rows = spark.read.schema(fields).parquet(*parts) if parts else spark.createDataFrame([], fields)
    return latest_per_key(rows, "counter", "at", ["at", "value"])


def _fold_samples(spark: SparkSession, path: str, fields, batch_id: int, fold: int) -> None:
    """Before the first batch after ``fold`` others: one table of all counters; what the last but one was made of goes."""
    if batch_id == 0 or batch_id % fold:
        return
    old = batch_id - fold
    parts = [f"{path}/folded/{old}"] * (old > 0) + [f"{path}/changed/{i}" for i in range(old, batch_id)]
    rows = spark.read.schema(fields).parquet(*parts)
    latest_per_key(rows, "counter", "at", ["at", "value"]).write.mode("overwrite").parquet(f"{path}/folded/{batch_id}")
    drop_tables(spark, [f"{path}/folded/{old - fold}", *[f"{path}/changed/{i}" for i in range(max(0, old - fold), old)]])


def sample_deltas(stream: DataFrame, path: str, counter: str, at: str, value: str, block, fold: int = 16) -> DataFrame:
    """Difference of each sample to the one before, per counter, across batches.

    Each batch writes the newest sample of the counters that it brought, so what is written follows the changed counters
    and not all of them; every ``fold`` batches the changes are folded into one table. A batch that runs again starts from
    the same tables and replaces its own output. Inside a batch the window is cut by ``block`` (see operators.windows), so one
    busy counter does not land in one task. Samples no newer than the stored one go to
    ``late``: they have no place left to go.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(F.col(counter).alias("counter"), F.col(at).alias("at"), F.col(value).alias("value"),
                            block.alias("_day")).persist()
        fields = rows.select("counter", "at", "value").schema
        _fold_samples(spark, path, fields, batch_id, fold)
        known = _stored_samples(spark, path, fields, batch_id, fold).select(
            "counter", F.col("at").alias("last_at"), F.col("value").alias("last_value"))
        seen = rows.join(known, "counter", "left")
        stale = F.coalesce(F.col("at") <= F.col("last_at"), F.lit(False))
        seen.where(stale).select("counter", "at", "value").write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        fresh = seen.where(~stale)
        near = neighbour(fresh, "counter", ["at"], "_day", {"before_at": "at", "before": "value"})
        before_at, before = F.coalesce("before_at", "last_at"), F.coalesce("before", "last_value")
        (near.where(before.isNotNull())
         .select("counter", "at", (F.col("value") - before).alias("delta"),
                 ((instant_micros("at") - instant_micros(before_at)) / 1e6).alias("seconds"))
         .write.mode("overwrite").parquet(f"{path}/deltas/batch={batch_id}"))
        newest = latest_per_key(fresh.select("counter", "at", "value"), "counter", "at", ["at", "value"])
        newest.write.mode("overwrite").parquet(f"{path}/changed/{batch_id}")
        rows.unpersist()

    run_batches(stream, path, write)
    return stream.sparkSession.read.parquet(f"{path}/deltas").drop("batch")


def interval_rates(samples: DataFrame, keys, at: str, value: str, block: str) -> DataFrame:
    """Growth per second to the next sample, in batch."""
    out = neighbour(samples, keys, [at], block, {"next_at": at, "next_value": value}, step="lead")
    span = (instant_micros("next_at") - instant_micros(at)) / 1e6
    return out.where("next_at is not null").withColumn("per_second", safe_div(F.col("next_value") - F.col(value), span))


def scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
