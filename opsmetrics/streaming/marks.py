"""Committed marks: how far a collector has read, kept beside its output.

A mark table has one folder per name and version. A run reads the newest mark below its own version and commits its mark
last, so a run that is repeated starts from the same mark and replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import as_list
from .snapshots import load_since_id, run_batches

_MARK = "name string, value bigint, version bigint"


def read_mark(spark: SparkSession, path: str, name: str, version: int) -> int | None:
    """The newest mark of ``name`` that was committed before ``version``; None if there is none."""
    _ensure(spark, path)
    marks = spark.read.schema(_MARK).parquet(f"{path}/*")
    return marks.where((F.col("name") == name) & (F.col("version") < version)).agg(F.max_by("value", "version")).first()[0]


def commit_mark(spark: SparkSession, path: str, name: str, value: int | None, version: int) -> None:
    """Store the mark of this version, in place of one that an earlier try has stored."""
    rows = [(name, value, version)] if value is not None else []
    spark.createDataFrame(rows, _MARK).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}-{version}")


def _ensure(spark: SparkSession, path: str) -> None:
    """An empty table, so that a first run has something to read."""
    spark.createDataFrame([], _MARK).write.mode("ignore").parquet(f"{path}/start")


def load_increment(source: DataFrame, out: str, marks: str, name: str, record_id: str, version: int, overlap: int = 5) -> None:
    """Append to ``out`` the records that are new since the last committed mark.

    The source is read from ``overlap`` ids before the mark on, for records that became visible late. Those among them
    that are stored already are left out; only the stored tail behind the mark is looked at.
    """
    spark = source.sparkSession
    mark = read_mark(spark, marks, name, version)
    fresh = load_since_id(source, mark, record_id, overlap)
    if mark is not None:
        earlier = [f"{out}/version={v}" for v in _versions(spark, marks, name, version)]
        stored = spark.read.schema(source.schema).parquet(*earlier)
        tail = stored.where((F.col(record_id) > mark - overlap) & (F.col(record_id) <= mark)).select(record_id)
        fresh = fresh.join(tail, record_id, "left_anti").select(*source.columns)
    fresh.write.mode("overwrite").parquet(f"{out}/version={version}")
    newest = spark.read.schema(source.schema).parquet(f"{out}/version={version}").agg(F.max(record_id).cast("bigint")).first()[0]
    known = [m for m in (mark, newest) if m is not None]
    commit_mark(spark, marks, name, max(known) if known else None, version)


def _versions(spark: SparkSession, path: str, name: str, version: int) -> list[int]:
    """Committed versions below ``version``: one number per run."""
    marks = spark.read.schema(_MARK).parquet(f"{path}/*")
    return sorted(r[0] for r in marks.where((F.col("name") == name) & (F.col("version") < version)).select("version").collect())


def split_late(stream: DataFrame, path: str, ts: str, delay: str, keys) -> tuple[DataFrame, DataFrame]:
    """(kept, late): each record once, and rows that come after the watermark has passed them.

    The watermark of a batch is the newest time of the batches before, less ``delay``; it is committed with each batch. Rows
    behind it go to ``late`` instead of vanishing. Other rows are compared with what was kept since the watermark
    and never with older rows, so the work of a batch does not grow with the history.
    """
    keys, schema = as_list(keys), stream.schema
    moment: Column = F.col(ts).cast("timestamp")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = read_mark(spark, f"{path}/marks", "watermark", batch_id)
        line = F.lit(False) if mark is None else F.timestamp_micros(F.lit(mark)) - F.expr(f"interval {delay}") > moment
        batch = batch.persist()
        behind = F.coalesce(line, F.lit(False))
        batch.where(behind).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        fresh = batch.where(~behind).dropDuplicates(keys)
        if mark is not None:
            kept = spark.read.schema(schema).parquet(*[f"{path}/kept/batch={i}" for i in range(batch_id)])
            since = kept.where(moment >= F.timestamp_micros(F.lit(mark)) - F.expr(f"interval {delay}")).select(*keys)
            fresh = fresh.join(since, keys, "left_anti").select(*batch.columns)
        fresh.write.mode("overwrite").parquet(f"{path}/kept/batch={batch_id}")
        newest = batch.agg(F.max(F.unix_micros(moment))).first()[0]
        known = [m for m in (mark, newest) if m is not None]
        commit_mark(spark, f"{path}/marks", "watermark", max(known) if known else None, batch_id)
        batch.unpersist()

    run_batches(stream, path, write)
    read = stream.sparkSession.read.schema(schema)
    return read.parquet(f"{path}/kept/*"), read.parquet(f"{path}/late/*")
