"""A history of captures as a table: one partition a period, bucketed by key, with retention by whole partitions."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, drop_tables, materialise, recorded


def period(grain: str) -> str:
    """The partition column of a history by ``day``, ``month`` or ``year``."""
    if grain not in ("day", "month", "year"):
        raise ValueError(f"no such period: {grain}")
    return f"capture_{grain}"


def _begin(at: datetime, grain: str) -> date:
    return date(at.year, at.month if grain != "year" else 1, at.day if grain == "day" else 1)


def _after(history: DataFrame, ts: str, border: datetime) -> Column:
    return F.col(ts) > F.lit(border).cast(history.schema[ts].dataType)


def history_database(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A database for histories; its tables lie in ``folder``, by default in the shared folder."""
    place = folder or f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}` LOCATION '{place}'")
    return name


def append_history(df: DataFrame, table: str, ts: str, key: str, buckets: int, grain: str = "day") -> DataFrame:
    """Append captures to ``table`` and read it back; columns are matched by name.

    A period's rows of a bucket are written by one task, so a capture adds one file for each, and a key
    of very many rows is spread over its periods. Filters on the period prune; joins and groups on the key
    need no shuffle where the other side has as many buckets. Choose the grain so that a file has some megabytes.
    """
    spark, part = df.sparkSession, period(grain)
    dated = df.withColumn(part, F.date_trunc(grain, F.col(ts)).cast("date"))
    if spark.catalog.tableExists(table):
        dated = dated.to(spark.table(table).schema)
    bucket = F.pmod(F.hash(key), F.lit(buckets))
    writer = dated.repartition(F.col(part), bucket).write.format("parquet").mode("append")
    writer.partitionBy(part).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return spark.table(table)


def since(history: DataFrame, ts: str, start: datetime, grain: str = "day") -> DataFrame:
    """Captures after ``start``; periods before it are not read."""
    return history.where((F.col(period(grain)) >= F.lit(_begin(start, grain))) & _after(history, ts, start))


def retain_history(spark: SparkSession, table: str, ts: str, days: int, as_of: datetime, grain: str = "day") -> DataFrame:
    """Delete captures that are ``days`` old or older.

    Periods before the border go as whole partitions, without a read; only the border's period is written anew.
    A second run of the same call changes nothing. Rows without a time are kept.
    """
    border, part = as_of - timedelta(days=days), period(grain)
    begin = _begin(border, grain)
    # One row per period. The partition of rows without a time sorts behind all dates.
    held = {r[0].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()}
    gone = {d for d in held if d < begin.isoformat()}
    if begin.isoformat() in held:
        newest = spark.table(table).where(F.col(part) == F.lit(begin))
        fresh = _after(newest, ts, border)
        if newest.where(fresh).isEmpty():
            gone.add(begin.isoformat())
        elif not newest.where(~fresh).isEmpty():
            # Written apart first: a table cannot be read and overwritten at once.
            with recorded() as made:
                kept = materialise(newest.where(fresh))
            # A named partition: an overwrite of the table would take the others with it.
            spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({part} = '{begin.isoformat()}') SELECT * FROM {{kept}}", kept=kept.drop(part))
            drop_tables(spark, made)
    if gone:
        parts = ", ".join(f"PARTITION ({part} = '{d}')" for d in sorted(gone))
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {parts}")
    return spark.table(table)
