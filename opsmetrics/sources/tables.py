"""Reading and writing collected tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, columns=None, batch=None, batch_col: str = "batch") -> DataFrame:
    """One collected table; ``batch`` picks one capture."""
    df = spark.read.parquet(path)
    if batch is not None:
        df = df.where(F.col(batch_col) == F.lit(batch))
    return df.select(*columns) if columns else df


def load_csv(spark: SparkSession, path, schema, header: bool = True, **options) -> DataFrame:
    """Typed bulk load; no schema inference pass."""
    return spark.read.schema(schema).options(header=header, **options).csv(path)


def read_xml_events(spark: SparkSession, path, schema: str | None = None, row_tag: str = "event") -> DataFrame:
    """Files of event documents, one row per ``row_tag`` element."""
    from ..functions.xml import EVENT_SCHEMA

    return spark.read.schema(schema or EVENT_SCHEMA).option("rowTag", row_tag).format("xml").load(path)


def read_logs(spark: SparkSession, paths, pattern: str | None = None, ignore_case: bool = True) -> DataFrame:
    """All log generations in one read, with the file each line came from."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))
    if pattern is None:
        return lines
    if ignore_case:
        return lines.where(F.contains(F.lower("value"), F.lit(pattern.lower())))
    return lines.where(F.contains(F.col("value"), F.lit(pattern)))


def save_as(df: DataFrame, path: str, partition_by=None) -> DataFrame:
    """Create a table from a query and read it back."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def append_to(df: DataFrame, path: str) -> DataFrame:
    """Append by column name to a table that may already exist."""
    spark = df.sparkSession
    try:
        target = spark.read.parquet(path).schema
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        target = None
    (df.to(target) if target is not None else df).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def stage(df: DataFrame, name: str, scope: str = "session") -> DataFrame:
    """Name an intermediate for SQL: ``session`` or ``global``."""
    if scope == "global":
        df.createOrReplaceGlobalTempView(name)
        return df.sparkSession.table(f"global_temp.{name}")
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def values_df(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Inline constant table."""
    return spark.createDataFrame(rows, schema)
