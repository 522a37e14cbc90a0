"""Aggregation shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import col, safe_div
from ..session import materialise
from .windows import as_list, attach, grand_total


def sum_if(condition: Column, value=1) -> Column:
    return F.sum(F.when(condition, col(value)).otherwise(F.lit(0)))


def last_by_kind(df: DataFrame, keys, kind: str, ts: str, kinds: dict) -> DataFrame:
    """Latest time of each kind; ``kinds`` maps a code to a new column name."""
    return df.groupBy(*as_list(keys)).agg(
        *[F.max(F.when(F.col(kind) == code, F.col(ts))).alias(name) for code, name in kinds.items()])


def share_of_total(df: DataFrame, measure: str, name: str = "share_pct") -> DataFrame:
    """Percent of the whole-table sum, on an already grouped table.

    The grouped rows are written once, for the total and the shares.
    """
    df = materialise(df)
    return df.withColumn(name, safe_div(100.0 * F.col(measure).cast("double"),
                                        grand_total(df, F.sum(measure)).cast("double")))


def joined_text(df: DataFrame, keys, order, text, name: str, separator: str = ", ",
                block: str | None = None) -> DataFrame:
    """Ordered text of a group.

    With ``block``, a column that never decreases along the order, each block is joined
    on its own first, so no task sorts the whole group.
    """
    keys, order = as_list(keys), as_list(order)

    def ordered(df: DataFrame, by: list, entry: Column, sort: list) -> DataFrame:
        rows = F.sort_array(F.collect_list(F.struct(*sort, entry.alias("_text"))))
        return df.groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r["_text"]), separator).alias("_text"))

    order = [F.col(c).alias(f"_o{i}") if isinstance(c, str) else c.alias(f"_o{i}") for i, c in enumerate(order)]
    if block:
        part = ordered(df, keys + [block], col(text), order)
        return ordered(part, keys, F.col("_text"), [F.col(block)]).withColumnRenamed("_text", name)
    return ordered(df, keys, col(text), order).withColumnRenamed("_text", name)


def text_chunks(df: DataFrame, keys, order, text, block: str, name: str = "text", separator: str = ", ") -> DataFrame:
    """Ordered text of a group in numbered chunks, one for each block: keys, ``chunk_no`` from 1, text.

    ``block`` is a column that never decreases along the order. The chunks, joined by the separator in order of their numbers,
    are the whole text; no task and no row holds more than one block of it. Numbers come from the blocks alone.
    """
    keys = as_list(keys)
    number = F.row_number().over(W.partitionBy(*keys).orderBy(block)).cast("bigint")
    numbers = df.select(*keys, block).distinct().withColumn("chunk_no", number)
    parts = joined_text(df, keys + [block], order, text, name, separator)
    return attach(parts, numbers, keys + [block], "inner").select(*keys, "chunk_no", name)


def pivot(df: DataFrame, keys, column: str, values: list, agg: Column) -> DataFrame:
    return df.groupBy(*as_list(keys)).pivot(column, values).agg(agg)

