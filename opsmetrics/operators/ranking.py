"""Top rows: whole table, per key, by band, by page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .windows import BLOCK, BLOCK_ROWS, as_list, range_blocks


def top_n(df: DataFrame, n: int, *order) -> DataFrame:
    """First ``n`` rows; end ``order`` with a unique key for a repeatable answer."""
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, offset: int, n: int, *order, near: int = 100_000, rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows ``offset`` to ``offset + n`` in order; end ``order`` with a unique key for a repeatable answer.

    Every task keeps the first ``offset + n`` rows while these are at most ``near``. A page further down is looked up in a
    directory: the rows are cut into ranges, their counts are summed up to the page, and only the ranges that
    hold it are sorted.
    """
    if offset + n <= near:
        return df.orderBy(*order).offset(offset).limit(n)
    ranged = range_blocks(df, *order, rows=rows)
    counts = ranged.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("n"))
    until = F.sum("n").over(W.orderBy(BLOCK))
    held = counts.select(BLOCK, (until - F.col("n")).alias("start"), until.alias("until")).where(
        (F.col("start") < offset + n) & (F.col("until") > offset)).collect()
    some = ranged.where(F.col(BLOCK).isin([r[BLOCK] for r in held])).drop(BLOCK)
    return some.orderBy(*order).offset(offset - min((r["start"] for r in held), default=offset)).limit(n)


def top_k_per_group(df: DataFrame, keys, order, k: int, name: str | None = None) -> DataFrame:
    """At most ``k`` rows per key. Every task keeps ``k`` per key before the shuffle."""
    rn = name or "_rn"
    w = W.partitionBy(*as_list(keys)).orderBy(*as_list(order))
    out = df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= k)
    return out if name else out.drop(rn)


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    return top_k_per_group(df, keys, order, 1)


def latest_per_key(df: DataFrame, keys, order, columns) -> DataFrame:
    """``columns`` of the row with the greatest ``order``, by aggregation alone."""
    keys, order, columns = as_list(keys), as_list(order), as_list(columns)
    newest = F.max_by(F.struct(*columns), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col("_row")[c].alias(c) for c in columns])


def nth_highest(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows that hold the ``n``-th highest distinct value."""
    nth = df.select(column).distinct().orderBy(F.desc(column)).limit(n)
    wanted = nth.agg(F.min(column).alias("v"), F.count(F.lit(1)).alias("n")).where(F.col("n") == n)
    return df.where(F.col(column) == wanted.select("v").scalar())


def rank_band(df: DataFrame, low: int, high: int, order, name: str = "row_num") -> DataFrame:
    """Rows ``low`` to ``high`` in order."""
    head = df.orderBy(*as_list(order)).limit(high)
    w = W.orderBy(*as_list(order))
    return head.withColumn(name, F.row_number().over(w)).where(F.col(name) >= low)


def top_k_other(df: DataFrame, key: str, measure: str, k: int, other: str = "Other") -> DataFrame:
    """Totals of the ``k`` largest keys, the rest summed under ``other``."""
    totals = df.groupBy(key).agg(F.sum(measure).alias(measure))
    head = totals.orderBy(F.desc(measure), F.asc(key)).limit(k)
    label = F.col(key).cast("string")
    tail = (totals.join(head.select(key), key, "left_anti")
            .agg(F.sum(measure).alias(measure), F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") > 0).select(F.lit(other).alias(key), measure))
    return head.select(label.alias(key), measure).unionByName(tail)
