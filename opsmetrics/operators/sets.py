"""Set operations, deduplicated appends and table changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import shift
from .ranking import first_per_key
from .windows import as_list, attach


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def set_diff(a: DataFrame, b: DataFrame, keys, mode: str = "missing") -> DataFrame:
    """``missing``: rows of ``a`` without a match. ``report``: all of ``a`` with an in_both flag."""
    keys = as_list(keys)
    if mode == "missing":
        return a.join(b.select(*keys).distinct(), keys, "left_anti")
    flagged = b.select(*keys).distinct().withColumn("in_both", F.lit(True))
    return a.join(flagged, keys, "left").withColumn("in_both", F.coalesce("in_both", F.lit(False)))


def append_new(target: DataFrame, batch: DataFrame, keys) -> DataFrame:
    """Rows of ``batch`` whose key the target does not hold yet; batch duplicates stay."""
    return batch.join(target.select(*as_list(keys)).distinct(), as_list(keys), "left_anti")


def drop_dup_key(df: DataFrame, keys, order) -> DataFrame:
    """First row per key."""
    return first_per_key(df, keys, order)


def split_dup_key(df: DataFrame, keys, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): the smallest id per key is kept, every other row is rejected."""
    firsts = df.groupBy(*as_list(keys)).agg(F.min(id_col).alias("_first"))
    marked = attach(df, firsts, as_list(keys))
    kept = marked.where(F.col(id_col) == F.col("_first")).drop("_first")
    return kept, marked.where(F.col(id_col) != F.col("_first")).drop("_first")


def update_from(df: DataFrame, other: DataFrame, key, columns: dict) -> DataFrame:
    """New version of ``df``: matched rows take values of ``other``, the rest stay.

    ``columns`` maps a column of ``df`` to the column of ``other`` that replaces it.
    """
    keys = as_list(key)
    side = other.select(*keys, *[F.col(c).alias(f"_new_{n}") for n, c in columns.items()],
                        F.lit(True).alias("_hit"))
    out = df.join(side, keys, "left")
    out = out.withColumns({n: F.when(F.col("_hit"), F.col(f"_new_{n}")).otherwise(F.col(n)) for n in columns})
    return out.select(*df.columns)


def audit_inserts(old: DataFrame, new: DataFrame, key: str, at, what: str = "employee") -> DataFrame:
    """One message per key that is in ``new`` only."""
    fresh = new.join(old.select(key), key, "left_anti")
    message = F.concat(F.lit(f"New {what} with Id = "), F.col(key).cast("string"),
                       F.lit(" is added at "), F.date_format(F.lit(at) if not isinstance(at, Column) else at,
                                                            "yyyy-MM-dd HH:mm:ss"))
    return fresh.select(key, message.alias("message"))


def retain(df: DataFrame, ts: str, days: int, as_of) -> DataFrame:
    """Rows newer than ``days`` days before ``as_of``."""
    return df.where(F.col(ts) > shift(as_of, "day", -days))


def trailing(df: DataFrame, ts: str, n: int, unit: str, as_of) -> DataFrame:
    return df.where(F.col(ts) >= shift(as_of, unit, -n))
