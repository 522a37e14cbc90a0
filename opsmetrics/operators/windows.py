"""Ordered windows that survive one key holding a large part of the rows.

A plain window puts every row of a key into one task. The functions here cut the
order of each key into blocks: a window runs inside each (key, block), and one
small row per (key, block) carries totals or edge rows across block borders.

``block`` is a column that never decreases along the order, such as a slice of the
ordering time (:func:`time_block`). A struct of the order column and a slice of the
tie-breaker splits rows of one time too. Where no such column is at hand,
:func:`range_blocks` makes one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise

BLOCK = "_block"
#: Rows in a block that is cut by counting.
BLOCK_ROWS = 1_000_000


def as_list(x) -> list:
    return [] if x is None else list(x) if isinstance(x, (list, tuple)) else [x]


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality on ``names``."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def attach(df: DataFrame, side: DataFrame, names: list[str], how: str = "left") -> DataFrame:
    """Add the columns of ``side`` by a null-safe join on ``names``."""
    side = side.select(*[F.col(n).alias(f"_r_{n}") for n in names],
                       *[c for c in side.columns if c not in names])
    on = [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names]
    return df.join(side, reduce(lambda a, b: a & b, on), how).drop(*[f"_r_{n}" for n in names])


def range_blocks(df: DataFrame, *order, rows: int = BLOCK_ROWS, split_ties: bool = False) -> DataFrame:
    """Sort ``df`` into ranges of about ``rows`` rows and number them in ``_block``.

    The number of ranges follows from the counted rows, their borders from a sample of all of them. With ``split_ties`` rows
    of one place in the order may lie in neighbouring ranges, so that a value which most rows have does not make one large
    range; without it they stay together. The rows are written once, so later steps all see the same numbering.
    """
    blocks = -(-df.count() // rows) or 1
    tie = [F.xxhash64(F.col("_tie"))] if split_ties else []
    marked = df.withColumn("_tie", F.monotonically_increasing_id()) if split_ties else df
    ranged = marked.repartitionByRange(blocks, *order, *tie).withColumn(BLOCK, F.spark_partition_id())
    return materialise(ranged.drop("_tie"))


def time_block(ts, minutes: int = 10) -> Column:
    """Number of the time slice a timestamp falls in, as a block. Narrow slices split busy keys further."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(minutes * 60_000_000))


def _with_edges(df: DataFrame, edges: DataFrame, first: bool) -> DataFrame:
    """Add one row per (key, block) that sorts before or after all rows of its block.

    The edge rows bring what the other blocks of the key contribute, in the same shuffle.
    """
    return df.withColumn("_side", F.lit(1)).unionByName(
        edges.withColumn("_side", F.lit(0 if first else 2)), allowMissingColumns=True)


def running(df: DataFrame, keys, order, block: str, sums: dict, exclusive: bool = False) -> DataFrame:
    """Running sums per key. ``sums`` maps a new name to the column summed."""
    keys = as_list(keys)
    by = keys + [block]
    totals = df.groupBy(*by).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    edges = totals.select(*by, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_v_{n}") for n in sums])
    rows = df.select("*", *[F.col(c).cast(edges.schema[f"_v_{n}"].dataType).alias(f"_v_{n}") for n, c in sums.items()])
    inside = W.partitionBy(*by).orderBy("_side", *as_list(order)).rowsBetween(W.unboundedPreceding, -1 if exclusive else W.currentRow)
    out = _with_edges(rows, edges, first=True).select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_r_{n}") for n in sums])
    return out.where("_side = 1").select(*df.columns, *[F.col(f"_r_{n}").alias(n) for n in sums])


def numbered(df: DataFrame, keys, order, block: str, name: str = "row_num") -> DataFrame:
    """row_number per key."""
    out = running(df.withColumn("_one", F.lit(1).cast("bigint")), keys, order, block, {name: "_one"})
    return out.drop("_one")


def neighbour(df: DataFrame, keys, order, block: str, take: dict, step: str = "lag") -> DataFrame:
    """lag or lead by one row per key. ``take`` maps a new name to the column read.

    ``order`` is a list of ascending columns; its last one must be unique within a key.
    """
    keys, order = as_list(keys), as_list(order)
    by = keys + [block]
    lag = step == "lag"
    row = F.struct(*[F.col(c).alias(n) for n, c in take.items()])
    position = F.struct(*[F.col(c) for c in order])
    edge = (F.max_by if lag else F.min_by)(row, position)
    near = F.lag if lag else F.lead
    last = df.groupBy(*by).agg(edge.alias("_edge"))
    edges = last.select(*by, near("_edge").over(W.partitionBy(*keys).orderBy(block)).alias("_row"))
    inside = W.partitionBy(*by).orderBy("_side", *order)
    out = _with_edges(df.withColumn("_row", row), edges, first=lag).withColumn("_near", near("_row").over(inside))
    kept = [c for c in df.columns if c not in take]
    return out.where("_side = 1").select(*kept, *[F.col("_near")[n].alias(n) for n in take])


def ranked(df: DataFrame, keys, value: str, descending: bool = False, block: str | None = None,
           rank: str | None = "rank", dense: str | None = None) -> DataFrame:
    """rank and dense_rank per key, from counts per distinct value.

    Ties never travel: the counts are combined before the shuffle. ``block`` cuts the
    distinct values of a key; it must be a column of ``df`` that never decreases along
    the value, or never increases when ``descending``.
    """
    keys = as_list(keys)
    blocks = [block] if block else []
    counts = df.groupBy(*keys, *blocks, value).agg(F.count(F.lit(1)).alias("_n"))
    order = F.col(value).desc() if descending else F.col(value).asc()
    names = {}
    if block:
        sign = F.lit(-1 if descending else 1)
        counts = counts.withColumns({"_one": F.lit(1), "_pos": F.col(block) * sign})
        sums = {"_rank0": "_n", "_dense0": "_one"}
        counts = running(counts, keys, [order], "_pos", sums, exclusive=True)
        names = {"_rank": F.col("_rank0") + 1, "_dense": F.col("_dense0") + 1}
    else:
        w = W.partitionBy(*keys).orderBy(order)
        before = w.rowsBetween(W.unboundedPreceding, -1)
        names = {"_rank": F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1,
                 "_dense": F.row_number().over(w)}
    wanted = {new: names[old].cast("bigint") for old, new in (("_rank", rank), ("_dense", dense)) if new}
    places = counts.select(*keys, value, *[c.alias(n) for n, c in wanted.items()])
    return attach(df, places, keys + [value])


def key_totals(df: DataFrame, keys, aggs: dict) -> DataFrame:
    """Aggregates per key next to every row: group first, then join back."""
    keys = as_list(keys)
    side = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return attach(df, side, keys)


def grand_total(df: DataFrame, agg: Column) -> Column:
    """A whole-table aggregate as a scalar subquery, for use next to any row."""
    return df.agg(agg.alias("_total")).scalar()
