"""Reproducible shuffle into shards by a keyed permutation of row numbers.

Rows get a global number (their place in the order by id and content). A Feistel network
permutes the numbers 0..N-1, walking each cycle until it is back below N. The permuted number
alone gives shard and slot: ``p % shards`` and ``p div shards``. Shard counts are at most one
apart, slots have no gaps, and both can be computed, or inverted, for any row number without
looking at the others.

Everything is a DataFrame expression. Only ids, sizes and checksums are shuffled, never texts.

Defined results: long texts are read whole, and other columns, whatever their names, change nothing;
null ids are numbered first; a null text has size 8 and checksum 0; rows that
are equal in every column are interchangeable, each gets its own number; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise

ROUNDS = 8
#: Steps of a cycle walk that are planned. The domain is below 2N, so a walk is longer with a chance under 2^-128.
WALK = 128
_LOCAL = 33  # low bits of monotonically_increasing_id


def _halves(n: int) -> tuple[int, int]:
    bits = max(2, (n - 1).bit_length())
    return bits // 2, bits - bits // 2


def _network(x: Column, n: int, seed: int, backwards: bool) -> Column:
    """One pass through the network: each round changes one half by a hash of the other."""
    high, low = _halves(n)
    high_mask, low_mask = F.lit((1 << high) - 1).cast("bigint"), F.lit((1 << low) - 1).cast("bigint")
    rounds = range(ROUNDS)

    def step(s: Column, k: Column) -> Column:
        left, right = s["l"], s["r"]
        from_right = F.xxhash64(F.lit(seed).cast("bigint"), k, right).bitwiseAND(high_mask)
        from_left = F.xxhash64(F.lit(seed).cast("bigint"), k, left).bitwiseAND(low_mask)
        return F.when(k % 2 == 0, F.struct(left.bitwiseXOR(from_right).alias("l"), right.alias("r"))).otherwise(
            F.struct(left.alias("l"), right.bitwiseXOR(from_left).alias("r")))

    start = F.struct(F.shiftrightunsigned(x, low).alias("l"), x.bitwiseAND(low_mask).alias("r"))
    keys = F.array(*[F.lit(k) for k in (reversed(rounds) if backwards else rounds)])
    return F.aggregate(keys, start, step, lambda s: F.shiftleft(s["l"], low).bitwiseOR(s["r"]))


def permuted(row: Column, n: int, seed: int = 0, backwards: bool = False) -> Column:
    """The place of row number ``row`` (0 <= row < n) in the shuffle, or the row at a place if ``backwards``."""
    limit = F.lit(n).cast("bigint")
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), _network(row, n, seed, backwards),
                       lambda at, _: F.when(at < limit, at).otherwise(_network(at, n, seed, backwards)))
    return F.when(walk < limit, walk).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("bigint"))


def row_numbers(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with ``_row``, its 0-based place in the order by ``order``, and the number of rows.

    The rows are range-sorted once and written; a partition's first number is the sum of the counts before
    it. ``_tie`` parts equal rows, so that many copies of one row spread over the ranges.
    """
    tied = materialise(df.withColumn("_tie", F.monotonically_increasing_id()))
    by = [*order, "_tie"]
    placed = materialise(tied.repartitionByRange(*by).sortWithinPartitions(*by)
                         .withColumn("_at", F.monotonically_increasing_id()))
    part, local = F.shiftrightunsigned("_at", _LOCAL), F.col("_at").bitwiseAND(F.lit((1 << _LOCAL) - 1))
    counts = materialise(placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")))
    n = counts.agg(F.sum("_n")).first()[0] or 0
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rows = placed.withColumn("_part", part).join(bases, "_part").withColumn("_row", F.col("_base") + local)
    return rows.drop("_part", "_base", "_at", "_tie"), n


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, seed: int = 0) -> DataFrame:
    """One row per row of ``df``: id, size, text_crc32, shard and slot.

    ``size`` is the number of UTF-8 bytes of the text plus 8. Columns other than id and text only take part
    in the order of rows with equal id and text.
    """
    rows = df.select(F.col(id_col), (F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(8)).cast("bigint").alias("size"),
                     F.coalesce(F.crc32(text_col), F.lit(0)).cast("bigint").alias("text_crc32"),
                     F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("_content"))
    numbered, n = row_numbers(rows, [id_col, "_content", "text_crc32", "size"])
    placed = numbered.withColumn("_place", permuted(F.col("_row"), n, seed))
    return placed.select(id_col, "size", "text_crc32", (F.col("_place") % shards).cast("int").alias("shard"),
                         F.expr(f"_place div {int(shards)}").alias("slot"))
