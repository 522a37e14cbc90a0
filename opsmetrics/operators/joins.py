"""Join shapes: lookups, ranges, containment and role joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

from .ranking import top_k_per_group
from .windows import as_list


def exists(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_semi")


def not_exists(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_anti")


def not_in(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """``NOT IN``: one null on the right empties the answer, null rows on the left go too."""
    values = other.select(F.col(other_column).alias("_v"))
    facts = values.agg(F.struct(F.count_if(F.col("_v").isNull()).alias("nulls"),
                                F.count(F.lit(1)).alias("rows")).alias("f")).scalar()
    nulls, rows = facts["nulls"], facts["rows"]
    kept = df.join(values.where("_v is not null"), F.col(column) == F.col("_v"), "left_anti")
    return kept.where((rows == 0) | ((nulls == 0) & F.col(column).isNotNull()))


def with_key_aggregate(df: DataFrame, other: DataFrame, keys, *aggs: Column) -> DataFrame:
    """A correlated aggregate per row: group the other side once, then left join."""
    keys = as_list(keys)
    return df.join(other.groupBy(*keys).agg(*aggs), keys, "left")


def parent_of(df: DataFrame, child: str, parent: str, columns: dict) -> DataFrame:
    """Self join to the parent row; ``columns`` maps new names to parent columns."""
    up = df.select(F.col(child).alias("_pid"), *[F.col(c).alias(n) for n, c in columns.items()])
    return df.join(up, F.col(parent) == F.col("_pid"), "left").drop("_pid")


def newer_than_mark(marks: DataFrame, facts: DataFrame, key: str, mark: str, sequence: str) -> DataFrame:
    """Facts past each key's mark; a key without a mark takes all its facts."""
    marks = marks.withColumnRenamed(key, "_k")
    on = (F.col("_k") == F.col(key)) & (F.col(mark).isNull() | (F.col(sequence) > F.col(mark)))
    return marks.join(facts, on, "inner").drop("_k")


def ceiling_lookup(df: DataFrame, tiers: list[tuple], names: list[str], value: str) -> DataFrame:
    """Smallest tier whose first field is at least ``value``; rows above all tiers are dropped.

    ``tiers`` is a fixed list, so the lookup is a CASE and needs no join.
    """
    ordered = sorted(tiers)
    tier = None
    for t in ordered:
        pick = F.struct(*[F.lit(v).alias(n) for v, n in zip(t, names)])
        hit = F.lit(t[0]) >= F.col(value)
        tier = F.when(hit, pick) if tier is None else tier.when(hit, pick)
    out = df.withColumn("_tier", tier).where(F.col("_tier").isNotNull())
    return out.select(*df.columns, *[F.col("_tier")[n].alias(n) for n in names])


def ceiling_join(df: DataFrame, dim: DataFrame, value: str, bound: str) -> DataFrame:
    """The same against a table of any size: next bound by a sorted merge of both sides.

    Both sides are put on one axis; each row takes the nearest bound at or after it.
    The axis is cut into ranges of like size, also where many rows have one value, and only one bound per range is carried
    to the ranges before.
    """
    from pyspark.sql import Window as W

    from .windows import BLOCK, range_blocks

    payload = F.struct(*[F.col(c) for c in dim.columns])
    bounds = dim.select(F.col(bound).cast("double").alias("_x"), F.lit(1).alias("_side"),
                        payload.alias("_dim"))
    rows = df.select(F.col(value).cast("double").alias("_x"), F.lit(0).alias("_side"),
                     F.struct(*[F.col(c) for c in df.columns]).alias("_row"))
    axis = range_blocks(rows.unionByName(bounds, allowMissingColumns=True), "_x", "_side", split_ties=True)
    first = axis.groupBy(BLOCK).agg(F.min_by("_dim", F.when(F.col("_side") == 1, F.col("_x"))).alias("_d"))
    # From the far end: Spark goes through the rest of the rows again for each row of a frame that ends at the last one.
    later = W.orderBy(F.desc(BLOCK)).rowsBetween(W.unboundedPreceding, -1)
    edges = first.select(BLOCK, F.lit(float("inf")).alias("_x"), F.lit(2).alias("_side"), F.last("_d", ignorenulls=True).over(later).alias("_dim"))
    ahead = W.partitionBy(BLOCK).orderBy(F.desc("_x"), F.desc("_side")).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = axis.unionByName(edges, allowMissingColumns=True).withColumn("_hit", F.last("_dim", ignorenulls=True).over(ahead))
    return out.where("_side = 0 and _hit is not null").select("_row.*", "_hit.*")


def last_n_per_key(df: DataFrame, facts: DataFrame, keys, order, n: int) -> DataFrame:
    """Up to ``n`` facts for every left row, rows without facts kept."""
    return df.join(top_k_per_group(facts, keys, order, n), as_list(keys), "left")


def lookup(df: DataFrame, table: DataFrame, on, keep_unmatched: bool = False) -> DataFrame:
    """A one-row lookup function as a join."""
    return df.join(table, on, "left" if keep_unmatched else "inner")


#: Characters of the grams under which texts and names meet, and of the pieces a long text is cut to first.
GRAM, PIECE = 4, 1024


def _grams(text: Column, size: int) -> Column:
    """The distinct substrings of one length; a shorter text is its own."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda at: F.substr(text, at, F.lit(size))))


def anchored_hits(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Candidates ``_row, _key`` for texts ``_row, _text`` that may contain a ``_key``: each key stands under its rarest gram.

    Texts give off grams of one length, and of the at most ``GRAM - 1`` lengths of shorter keys, whatever lengths the keys have.
    Only grams that some key has are kept.
    """
    short = [r[0] for r in keys.where(F.length("_key") < GRAM).select(F.length("_key")).distinct().collect()]
    keyed = keys.distinct().select("_key", F.explode(_grams(F.col("_key"), GRAM)).alias("_gram"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("_text"), F.lit(1)), F.lit(PIECE))
    pieces = texts.select("_row", F.explode(F.transform(starts, lambda at: F.substr("_text", at, F.lit(PIECE + GRAM - 1)))).alias("_piece"))
    expanded = pieces.select("_row", F.explode(F.concat(*[_grams(F.col("_piece"), n) for n in (GRAM, *short)])).alias("_gram"))
    there = materialise(expanded.join(keyed.select("_gram").distinct(), "_gram", "left_semi").distinct())
    spread = there.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarity = F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))
    anchors = keyed.join(spread, "_gram", "left").groupBy("_key").agg(F.min(rarity).alias("_a")).where("_a.n > 0")
    return there.join(anchors.select("_key", F.col("_a.gram").alias("_gram")), "_gram").select("_row", "_key")


def contains_join(df: DataFrame, names: DataFrame, text: str, name: str, few: int = 200,
                  ignore_case: bool = False) -> DataFrame:
    """Rows paired with every name their text contains.

    Up to ``few`` names are folded into the plan as a list. More names than that meet the texts
    under one gram each, and each candidate is compared whole. Both ways give the same rows; repeated
    input rows are kept.
    """
    fold = F.lower if ignore_case else (lambda c: c)
    known = names.where((F.col(name).isNotNull()) & (F.length(name) > 0))
    listed = [r[0] for r in known.select(name).distinct().limit(few + 1).collect()]
    if len(listed) <= few:
        hits = F.filter(F.array(*[F.lit(v) for v in listed]).cast("array<string>"),
                        lambda v: F.contains(fold(F.col(text)), fold(v)))
        found = df.withColumn("_name", F.explode(hits))
        return found.join(known, F.col("_name") == F.col(name), "inner").drop("_name")
    rows = materialise(df.withColumn("_row", F.monotonically_increasing_id()))
    keyed = known.withColumn("_key", fold(F.col(name)))
    hits = anchored_hits(rows.select("_row", fold(F.col(text)).alias("_text")), keyed.select("_key"))
    held = rows.join(hits, "_row").where(F.contains(fold(F.col(text)), F.col("_key")))
    return held.join(keyed, "_key").drop("_row", "_key")


def either_key_join(df: DataFrame, other: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Join on any of several equalities: one equality join each, a pair counted once."""
    seen: Column | None = None
    parts = []
    for left, right in pairs:
        hit = F.col(left) == F.col(right)
        fresh = hit if seen is None else hit & ~F.coalesce(seen, F.lit(False))
        parts.append(df.join(other, fresh, "inner"))
        seen = hit if seen is None else (F.coalesce(seen, F.lit(False)) | F.coalesce(hit, F.lit(False)))
    return reduce(DataFrame.unionByName, parts)


def role_join(df: DataFrame, dim: DataFrame, key: str, roles: dict[str, str], columns: list[str]) -> DataFrame:
    """Join one dimension several times; ``roles`` maps a prefix to the foreign key used."""
    for prefix, foreign in roles.items():
        side = dim.select(F.col(key).alias("_k"), *[F.col(c).alias(f"{prefix}_{c}") for c in columns])
        df = df.join(side, F.col(foreign) == F.col("_k"), "inner").drop("_k")
    return df


def first_of_equals(df: DataFrame, keys, id_col: str) -> DataFrame:
    """Members of groups with equal payload, each next to the first member of its group.

    Stands for the pairs ``id1 < id2`` with equal payload without writing out each pair.
    """
    keys = as_list(keys)
    groups = (df.groupBy(*keys).agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("copies"))
              .where("copies > 1"))
    return df.join(groups, keys, "inner")


def prefix_join(df: DataFrame, group, keys: str, id_col: str) -> DataFrame:
    """Rows whose array is a strict prefix of another array in the same group.

    Every distinct array gives off its proper prefixes, which meet the arrays by equality.
    One row per covered array: the smallest covering id and how many cover it.
    """
    group = as_list(group)
    lists = df.groupBy(*group, keys).agg(F.min(id_col).alias("_id"), F.count(F.lit(1)).alias("_n"))
    lengths = F.when(F.size(keys) > 1, F.sequence(F.lit(1), F.size(keys) - 1))
    prefixes = (lists.withColumn("_len", F.explode(lengths))
                .select(*group, F.slice(keys, 1, F.col("_len")).alias(keys), "_id", "_n"))
    cover = prefixes.groupBy(*group, keys).agg(F.min("_id").alias("covered_by"),
                                               F.sum("_n").alias("covering"))
    return df.join(cover, group + [keys], "inner")
