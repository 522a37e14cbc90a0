"""Index and statistics advice over catalogue snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import band, boundaries, fixed, int_div, pct, quote_name, rules, safe_div
from ..operators.joins import prefix_join
from ..operators.windows import key_totals
from ..session import materialise

OBJECT = ["schema_name", "table_name"]


# --- fragmentation and statistics ------------------------------------------

def fragmentation(stats: DataFrame, min_pct: float = 5, min_pages: int = 1000) -> DataFrame:
    label = band("frag_pct", [(30, "REBUILD"), (5, "REORGANIZE")], "OK", ">")
    return stats.where((F.col("frag_pct") > min_pct) & (F.col("page_count") > min_pages)).withColumn("recommendation", label)


def maintenance_commands(stats: DataFrame, min_pct: float = 5, min_pages: int = 1000) -> DataFrame:
    target = F.concat(F.lit("ALTER INDEX "), quote_name("index_name"), F.lit(" ON "), quote_name("schema_name"), F.lit("."), quote_name("table_name"))
    command = rules([(F.col("frag_pct") > 30, F.concat(target, F.lit(" REBUILD WITH (ONLINE = ON, SORT_IN_TEMPDB = ON, MAXDOP = 4);"))),
                     (F.col("frag_pct") > 5, F.concat(target, F.lit(" REORGANIZE;")))])
    return (fragmentation(stats, min_pct, min_pages).where("index_name is not null")
            .select(command.alias("command"), "frag_pct", "page_count"))


def update_command() -> Column:
    return F.concat(F.lit("UPDATE STATISTICS "), quote_name("schema_name"), F.lit("."), quote_name("table_name"), F.lit(" "),
                    quote_name("stats_name"), F.lit(" WITH FULLSCAN;"))


def stale_stats(stats: DataFrame, as_of, days: int = 7, changed: float = 0.20) -> DataFrame:
    """Statistics older than ``days`` or with more than a share of rows changed."""
    age = boundaries("day", "last_updated", as_of)
    old = (age > days) | (F.col("modification_counter") > F.col("row_count") * changed)
    return stats.where(old).withColumns({"modified_pct": pct("modification_counter", "row_count", 2), "days_since_update": age,
                                         "update_command": update_command()})


def volatile_stats(stats: DataFrame) -> DataFrame:
    return stats.where("modification_counter > 0")


def sample_percent(stats: DataFrame) -> DataFrame:
    return stats.where("row_count > 0").withColumn("sample_pct", int_div(F.col("rows_sampled") * 100, "row_count"))


# --- missing and unused ----------------------------------------------------

def create_index_text() -> Column:
    table = F.regexp_replace(F.regexp_replace("statement", r"[\[\]]", ""), r"\.", "_")
    equality, inequality = F.coalesce("equality_columns", F.lit("")), F.coalesce("inequality_columns", F.lit(""))
    comma = F.when(F.col("equality_columns").isNotNull() & F.col("inequality_columns").isNotNull(), ", ").otherwise("")
    include = F.coalesce(F.concat(F.lit("INCLUDE ("), "included_columns", F.lit(")")), F.lit(""))
    return F.concat(F.lit("CREATE NONCLUSTERED INDEX [IX_"), table, F.lit("_"), F.col("index_handle").cast("string"), F.lit("] ON "), "statement",
                    F.lit(" ("), equality, comma, inequality, F.lit(") "), include, F.lit(";"))


def missing_indexes(missing: DataFrame, n: int = 25) -> DataFrame:
    """Best improvement first, with the statement that creates the index."""
    measure = fixed(F.col("avg_user_impact") * (F.col("user_seeks") + F.col("user_scans")), 2)
    return (missing.withColumn("improvement_measure", measure).orderBy(F.desc("improvement_measure"), "index_handle").limit(n)
            .withColumn("create_statement", create_index_text()))


def missing_index_advantage(missing: DataFrame) -> DataFrame:
    """Advantage of each suggestion, with the number for its table and for its equality columns."""
    gain = fixed(F.col("user_seeks") * F.col("avg_total_user_cost") * (F.col("avg_user_impact") * 0.01), 2)
    rows = key_totals(missing, "statement", {"for_table": F.count(F.lit(1))})
    rows = key_totals(rows, ["statement", "equality_columns"], {"similar": F.count(F.lit(1))})
    return rows.withColumn("index_advantage", gain)


READS = "coalesce(user_seeks, 0) + coalesce(user_scans, 0) + coalesce(user_lookups, 0)"


def with_usage(indexes: DataFrame, usage: DataFrame) -> DataFrame:
    return indexes.join(usage, ["object_id", "index_id"], "left")


def unused_indexes(indexes: DataFrame, usage: DataFrame, sizes: DataFrame) -> DataFrame:
    """Indexes without reads that no key or uniqueness rule needs, with their size."""
    mb = sizes.groupBy("object_id", "index_id").agg((F.sum("used_page_count") * 8 / 1024.0).alias("index_mb"))
    kept = indexes.where("type in (1, 2) and not is_primary_key and not is_unique")
    return with_usage(kept, usage).where(f"{READS} = 0").join(mb, ["object_id", "index_id"], "left")


def write_heavy(indexes: DataFrame, usage: DataFrame, mode: str = "more_writes") -> DataFrame:
    """``more_writes``: nonclustered, non-unique indexes written more than read.
    ``rarely_read``: fewer than 100 reads and more than 1000 writes."""
    reads = F.expr("user_seeks + user_scans + user_lookups")
    rows = indexes.join(usage, ["object_id", "index_id"]).withColumn("reads", reads).withColumn("difference", F.col("user_updates") - reads)
    if mode == "rarely_read":
        return rows.where("reads < 100 and user_updates > 1000")
    return rows.where("user_updates > reads and index_id > 1 and type = 2 and not is_primary_key and not is_unique")


def index_usage(indexes: DataFrame, usage: DataFrame) -> DataFrame:
    return with_usage(indexes.where("type > 0"), usage).withColumn("reads", F.expr("user_seeks + user_scans + user_lookups"))


# --- overlapping indexes ---------------------------------------------------

def index_lists(columns: DataFrame) -> DataFrame:
    """One row per index: ordered keys, the same with direction, and included columns.

    ``columns`` has object_id, index_id, index_name, key_ordinal, column_id, column_name,
    is_descending_key and is_included_column. An index has few columns, so lists stay short.
    """
    direction = F.concat("column_name", F.lit(" "), F.when(F.col("is_descending_key"), "Desc").otherwise("Asc"))
    row = F.struct("key_ordinal", "column_id", F.col("column_name").alias("c"), direction.alias("d"), "is_included_column")
    g = columns.groupBy("object_id", "index_id", "index_name").agg(F.sort_array(F.collect_list(row)).alias("_c"))
    keys = lambda part: F.transform(F.filter("_c", lambda r: r["key_ordinal"] > 0), lambda r: r[part])
    included = F.transform(F.filter("_c", lambda r: r["is_included_column"]), lambda r: r["c"])
    return g.select("object_id", "index_id", "index_name", keys("c").alias("cols"), keys("d").alias("sorted_cols"), included.alias("included"))


def duplicate_indexes(columns: DataFrame) -> DataFrame:
    """Indexes that repeat an earlier one: same keys in the same order, same included columns.

    A clustered index (id 1) is repeated by any index with its keys. Each repeat is shown
    once, next to the first index it repeats and the number of such twins.
    """
    lists = materialise(index_lists(columns))
    twins = lists.groupBy("object_id", "sorted_cols", "included").agg(F.min("index_id").alias("_first"), F.count(F.lit(1)).alias("copies"))
    clustered = lists.where("index_id = 1").select("object_id", "sorted_cols", F.lit(1).alias("_clustered"))
    rows = (lists.join(twins, ["object_id", "sorted_cols", "included"]).join(clustered, ["object_id", "sorted_cols"], "left"))
    original = F.least(F.col("_first"), F.coalesce("_clustered", "_first"))
    return (rows.withColumn("duplicate_of", original).where("duplicate_of < index_id")
            .select("object_id", "index_id", "index_name", "sorted_cols", "included", "duplicate_of", "copies"))


def redundant_indexes(columns: DataFrame) -> DataFrame:
    """Indexes whose keys start the keys of another index of the table.

    ``covered_by`` and ``covering`` are the first and the number of indexes with longer
    keys; ``same_keys`` counts others with equal keys but another direction or other
    included columns, clustered ones aside.
    """
    lists = materialise(index_lists(columns))
    longer = prefix_join(lists, "object_id", "cols", "index_id").select("object_id", "index_id", "covered_by", "covering")
    kinds = lists.groupBy("object_id", "cols", "sorted_cols", "included").agg(
        F.count(F.lit(1)).alias("_same"), F.count_if(F.col("index_id") == 1).alias("_same_cl"))
    whole = kinds.groupBy("object_id", "cols").agg(F.sum("_same").alias("_all"), F.sum("_same_cl").alias("_all_cl"))
    other = (F.col("_all") - F.col("_all_cl")) - (F.col("_same") - F.col("_same_cl"))
    rows = (lists.join(kinds, ["object_id", "cols", "sorted_cols", "included"]).join(whole, ["object_id", "cols"])
            .withColumn("same_keys", other).join(longer, ["object_id", "index_id"], "left")
            .withColumn("covering", F.coalesce("covering", F.lit(0))))
    return rows.where("covering > 0 or same_keys > 0").select("object_id", "index_id", "index_name", "sorted_cols", "covered_by", "covering", "same_keys")


def fk_without_index(fk_columns: DataFrame, index_columns: DataFrame) -> DataFrame:
    """Foreign keys whose column list no index of the table has exactly."""
    ordered = lambda df, keys, at: df.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(at, "column_name"))), lambda r: r["column_name"]).alias("cols"))
    fks = ordered(fk_columns, OBJECT + ["constraint_name", "referenced_table"], "ordinal")
    lists = ordered(index_columns.where("key_ordinal > 0"), OBJECT + ["index_id"], "key_ordinal").select(*OBJECT, "cols").distinct()
    return fks.join(lists, OBJECT + ["cols"], "left_anti").drop("cols")


def flagged_indexes(indexes: DataFrame, flag: str, tool_objects: DataFrame | None = None) -> DataFrame:
    """Indexes with a flag set (is_disabled, is_hypothetical), objects of tools left out."""
    rows = indexes.where(F.col(flag)).distinct()
    return rows if tool_objects is None else rows.join(tool_objects.select("object_id").where("object_id is not null"), "object_id", "left_anti")


# --- contention ------------------------------------------------------------

def index_lock_waits(stats: DataFrame) -> DataFrame:
    """Lock waits summed per index, those that waited at all."""
    sums = ["row_lock_wait_count", "row_lock_wait_in_ms", "page_lock_wait_count", "page_lock_wait_in_ms"]
    g = stats.groupBy("table_name", "index_name").agg(*[F.sum(c).alias(f"total_{c}") for c in sums])
    g = g.withColumn("total_lock_wait_in_ms", F.col("total_row_lock_wait_in_ms") + F.col("total_page_lock_wait_in_ms"))
    return g.where("total_lock_wait_in_ms > 0")


def index_contention(stats: DataFrame) -> DataFrame:
    return stats.where("row_lock_wait_count > 0 or page_lock_wait_count > 0")


def rowgroup_fragmentation(groups: DataFrame) -> DataFrame:
    return groups.withColumn("fragmentation", int_div(100 * F.coalesce("deleted_rows", F.lit(0)), "total_rows"))
