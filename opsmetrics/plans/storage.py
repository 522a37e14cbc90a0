"""IO, space and capacity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.scalars import (band, boundaries, bytes_to, decode, fixed, int_div, like, pages_to_mb, path_drive, pct,
                                 quote_name, rules, safe_div, shift)
from ..functions.xml import RECORD_SCHEMA, parse_xml
from ..operators.joins import ceiling_lookup
from ..operators.windows import as_list, grand_total, neighbour
from ..session import materialise
from ..sources.tables import read_logs
from .counters import counter_delta

FILE = ["database_id", "file_id"]


def with_files(io: DataFrame, files: DataFrame) -> DataFrame:
    return io.join(files, FILE, "inner")


# --- latency ---------------------------------------------------------------

def file_latency(io: DataFrame, files: DataFrame, kind: str = "data", smooth: bool = False) -> DataFrame:
    """Average latency per file with a label.

    ``data`` shows read latency of data files that were read, ``log`` write latency of log
    files that were written. ``smooth`` shows all files with one added to every count.
    """
    rows = with_files(io, files)
    if smooth:
        reads, writes = F.col("num_of_reads"), F.col("num_of_writes")
        stalls = F.col("io_stall_read_ms") + F.col("io_stall_write_ms")
        return rows.select(
            *FILE, "name", "type_desc", fixed(F.col("io_stall_read_ms") / (1.0 + reads), 1).alias("avg_read_ms"),
            fixed(F.col("io_stall_write_ms") / (1.0 + writes), 1).alias("avg_write_ms"),
            fixed(stalls / (1.0 + reads + writes), 1).alias("avg_io_ms"), stalls.alias("io_stalls"), (reads + writes).alias("total_io"))
    read = safe_div("io_stall_read_ms", "num_of_reads", 0)
    write = safe_div("io_stall_write_ms", "num_of_writes", 0)
    if kind == "data":
        return rows.where("type_desc = 'ROWS' and num_of_reads > 0").select(
            *FILE, "name", "num_of_reads", fixed(read, 2).alias("avg_read_ms"), bytes_to("num_of_bytes_read").alias("read_mb"),
            band(read, V.READ_BANDS, V.READ_SLOWEST).alias("performance"))
    if kind == "log":
        return rows.where("type_desc = 'LOG' and num_of_writes > 0").select(
            *FILE, "name", "num_of_writes", fixed(write, 2).alias("avg_write_ms"), "num_of_reads", fixed(read, 2).alias("avg_read_ms"),
            bytes_to("num_of_bytes_written").alias("written_mb"), band(write, V.LOG_WRITE_BANDS, V.LOG_WRITE_SLOWEST).alias("performance"))
    raise ValueError(f"unknown kind {kind}")


def drive_latency(io: DataFrame, files: DataFrame) -> DataFrame:
    """Whole-number latencies and transfer sizes per drive and mount point."""
    measures = ["num_of_reads", "io_stall_read_ms", "num_of_writes", "io_stall_write_ms", "num_of_bytes_read", "num_of_bytes_written", "io_stall"]
    g = (with_files(io, files).groupBy(path_drive("physical_name").alias("drive"), "volume_mount_point")
         .agg(*[F.sum(m).alias(m) for m in measures]))
    both = F.col("num_of_reads") + F.col("num_of_writes")
    return g.select("drive", "volume_mount_point", int_div("io_stall_read_ms", "num_of_reads", 0).alias("read_latency"),
                    int_div("io_stall_write_ms", "num_of_writes", 0).alias("write_latency"), int_div("io_stall", both, 0).alias("overall_latency"),
                    int_div("num_of_bytes_read", "num_of_reads", 0).alias("bytes_per_read"), int_div("num_of_bytes_written", "num_of_writes", 0).alias("bytes_per_write"),
                    int_div(F.col("num_of_bytes_read") + F.col("num_of_bytes_written"), both, 0).alias("bytes_per_transfer"))


def file_profile(io: DataFrame, files: DataFrame) -> DataFrame:
    """Read and write shares of stalls, calls and bytes per file; null where there was nothing."""
    pairs = {"stall": ("io_stall_read_ms", "io_stall_write_ms"), "calls": ("num_of_reads", "num_of_writes"),
             "bytes": ("num_of_bytes_read", "num_of_bytes_written")}
    shares = []
    for name, (r, w) in pairs.items():
        whole = F.col(r) + F.col(w)
        shares += [pct(r, whole, 1).alias(f"{name}_read_pct"), pct(w, whole, 1).alias(f"{name}_write_pct")]
    return with_files(io, files).select(*FILE, "name", "type_desc", (F.col("num_of_reads") + F.col("num_of_writes")).alias("total_io"),
                                        bytes_to("num_of_bytes_read").alias("mb_read"), bytes_to("num_of_bytes_written").alias("mb_written"), *shares)


def pending_io(pending: DataFrame, handles: DataFrame, files: DataFrame) -> DataFrame:
    return with_files(pending.join(handles, "io_handle"), files).select(*FILE, "name", "physical_name", "type_desc", "io_type", "pending_ms", "io_pending")


def io_delta(first: DataFrame, last: DataFrame, files: DataFrame) -> DataFrame:
    """Latency and MB between two samples, files of both samples that saw IO."""
    measures = ["num_of_reads", "num_of_writes", "io_stall_read_ms", "io_stall_write_ms", "num_of_bytes_read", "num_of_bytes_written"]
    d = counter_delta(first, last, FILE, measures, new_keys=False)
    return with_files(d.where("num_of_reads + num_of_writes > 0"), files).select(
        *FILE, "name", "type_desc", F.col("num_of_reads").alias("delta_reads"), F.col("num_of_writes").alias("delta_writes"),
        fixed(safe_div("io_stall_read_ms", "num_of_reads", 0), 2).alias("avg_read_ms"), fixed(safe_div("io_stall_write_ms", "num_of_writes", 0), 2).alias("avg_write_ms"),
        bytes_to("num_of_bytes_read").alias("read_mb"), bytes_to("num_of_bytes_written").alias("written_mb"))


def near_limit(samples: DataFrame, files: DataFrame, block: str, tiers=V.STORAGE_TIERS, near: float = 0.9) -> DataFrame:
    """Highest rates per file against its storage tier, and how many intervals came near the limit.

    ``samples`` hold growing counts per file and sample_ms; ``block`` is a column that never
    decreases along sample_ms. Files above the largest tier are left out.
    """
    pairs = neighbour(samples, FILE, ["sample_ms"], block, {"_ms": "sample_ms", "_n": "transfer_count", "_b": "byte_count"}, step="lead")
    gap = F.col("_ms") - F.col("sample_ms")
    rates = pairs.select(*FILE, fixed((F.col("_n") - F.col("transfer_count")) * safe_div(F.lit(1000.0), gap), 2).alias("iops"),
                         fixed(safe_div(F.col("_b") - F.col("byte_count"), gap * 0.001) / 1024 / 1024, 2).alias("mbps")).where("iops is not null and mbps is not null")
    sized = files.withColumn("file_size_gb", fixed(F.col("size") * 8.0 / 1024 / 1024, 4))
    tiered = ceiling_lookup(sized, tiers, ["tier_gb", "iops_limit", "mbps_limit"], "file_size_gb")
    count = lambda c, limit: F.count_if(F.col(c) >= F.col(limit) * near)
    return (with_files(rates, tiered).groupBy(*FILE, "name", "file_size_gb", "tier_gb", "iops_limit", "mbps_limit")
            .agg(F.max("iops").alias("max_iops"), count("iops", "iops_limit").alias("iops_near_limit"),
                 F.max("mbps").alias("max_mbps"), count("mbps", "mbps_limit").alias("mbps_near_limit")))


def io_warnings(spark, paths, text: str = "taking longer than 15 seconds") -> DataFrame:
    return read_logs(spark, paths, text)


# --- space -----------------------------------------------------------------

def volume_space(volumes: DataFrame) -> DataFrame:
    """Free space per volume, each volume once however many files it holds."""
    free = safe_div(100.0 * F.col("available_bytes"), "total_bytes")
    return volumes.select("volume_mount_point", "total_bytes", "available_bytes").distinct().select(
        "volume_mount_point", bytes_to("total_bytes", "gb").alias("total_gb"), bytes_to("available_bytes", "gb").alias("free_gb"),
        fixed(free, 2).alias("free_pct"), band(free, V.LOW_SPACE_BANDS, "OK").alias("status"))


def growth_text(blank: str = " ") -> Column:
    return F.when(F.col("is_percent_growth"), F.concat(F.col("growth").cast("string"), F.lit(f"{blank}%"))).otherwise(
        F.concat(int_div(F.col("growth") * 8, 1024).cast("string"), F.lit(" MB")))


def max_size_text() -> Column:
    size = F.col("max_size")
    whole = F.format_string("%.2f MB", pages_to_mb(size))
    return rules([(size == -1, "Unlimited"), (size == 0, "No growth")], whole)


def file_sizes(files: DataFrame) -> DataFrame:
    """Size, used and free space, growth and limit per file, with advice on growth."""
    small = (int_div(F.col("growth") * 8, 1024) < 64) & (F.col("type_desc") == "ROWS")
    advice = rules([(F.col("is_percent_growth"), "*** CHANGE TO FIXED SIZE ***"), (small, "* Consider larger growth *")], "OK")
    return files.select(*FILE, "name", "type_desc", pages_to_mb("size").alias("size_mb"), pages_to_mb("used").alias("used_mb"),
                        pages_to_mb(F.col("size") - F.col("used")).alias("free_mb"), growth_text().alias("auto_growth"),
                        max_size_text().alias("max_size"), advice.alias("growth_advice"))


def growth_audit(files: DataFrame) -> DataFrame:
    """Files that grow by percent, with the command that sets a fixed size."""
    command = F.concat(F.lit("ALTER DATABASE "), quote_name("database_name"), F.lit(" MODIFY FILE (NAME = "), quote_name("name"), F.lit(", FILEGROWTH = 256MB);"))
    return files.where(F.col("is_percent_growth") & (F.col("growth") > 0)).select(
        "database_name", "name", "type_desc", pages_to_mb("size").alias("size_mb"), growth_text().alias("growth_setting"), command.alias("fix_command"))


def db_sizes(files: DataFrame, drive: str | None = None, skip: tuple = ()) -> DataFrame:
    """Data, log and total MB per database, on one drive if given."""
    if drive:
        files = files.where(like("physical_name", f"{drive}%"))
    if skip:
        files = files.where(~F.col("database_name").isin(*skip))
    part = lambda kind: F.sum(F.when(F.col("type_desc") == kind, F.col("size")).otherwise(0))
    g = files.groupBy("database_name").agg(part("ROWS").alias("d"), part("LOG").alias("l"), F.sum("size").alias("s"))
    return g.select("database_name", pages_to_mb("d").alias("data_mb"), pages_to_mb("l").alias("log_mb"), pages_to_mb("s").alias("total_mb"))


def growth_events(trace: DataFrame, names=V.GROWTH_EVENTS) -> DataFrame:
    return trace.where(F.col("event_name").isin(*names)).select(
        "event_name", "database_name", "file_name", "start_time", boundaries("millisecond", "start_time", "end_time").alias("duration_ms"),
        (F.col("pages") * 8.0 / 1024).alias("growth_mb"))


def table_storage(partitions: DataFrame, units: DataFrame, skip: str = "dt%") -> DataFrame:
    """Rows and KB per table; units are summed per partition before the join."""
    u = units.groupBy("partition_id").agg(F.sum("total_pages").alias("t"), F.sum("used_pages").alias("u"), F.count(F.lit(1)).alias("n"))
    g = (partitions.where(~like("table_name", skip)).join(u, "partition_id").groupBy("table_name")
         .agg(F.sum(F.col("row_count") * F.col("n")).alias("row_count"), F.sum("t").alias("t"), F.sum("u").alias("u")))
    return g.select("table_name", "row_count", (F.col("t") * 8).alias("total_kb"), (F.col("u") * 8).alias("used_kb"), ((F.col("t") - F.col("u")) * 8).alias("unused_kb"))


def table_compression(partitions: DataFrame) -> DataFrame:
    """Size and rows of heaps and clustered indexes, by compression."""
    return (partitions.where("index_id in (0, 1)").groupBy("table_name", "data_compression_desc")
            .agg(pages_to_mb(F.sum("reserved_pages")).alias("size_mb"), F.sum("row_count").alias("row_count")))


def allocation(units: DataFrame, files: DataFrame, partitions: DataFrame) -> DataFrame:
    return (units.where("type in (1, 3)").join(files, "data_space_id").join(partitions, "partition_id")
            .select("table_name", "type_desc", "file_id", "total_pages", "used_pages", "partition_id", "row_count"))


def log_space(logs: DataFrame) -> DataFrame:
    return logs.select("database_name", bytes_to("total_bytes").alias("total_mb"), bytes_to("used_bytes").alias("used_mb"),
                       fixed("used_pct", 2).alias("used_pct"), band("used_pct", [(80, "*** HIGH USAGE ***"), (60, "* Warning *")], "OK", ">").alias("status"))


def log_reuse(databases: DataFrame) -> DataFrame:
    """Online databases with the place of their reuse reason; sort by it."""
    return databases.where("state_desc = 'ONLINE'").select(
        "name", "recovery_model_desc", "log_reuse_wait_desc", decode("log_reuse_wait_desc", V.LOG_REUSE_ORDER, 10).alias("reuse_order"))


def log_segments(segments: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return segments.groupBy("database_name").agg(n.alias("segments")).withColumn(
        "status", band("segments", [(1000, "*** TOO HIGH ***"), (500, "* Warning *")], "OK", ">"))


# --- memory ----------------------------------------------------------------

def buffer_by_db(pages: DataFrame, resource_db: int = 32767) -> DataFrame:
    name = F.when(F.col("database_id") == resource_db, "Resource DB").otherwise(F.col("database_name"))
    g = materialise(pages.groupBy("database_id", name.alias("database_name")).agg(F.count(F.lit(1)).alias("pages")))
    return g.select("database_id", "database_name", "pages", pages_to_mb("pages").alias("buffer_mb"), pct("pages", grand_total(g, F.sum("pages")), 2).alias("buffer_pct"))


def dirty_pages(pages: DataFrame) -> DataFrame:
    dirty, clean = F.count_if(F.col("is_modified")), F.count_if(~F.col("is_modified"))
    g = pages.groupBy("database_id").agg(dirty.alias("dirty_pages"), clean.alias("clean_pages"), F.count(F.lit(1)).alias("total_pages"))
    return g.where("dirty_pages > 0").withColumn("dirty_pct", pct("dirty_pages", "total_pages", 2))


def buffer_by_object(pages: DataFrame, units: DataFrame, partitions: DataFrame, objects: DataFrame, n: int = 50) -> DataFrame:
    """Objects that hold most pages, and how full their pages are.

    Pages are counted per allocation unit before any join.
    """
    per_unit = pages.groupBy("unit_id").agg(F.count(F.lit(1)).alias("p"), F.sum("free_bytes").alias("f"))
    g = (per_unit.join(units.where("type in (1, 3)"), "unit_id").join(partitions, "hobt_id").join(objects, "object_id")
         .groupBy("object_name", "index_name").agg(F.sum("p").alias("pages"), F.sum("f").alias("free_bytes")))
    used = 100.0 - safe_div(100.0 * F.col("free_bytes"), F.col("pages") * 8192.0)
    return (g.orderBy(F.desc("pages"), "object_name", "index_name").limit(n)
            .select("object_name", "index_name", "pages", pages_to_mb("pages").alias("buffer_mb"), "free_bytes", fixed(used, 2).alias("density_pct")))


def memory_clerks(clerks: DataFrame, n: int = 20) -> DataFrame:
    mb = lambda c: fixed(F.col(c) / 1024.0, 2)
    return (clerks.orderBy(F.desc("pages_kb"), "type", "name").limit(n)
            .select("type", "name", mb("pages_kb").alias("allocated_mb"), mb("reserved_kb").alias("reserved_mb"), mb("committed_kb").alias("committed_mb")))


def page_life(counters: DataFrame, per_node: bool = False) -> DataFrame:
    """Page life with its band, of the whole server or of each memory node."""
    owner = "%Buffer Node%" if per_node else "%Buffer Manager%"
    rows = counters.where(like("object_name", owner, ignore_case=True) & (F.lower("counter_name") == "page life expectancy"))
    return rows.select("object_name", "instance_name", F.col("cntr_value").alias("seconds"), fixed(F.col("cntr_value") / 60.0, 1).alias("minutes"),
                       band("cntr_value", V.PAGE_LIFE_BANDS, "OK").alias("status"))


def memory_counters(counters: DataFrame) -> DataFrame:
    """The counters that tell of memory pressure."""
    wanted = [like("object_name", f"%{owner}%", ignore_case=True) & F.lower("counter_name").isin([n.lower() for n in names])
              for owner, names in V.MEMORY_COUNTERS.items()]
    return counters.where(reduce(Column.__or__, wanted)).select("object_name", "counter_name", "instance_name", "cntr_value")


def memory_events(records: DataFrame, now_ticks, now) -> DataFrame:
    """Memory notifications from ring buffer records, on whole seconds."""
    behind = int_div(F.lit(now_ticks) - F.col("timestamp") if not isinstance(now_ticks, Column) else now_ticks - F.col("timestamp"), 1000)
    r = records.withColumn("_r", parse_xml("record", RECORD_SCHEMA))
    return r.select(shift(now, "second", -behind).alias("event_time"), F.col("_r.ResourceMonitor.Notification").alias("notification"),
                    F.col("_r.ResourceMonitor.IndicatorsProcess").alias("indicators_process"), F.col("_r.ResourceMonitor.IndicatorsSystem").alias("indicators_system"),
                    F.col("_r.MemoryRecord.AvailablePhysicalMemory").alias("physical_kb"), F.col("_r.MemoryRecord.AvailableVirtualAddressSpace").alias("virtual_kb"))
