"""Group K.4: IO, space and capacity."""

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.scalars import instant_micros, int_div
from ..operators.windows import running, time_block
from ..plans import storage as P
from .fixtures import EVENTS_SPLIT, events_as_of, fx
from .registry import query
from .scans import scratch


def cents(c):
    return F.round(F.col(c) * 100).cast("bigint")


def file_io(t, lines=None):
    """IO counters per file: a part is a file, its lines are its reads and writes."""
    lines = t.lineitem if lines is None else lines
    read = F.col("l_returnflag") != "N"
    part = lambda cond, c: F.sum(F.when(cond, c).otherwise(0)).cast("bigint")
    g = lines.groupBy(F.col("l_partkey").alias("file_id")).agg(
        part(read, F.lit(1)).alias("num_of_reads"), part(~read, F.lit(1)).alias("num_of_writes"), part(read, F.col("l_quantity")).alias("io_stall_read_ms"),
        part(~read, F.col("l_linenumber")).alias("io_stall_write_ms"), part(read, cents("l_extendedprice")).alias("num_of_bytes_read"), part(~read, cents("l_extendedprice")).alias("num_of_bytes_written"))
    return g.withColumn("database_id", F.lit(1)).withColumn("io_stall", F.col("io_stall_read_ms") + F.col("io_stall_write_ms"))


def files(t):
    """Parts as files."""
    return t.part.select(F.lit(1).alias("database_id"), F.col("p_partkey").alias("file_id"), F.col("p_name").alias("name"), F.when(F.col("p_type") == "ECONOMY", "LOG").otherwise("ROWS").alias("type_desc"),
                         F.concat(F.right("p_brand", F.lit(2)), F.lit("/"), F.col("p_name")).alias("physical_name"), F.col("p_brand").alias("volume_mount_point"), F.col("p_brand").alias("database_name"),
                         (F.col("p_size") * 1000000).cast("bigint").alias("size"), (F.col("p_size") * 400000).cast("bigint").alias("used"), (F.col("p_size") * 300).cast("bigint").alias("growth"),
                         (F.col("p_size") > 30).alias("is_percent_growth"), (F.col("p_size") % 5 - 1).cast("bigint").alias("max_size"))


IO_SQL = """SELECT l_partkey AS file_id, CAST(count(*) FILTER (l_returnflag <> 'N') AS BIGINT) AS num_of_reads, CAST(count(*) FILTER (l_returnflag = 'N') AS BIGINT) AS num_of_writes,
  CAST(coalesce(sum(l_quantity) FILTER (l_returnflag <> 'N'), 0) AS BIGINT) AS io_stall_read_ms, CAST(coalesce(sum(l_linenumber) FILTER (l_returnflag = 'N'), 0) AS BIGINT) AS io_stall_write_ms,
  CAST(coalesce(sum(CAST(l_extendedprice * 100 AS BIGINT)) FILTER (l_returnflag <> 'N'), 0) AS BIGINT) AS num_of_bytes_read, CAST(coalesce(sum(CAST(l_extendedprice * 100 AS BIGINT)) FILTER (l_returnflag = 'N'), 0) AS BIGINT) AS num_of_bytes_written
  FROM lineitem {where} GROUP BY 1"""
FILES = """SELECT p_partkey AS file_id, p_name AS name, CASE WHEN p_type = 'ECONOMY' THEN 'LOG' ELSE 'ROWS' END AS type_desc, right(p_brand, 2) || '/' || p_name AS physical_name, p_brand AS brand,
  CAST(p_size * 1000000 AS BIGINT) AS size, CAST(p_size * 400000 AS BIGINT) AS used, CAST(p_size * 300 AS BIGINT) AS growth, p_size > 30 AS is_percent_growth, CAST(p_size % 5 - 1 AS BIGINT) AS max_size FROM part"""
IO = f"(({IO_SQL.format(where='')}) JOIN ({FILES}) USING (file_id))"


def band_sql(expr, steps, last, op="<"):
    return "CASE " + " ".join(f"WHEN {expr} {op} {c} THEN '{l}'" for c, l in steps) + f" ELSE '{last}' END"


RD, WR = "CAST(io_stall_read_ms AS DOUBLE) / num_of_reads", "CAST(io_stall_write_ms AS DOUBLE) / num_of_writes"


@query("k50_data_latency", f"""
SELECT file_id, name, num_of_reads, {fx(RD, 2)} AS avg_read_ms, {fx('num_of_bytes_read / 1048576.0', 2)} AS read_mb, {band_sql(RD, V.READ_BANDS, V.READ_SLOWEST)} AS performance
FROM {IO} WHERE type_desc = 'ROWS' AND num_of_reads > 0""")
def _(t):
    return P.file_latency(file_io(t), files(t), "data").drop("database_id")


@query("k50_log_latency", f"""
SELECT file_id, name, num_of_writes, {fx(WR, 2)} AS avg_write_ms, num_of_reads, CASE WHEN num_of_reads = 0 THEN 0 ELSE {fx(RD, 2)} END AS avg_read_ms, {fx('num_of_bytes_written / 1048576.0', 2)} AS written_mb,
  {band_sql(WR, V.LOG_WRITE_BANDS, V.LOG_WRITE_SLOWEST)} AS performance FROM {IO} WHERE type_desc = 'LOG' AND num_of_writes > 0""")
def _(t):
    return P.file_latency(file_io(t), files(t), "log").drop("database_id")


@query("k50_smooth_latency", f"""
SELECT file_id, name, type_desc, {fx('io_stall_read_ms / CAST(1 + num_of_reads AS DOUBLE)', 1)} AS avg_read_ms, {fx('io_stall_write_ms / CAST(1 + num_of_writes AS DOUBLE)', 1)} AS avg_write_ms,
  {fx('(io_stall_read_ms + io_stall_write_ms) / CAST(1 + num_of_reads + num_of_writes AS DOUBLE)', 1)} AS avg_io_ms, io_stall_read_ms + io_stall_write_ms AS io_stalls, num_of_reads + num_of_writes AS total_io FROM {IO}""")
def _(t):
    return P.file_latency(file_io(t), files(t), smooth=True).drop("database_id")


@query("k51_drive_latency", f"""
SELECT drive, brand AS volume_mount_point, CASE WHEN r = 0 THEN 0 ELSE sr // r END AS read_latency, CASE WHEN w = 0 THEN 0 ELSE sw // w END AS write_latency, (sr + sw) // (r + w) AS overall_latency,
  CASE WHEN r = 0 THEN 0 ELSE br // r END AS bytes_per_read, CASE WHEN w = 0 THEN 0 ELSE bw // w END AS bytes_per_write, (br + bw) // (r + w) AS bytes_per_transfer
FROM (SELECT left(upper(physical_name), 2) AS drive, brand, CAST(sum(num_of_reads) AS BIGINT) AS r, CAST(sum(num_of_writes) AS BIGINT) AS w, CAST(sum(io_stall_read_ms) AS BIGINT) AS sr, CAST(sum(io_stall_write_ms) AS BIGINT) AS sw,
  CAST(sum(num_of_bytes_read) AS BIGINT) AS br, CAST(sum(num_of_bytes_written) AS BIGINT) AS bw FROM {IO} GROUP BY 1, 2)""")
def _(t):
    return P.drive_latency(file_io(t), files(t))


def share(a, b):
    return f"CASE WHEN {a} + {b} <> 0 THEN {fx(f'100.0 * {a} / CAST({a} + {b} AS DOUBLE)', 1)} END"


@query("k52_file_profile", f"""
SELECT file_id, name, type_desc, num_of_reads + num_of_writes AS total_io, {fx('num_of_bytes_read / 1048576.0', 2)} AS mb_read, {fx('num_of_bytes_written / 1048576.0', 2)} AS mb_written,
  {share('io_stall_read_ms', 'io_stall_write_ms')} AS stall_read_pct, {share('io_stall_write_ms', 'io_stall_read_ms')} AS stall_write_pct, {share('num_of_reads', 'num_of_writes')} AS calls_read_pct,
  {share('num_of_writes', 'num_of_reads')} AS calls_write_pct, {share('num_of_bytes_read', 'num_of_bytes_written')} AS bytes_read_pct, {share('num_of_bytes_written', 'num_of_bytes_read')} AS bytes_write_pct FROM {IO}""")
def _(t):
    return P.file_profile(file_io(t), files(t)).drop("database_id")


@query("k53_pending_io", """
SELECT l_partkey AS file_id, p_name AS name, l_returnflag AS io_type, l_orderkey AS pending_ms FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= TIMESTAMP '2001-01-01'""")
def _(t):
    pending = (t.lineitem.where(F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))
               .select(F.col("l_partkey").alias("io_handle"), F.col("l_returnflag").alias("io_type"), F.col("l_orderkey").alias("pending_ms"), F.lit(1).alias("io_pending")))
    handles = t.part.select(F.col("p_partkey").alias("io_handle"), F.lit(1).alias("database_id"), F.col("p_partkey").alias("file_id"))
    return P.pending_io(pending, handles, files(t)).select("file_id", "name", "io_type", "pending_ms")


@query("k54_io_delta", f"""
WITH a AS ({IO_SQL.format(where="WHERE l_shipdate < TIMESTAMP '1998-07-01'")}), b AS ({IO_SQL.format(where='')}),
d AS (SELECT file_id, b.num_of_reads - a.num_of_reads AS r, b.num_of_writes - a.num_of_writes AS w, b.io_stall_read_ms - a.io_stall_read_ms AS sr, b.io_stall_write_ms - a.io_stall_write_ms AS sw,
  b.num_of_bytes_read - a.num_of_bytes_read AS br, b.num_of_bytes_written - a.num_of_bytes_written AS bw FROM a JOIN b USING (file_id))
SELECT file_id, name, type_desc, r AS delta_reads, w AS delta_writes, CASE WHEN r = 0 THEN 0 ELSE {fx('CAST(sr AS DOUBLE) / r', 2)} END AS avg_read_ms, CASE WHEN w = 0 THEN 0 ELSE {fx('CAST(sw AS DOUBLE) / w', 2)} END AS avg_write_ms,
  {fx('br / 1048576.0', 2)} AS read_mb, {fx('bw / 1048576.0', 2)} AS written_mb FROM d JOIN ({FILES}) USING (file_id) WHERE r + w > 0""")
def _(t):
    early = t.lineitem.where(F.col("l_shipdate") < F.lit("1998-07-01").cast("timestamp_ntz"))
    return P.io_delta(file_io(t, early), file_io(t), files(t)).drop("database_id")


TIERS = V.STORAGE_TIERS
TIER_SQL = ", ".join(f"({a}, {b}, {c})" for a, b, c in TIERS)


@query("k55_near_limit", f"""
WITH s AS (SELECT user_id AS file_id, epoch_ms(ts) AS ms, count(*) AS n, CAST(sum(CAST(value * 100 AS BIGINT) * 100000) AS BIGINT) AS b FROM events GROUP BY 1, 2),
r AS (SELECT file_id, ms, lead(ms) OVER w - ms AS gap, lead(n) OVER w AS nn, lead(b) OVER w AS nb FROM s WINDOW w AS (PARTITION BY file_id ORDER BY ms)),
i AS (SELECT file_id, {fx('nn * (1000.0 / CAST(gap AS DOUBLE))', 2)} AS iops, {fx('CAST(nb AS DOUBLE) / (CAST(gap AS DOUBLE) * 0.001) / 1024 / 1024', 2)} AS mbps FROM r WHERE gap IS NOT NULL AND gap <> 0),
f AS (SELECT DISTINCT user_id AS file_id, {fx('user_id * 1000000 * 8.0 / 1024 / 1024', 4)} AS gb FROM events)
SELECT file_id, gb AS file_size_gb, tier AS tier_gb, lim AS iops_limit, mlim AS mbps_limit, max(iops) AS max_iops, CAST(count(*) FILTER (iops >= lim * CAST(0.9 AS DOUBLE)) AS BIGINT) AS iops_near_limit,
  max(mbps) AS max_mbps, CAST(count(*) FILTER (mbps >= mlim * CAST(0.9 AS DOUBLE)) AS BIGINT) AS mbps_near_limit
FROM i JOIN f USING (file_id), LATERAL (SELECT * FROM (VALUES {TIER_SQL}) v(tier, lim, mlim) WHERE tier >= gb ORDER BY tier LIMIT 1) GROUP BY ALL""")
def _(t):
    day = time_block("ts").alias("slice")
    ms = int_div(instant_micros("ts"), 1000).alias("sample_ms")
    ev = (t.events.groupBy(F.lit(1).alias("database_id"), F.col("user_id").alias("file_id"), ms, day)
          .agg(F.count(F.lit(1)).alias("one"), F.sum(cents("value") * 100000).alias("b")))
    samples = running(ev, ["database_id", "file_id"], ["sample_ms"], "slice", {"transfer_count": "one", "byte_count": "b"})
    fs = t.events.select(F.lit(1).alias("database_id"), F.col("user_id").alias("file_id"), (F.col("user_id") * 1000000).alias("size")).distinct().withColumn("name", F.lit("f"))
    return P.near_limit(samples, fs, "slice").drop("database_id", "name")


@query("k56_io_warnings", """
SELECT line AS value FROM (SELECT unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line FROM documents) WHERE contains(lower(line), 'license')""")
def _(t):
    path = scratch(t, "warnings")
    t.documents.select(F.replace("text", F.lit("\r"), F.lit("")).alias("value")).write.text(path)
    return P.io_warnings(t.spark, path, "license").select("value")


@query("k57_volume_space", f"""
SELECT volume_mount_point, {fx('tb / 1073741824.0', 2)} AS total_gb, {fx('ab / 1073741824.0', 2)} AS free_gb, {fx('100.0 * ab / CAST(tb AS DOUBLE)', 2)} AS free_pct, {band_sql('100.0 * ab / CAST(tb AS DOUBLE)', V.LOW_SPACE_BANDS, 'OK')} AS status
FROM (SELECT DISTINCT c_name AS volume_mount_point, CAST(10000 AS BIGINT) * 100000000 AS tb, CAST(floor(abs(c_acctbal)) AS BIGINT) * 100000000 AS ab FROM customer)""")
def _(t):
    volumes = t.customer.select(F.col("c_name").alias("volume_mount_point"), F.lit(10000 * 100000000).alias("total_bytes"), (F.floor(F.abs("c_acctbal")) * 100000000).alias("available_bytes"))
    return P.volume_space(volumes)


MB = lambda c: fx(f"{c} * 8.0 / 1024", 2)


@query("k58_file_sizes", f"""
SELECT file_id, name, type_desc, {MB('size')} AS size_mb, {MB('used')} AS used_mb, {MB('(size - used)')} AS free_mb, CASE WHEN is_percent_growth THEN growth || ' %' ELSE growth * 8 // 1024 || ' MB' END AS auto_growth,
  CASE WHEN max_size = -1 THEN 'Unlimited' WHEN max_size = 0 THEN 'No growth' ELSE printf('%.2f MB', {MB('max_size')}) END AS max_size,
  CASE WHEN is_percent_growth THEN '*** CHANGE TO FIXED SIZE ***' WHEN growth * 8 // 1024 < 64 AND type_desc = 'ROWS' THEN '* Consider larger growth *' ELSE 'OK' END AS growth_advice FROM ({FILES})""")
def _(t):
    return P.file_sizes(files(t)).drop("database_id")


@query("k58_growth_audit", f"""
SELECT brand AS database_name, name, type_desc, {MB('size')} AS size_mb, growth || ' %' AS growth_setting, 'ALTER DATABASE [' || brand || '] MODIFY FILE (NAME = [' || name || '], FILEGROWTH = 256MB);' AS fix_command
FROM ({FILES}) WHERE is_percent_growth AND growth > 0""")
def _(t):
    return P.growth_audit(files(t))


@query("k59_db_sizes", f"""
SELECT brand AS database_name, {MB("CAST(coalesce(sum(size) FILTER (type_desc = 'ROWS'), 0) AS BIGINT)")} AS data_mb, {MB("CAST(coalesce(sum(size) FILTER (type_desc = 'LOG'), 0) AS BIGINT)")} AS log_mb, {MB('CAST(sum(size) AS BIGINT)')} AS total_mb
FROM ({FILES}) WHERE physical_name LIKE '1%' AND brand <> 'Brand#11' GROUP BY 1""")
def _(t):
    return P.db_sizes(files(t), drive="1", skip=("Brand#11",))


@query("k60_growth_events", """
SELECT event_type AS event_name, CAST(user_id AS VARCHAR) AS database_name, event_id AS file_name, ts AS start_time, CAST(floor(value) AS BIGINT) * 1000 AS duration_ms, user_id * 8.0 / 1024 AS growth_mb FROM events WHERE event_type IN ('click', 'error')""")
def _(t):
    from ..functions.scalars import shift

    trace = t.events.select(F.col("event_type").alias("event_name"), F.col("user_id").cast("string").alias("database_name"), F.col("event_id").alias("file_name"), F.col("ts").alias("start_time"),
                            shift("ts", "second", F.floor("value")).alias("end_time"), F.col("user_id").alias("pages"))
    return P.growth_events(trace, ["click", "error"])


@query("k61_table_storage", """
SELECT p_brand AS table_name, CAST(sum(p_size * n) AS BIGINT) AS row_count, CAST(sum(t) * 8 AS BIGINT) AS total_kb, CAST(sum(u) * 8 AS BIGINT) AS used_kb, CAST((sum(t) - sum(u)) * 8 AS BIGINT) AS unused_kb
FROM part JOIN (SELECT l_partkey, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS t, sum(l_linenumber) AS u FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE p_brand NOT LIKE '%7' GROUP BY 1""")
def _(t):
    partitions = t.part.select(F.col("p_partkey").alias("partition_id"), F.col("p_brand").alias("table_name"), F.col("p_size").cast("bigint").alias("row_count"))
    units = t.lineitem.select(F.col("l_partkey").alias("partition_id"), F.col("l_quantity").cast("bigint").alias("total_pages"), F.col("l_linenumber").alias("used_pages"))
    return P.table_storage(partitions, units, skip="%7")


@query("k61_table_compression", f"""
SELECT p_brand AS table_name, p_type AS data_compression_desc, {fx('CAST(sum(p_size) AS BIGINT) * 8.0 / 1024', 2)} AS size_mb, CAST(sum(p_size) AS BIGINT) AS row_count FROM part WHERE p_size <= 40 GROUP BY 1, 2""")
def _(t):
    rows = t.part.select(F.col("p_brand").alias("table_name"), F.col("p_type").alias("data_compression_desc"), F.when(F.col("p_size") > 40, 2).otherwise(1).alias("index_id"), F.col("p_size").cast("bigint").alias("reserved_pages"), F.col("p_size").cast("bigint").alias("row_count"))
    return P.table_compression(rows)


@query("k61_allocation", """
SELECT p_brand AS table_name, l_returnflag AS type_desc, l_suppkey AS file_id, CAST(l_quantity AS BIGINT) AS total_pages, l_partkey AS partition_id, p_size AS row_count
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE l_linenumber IN (1, 3)""")
def _(t):
    units = t.lineitem.select(F.col("l_linenumber").alias("type"), F.col("l_returnflag").alias("type_desc"), F.col("l_suppkey").alias("data_space_id"), F.col("l_partkey").alias("partition_id"), F.col("l_quantity").cast("bigint").alias("total_pages"), F.lit(0).alias("used_pages"))
    fs = t.supplier.select(F.col("s_suppkey").alias("data_space_id"), F.col("s_suppkey").alias("file_id"))
    partitions = t.part.select(F.col("p_partkey").alias("partition_id"), F.col("p_brand").alias("table_name"), F.col("p_size").alias("row_count"))
    return P.allocation(units, fs, partitions).drop("used_pages")


@query("k62_log_space", f"""
SELECT c_name AS database_name, {fx('10000.0 * 1048576 / 1048576.0', 2)} AS total_mb, {fx('floor(abs(c_acctbal)) * 1048576 / 1048576.0', 2)} AS used_mb, {fx('floor(abs(c_acctbal)) / 100.0', 2)} AS used_pct,
  CASE WHEN floor(abs(c_acctbal)) / 100.0 > 80 THEN '*** HIGH USAGE ***' WHEN floor(abs(c_acctbal)) / 100.0 > 60 THEN '* Warning *' ELSE 'OK' END AS status FROM customer""")
def _(t):
    used = F.floor(F.abs("c_acctbal"))
    return P.log_space(t.customer.select(F.col("c_name").alias("database_name"), F.lit(10000 * 1048576).alias("total_bytes"), (used * 1048576).alias("used_bytes"), (used / 100.0).alias("used_pct")))


@query("k62_log_reuse", """
SELECT c_custkey AS name, c_mktsegment AS recovery_model_desc, r AS log_reuse_wait_desc, CASE r WHEN 'NOTHING' THEN 99 WHEN 'LOG_BACKUP' THEN 1 ELSE 10 END AS reuse_order
FROM (SELECT *, CASE WHEN c_mktsegment = 'BUILDING' THEN 'NOTHING' WHEN c_mktsegment = 'MACHINERY' THEN 'LOG_BACKUP' ELSE c_mktsegment END AS r FROM customer WHERE c_acctbal >= 0)""")
def _(t):
    reason = F.when(F.col("c_mktsegment") == "BUILDING", "NOTHING").when(F.col("c_mktsegment") == "MACHINERY", "LOG_BACKUP").otherwise(F.col("c_mktsegment"))
    return P.log_reuse(t.customer.select(F.col("c_custkey").alias("name"), F.col("c_mktsegment").alias("recovery_model_desc"), reason.alias("log_reuse_wait_desc"),
                                         F.when(F.col("c_acctbal") >= 0, "ONLINE").otherwise("OFFLINE").alias("state_desc")))


@query("k62_log_segments", """
SELECT l_suppkey AS database_name, CAST(count(*) AS BIGINT) AS segments, CASE WHEN count(*) > 1000 THEN '*** TOO HIGH ***' WHEN count(*) > 500 THEN '* Warning *' ELSE 'OK' END AS status FROM lineitem GROUP BY 1""")
def _(t):
    return P.log_segments(t.lineitem.select(F.col("l_suppkey").alias("database_name")))


def buffer_pages(t):
    """Lines as pages in memory."""
    return t.lineitem.select(F.col("l_suppkey").alias("database_id"), F.col("l_suppkey").cast("string").alias("database_name"), (F.col("l_linestatus") == "F").alias("is_modified"),
                             F.col("l_partkey").alias("unit_id"), F.col("l_quantity").cast("bigint").alias("free_bytes"))


@query("k63_buffer_by_db", f"""
SELECT l_suppkey AS database_id, CASE WHEN l_suppkey = 7 THEN 'Resource DB' ELSE CAST(l_suppkey AS VARCHAR) END AS database_name, CAST(count(*) AS BIGINT) AS pages, {fx('count(*) * 8.0 / 1024', 2)} AS buffer_mb,
  {fx('100.0 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)', 2)} AS buffer_pct FROM lineitem GROUP BY 1""")
def _(t):
    return P.buffer_by_db(buffer_pages(t), resource_db=7)


@query("k63_dirty_pages", f"""
SELECT l_suppkey AS database_id, CAST(count(*) FILTER (l_linestatus = 'F') AS BIGINT) AS dirty_pages, CAST(count(*) FILTER (l_linestatus <> 'F') AS BIGINT) AS clean_pages, CAST(count(*) AS BIGINT) AS total_pages,
  {fx("100.0 * count(*) FILTER (l_linestatus = 'F') / CAST(count(*) AS DOUBLE)", 2)} AS dirty_pct FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linestatus = 'F') > 0""")
def _(t):
    return P.dirty_pages(buffer_pages(t))


@query("k63_buffer_by_object", f"""
SELECT p_brand AS object_name, p_type AS index_name, CAST(count(*) AS BIGINT) AS pages, {fx('count(*) * 8.0 / 1024', 2)} AS buffer_mb, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS free_bytes,
  {fx('100.0 - 100.0 * CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / (count(*) * 8192.0)', 2)} AS density_pct FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 40 GROUP BY 1, 2
ORDER BY pages DESC, object_name, index_name LIMIT 50""")
def _(t):
    units = t.part.select(F.col("p_partkey").alias("unit_id"), F.col("p_partkey").alias("hobt_id"), F.when(F.col("p_size") > 40, 2).otherwise(1).alias("type"))
    partitions = t.part.select(F.col("p_partkey").alias("hobt_id"), F.col("p_partkey").alias("object_id"))
    objects = t.part.select(F.col("p_partkey").alias("object_id"), F.col("p_brand").alias("object_name"), F.col("p_type").alias("index_name"))
    return P.buffer_by_object(buffer_pages(t), units, partitions, objects)


@query("k64_memory_clerks", f"""
SELECT p_type AS type, CAST(p_partkey AS VARCHAR) AS name, {fx('CAST(p_retailprice * 100 AS BIGINT) / 1024.0', 2)} AS allocated_mb, {fx('p_size / 1024.0', 2)} AS reserved_mb, {fx('p_size / 1024.0', 2)} AS committed_mb
FROM part ORDER BY p_retailprice DESC, p_type, name LIMIT 20""")
def _(t):
    return P.memory_clerks(t.part.select(F.col("p_type").alias("type"), F.col("p_partkey").cast("string").alias("name"), cents("p_retailprice").alias("pages_kb"), F.col("p_size").alias("reserved_kb"), F.col("p_size").alias("committed_kb")))


@query("k64_page_life", f"""
SELECT 'Stats:Buffer Manager' AS object_name, CAST(user_id AS VARCHAR) AS instance_name, CAST(floor(value * 5) AS BIGINT) AS seconds, {fx('floor(value * 5) / 60.0', 1)} AS minutes,
  CASE WHEN floor(value * 5) < 300 THEN '*** CRITICAL ***' WHEN floor(value * 5) < 1000 THEN '* Warning *' ELSE 'OK' END AS status FROM events WHERE event_type = 'view'""")
def _(t):
    rows = t.events.select(F.lit("Stats:Buffer Manager").alias("object_name"), F.col("user_id").cast("string").alias("instance_name"), F.floor(F.col("value") * 5).alias("cntr_value"),
                           F.when(F.col("event_type") == "view", "Page life expectancy").otherwise(F.col("event_type")).alias("counter_name"))
    return P.page_life(rows)


def memory_counters(t):
    """Events as counters of the buffer manager, its nodes and the memory manager."""
    owner = F.when(F.col("event_id") % 3 == 0, "Stats:Buffer Node").when(F.col("event_id") % 3 == 1, "Stats:Buffer Manager").otherwise("STATS:MEMORY MANAGER")
    name = (F.when(F.col("event_type") == "view", "Page life expectancy").when(F.col("event_type") == "click", "Free list stalls/sec")
            .when(F.col("event_type") == "error", "Memory Grants Pending").otherwise("Lazy writes/sec"))
    return t.events.select(owner.alias("object_name"), name.alias("counter_name"), F.col("event_id").cast("string").alias("instance_name"), F.floor(F.col("value") * 5).alias("cntr_value"))


@query("k64_page_life_nodes", f"""
SELECT 'Stats:Buffer Node' AS object_name, CAST(event_id AS VARCHAR) AS instance_name, CAST(floor(value * 5) AS BIGINT) AS seconds, {fx('floor(value * 5) / 60.0', 1)} AS minutes,
  CASE WHEN floor(value * 5) < 300 THEN '*** CRITICAL ***' WHEN floor(value * 5) < 1000 THEN '* Warning *' ELSE 'OK' END AS status FROM events WHERE event_type = 'view' AND event_id % 3 = 0""")
def _(t):
    return P.page_life(memory_counters(t), per_node=True)


@query("k64_memory_counters", """
SELECT CASE WHEN event_id % 3 = 1 THEN 'Stats:Buffer Manager' ELSE 'STATS:MEMORY MANAGER' END AS object_name, CASE event_type WHEN 'view' THEN 'Page life expectancy' WHEN 'click' THEN 'Free list stalls/sec' ELSE 'Memory Grants Pending' END AS counter_name,
  CAST(event_id AS VARCHAR) AS instance_name, CAST(floor(value * 5) AS BIGINT) AS cntr_value FROM events
WHERE (event_id % 3 = 1 AND event_type IN ('view', 'click')) OR (event_id % 3 = 2 AND event_type = 'error')""")
def _(t):
    return P.memory_counters(memory_counters(t))


@query("k65_memory_events", """
SELECT TIMESTAMP '2024-01-31' - to_seconds((100000000 - event_id * 977) // 1000) AS event_time, event_type AS notification, CAST(user_id AS INTEGER) AS indicators_process, CAST(floor(value) AS INTEGER) AS indicators_system, event_id AS physical_kb, CAST(NULL AS BIGINT) AS virtual_kb FROM events""")
def _(t):
    doc = F.concat(F.lit('<Record id="'), F.col("event_id").cast("string"), F.lit('" type="RING_BUFFER_RESOURCE_MONITOR"><ResourceMonitor><Notification>'), F.col("event_type"), F.lit("</Notification><IndicatorsProcess>"),
                   F.col("user_id").cast("string"), F.lit("</IndicatorsProcess><IndicatorsSystem>"), F.floor("value").cast("string"), F.lit("</IndicatorsSystem></ResourceMonitor><MemoryRecord><AvailablePhysicalMemory>"),
                   F.col("event_id").cast("string"), F.lit("</AvailablePhysicalMemory></MemoryRecord></Record>"))
    return P.memory_events(t.events.select(doc.alias("record"), (F.col("event_id") * 977).alias("timestamp")), F.lit(100000000), events_as_of())
