"""Group K.6: backup, restore and integrity history."""

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.scalars import decode, shift
from ..plans import backups as P
from .fixtures import ORDERS_AS_OF, fx, orders_as_of
from .registry import query


def cents(c):
    return F.round(F.col(c) * 100).cast("bigint")


def sets(t):
    """Orders as backup sets of their customer's database."""
    return t.orders.select(
        F.col("o_orderkey").alias("backup_set_id"), F.col("o_custkey").alias("database_name"), decode("o_orderstatus", {"F": "D", "O": "I", "P": "L"}).alias("type"), F.col("o_orderdate").alias("backup_start_date"),
        shift("o_orderdate", "second", F.col("o_orderkey") % 5000).alias("backup_finish_date"), (cents("o_totalprice") * 1000).alias("backup_size"), (cents("o_totalprice") * 300 + F.col("o_orderkey")).alias("compressed_backup_size"),
        F.col("o_orderpriority").alias("media_set_id"), F.col("o_orderkey").alias("last_lsn"), (F.col("o_orderkey") - F.col("o_custkey") % 3).alias("first_lsn"), (F.col("o_orderstatus") == "F").alias("has_backup_checksums"),
        F.col("o_orderpriority").alias("encryptor_thumbprint"))


def media(t):
    return t.orders.select(F.col("o_orderpriority").alias("media_set_id"), F.concat(F.lit("disk_"), "o_orderpriority").alias("physical_device_name")).distinct()


def databases(t):
    return t.customer.select(F.col("c_custkey").alias("database_name"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "FULL").otherwise("SIMPLE").alias("recovery_model_desc"),
                             F.when(F.col("c_acctbal") >= 0, "ONLINE").otherwise("OFFLINE").alias("state_desc"))


SETS = """SELECT o_orderkey AS backup_set_id, o_custkey AS database_name, CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'O' THEN 'I' WHEN 'P' THEN 'L' END AS type, o_orderdate AS s, o_orderdate + to_seconds(o_orderkey % 5000) AS f, o_orderkey % 5000 AS secs,
  CAST(o_totalprice * 100 AS BIGINT) * 1000 AS size, CAST(o_totalprice * 100 AS BIGINT) * 300 + o_orderkey AS csize, 'disk_' || o_orderpriority AS device, o_orderkey AS last_lsn, o_orderkey - o_custkey % 3 AS first_lsn, o_orderpriority FROM orders"""
DBS = """SELECT c_custkey AS database_name, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'FULL' ELSE 'SIMPLE' END AS rm, CASE WHEN c_acctbal >= 0 THEN 'ONLINE' ELSE 'OFFLINE' END AS st FROM customer"""
KIND = "CASE type WHEN 'D' THEN 'Full' WHEN 'I' THEN 'Differential' WHEN 'L' THEN 'Log' END"


@query("k76_backup_history", f"""
SELECT backup_set_id, {KIND} AS backup_type, printf('%02d:%02d:%02d', secs // 3600, secs % 3600 // 60, secs % 60) AS backup_duration, {fx('size / 1048576.0', 2)} AS size_mb, {fx('csize / 1073741824.0', 2)} AS compressed_gb, device AS physical_device_name FROM ({SETS})""")
def _(t):
    return P.backup_history(sets(t), media(t)).select("backup_set_id", "backup_type", "backup_duration", "size_mb", "compressed_gb", "physical_device_name")


@query("k77_backup_status", f"""
WITH l AS (SELECT database_name, max(f) FILTER (type = 'D') AS lf, max(f) FILTER (type = 'I') AS ld, max(f) FILTER (type = 'L') AS ll FROM ({SETS}) GROUP BY 1)
SELECT d.database_name, lf AS last_full, ld AS last_diff, ll AS last_log, date_diff('hour', lf, TIMESTAMP '2001-12-31') AS hours_since_full, date_diff('minute', ll, TIMESTAMP '2001-12-31') AS minutes_since_log,
  CASE WHEN lf IS NULL THEN '*** NO FULL BACKUP ***' WHEN date_diff('hour', lf, TIMESTAMP '2001-12-31') > 8760 THEN '*** FULL BACKUP OVERDUE ***' ELSE 'OK' END AS full_status,
  CASE WHEN rm = 'FULL' AND ll IS NULL THEN '*** NO LOG BACKUP (FULL recovery!) ***' WHEN rm = 'FULL' AND date_diff('minute', ll, TIMESTAMP '2001-12-31') > 525600 THEN '*** LOG BACKUP OVERDUE ***' ELSE 'OK' END AS log_status
FROM ({DBS}) d LEFT JOIN l USING (database_name) WHERE st = 'ONLINE'""")
def _(t):
    return P.backup_status(databases(t), sets(t), orders_as_of(), full_hours=8760, log_minutes=525600).drop("recovery_model_desc", "state_desc")


@query("k78_missing_backups", f"""
SELECT database_name, rm AS recovery_model_desc FROM ({DBS}) WHERE database_name NOT IN (SELECT database_name FROM ({SETS}) WHERE type = 'D' AND f >= TIMESTAMP '2001-12-31' - INTERVAL 17520 HOUR)""")
def _(t):
    return P.missing_backups(databases(t), sets(t), orders_as_of(), hours=17520).select("database_name", "recovery_model_desc")


@query("k78_recent_backups", f"""
SELECT d.database_name, f AS backup_finish_date, type FROM ({DBS}) d LEFT JOIN (SELECT * FROM ({SETS}) WHERE f >= TIMESTAMP '2001-12-31' - INTERVAL 8760 HOUR) USING (database_name)""")
def _(t):
    return P.recent_backups(databases(t), sets(t), orders_as_of(), hours=8760, kind=None).select("database_name", "backup_finish_date", "type")


@query("k78_log_gaps", f"""
SELECT database_name, ll AS last_log, date_diff('minute', ll, TIMESTAMP '2001-12-31') AS minutes_since_last_log FROM ({DBS}) LEFT JOIN (SELECT database_name, max(f) AS ll FROM ({SETS}) WHERE type = 'L' GROUP BY 1) USING (database_name)
WHERE rm = 'FULL' AND st = 'ONLINE' AND (ll IS NULL OR date_diff('minute', ll, TIMESTAMP '2001-12-31') > 525600)""")
def _(t):
    return P.log_gaps(databases(t), sets(t), orders_as_of(), minutes=525600).select("database_name", "last_log", "minutes_since_last_log")


@query("k79_chain_breaks", f"""
SELECT database_name, f AS backup_finish_date, first_lsn, p AS prev_last_lsn, '*** CHAIN BREAK ***' AS chain_status FROM (SELECT *, lag(last_lsn) OVER (PARTITION BY database_name ORDER BY f, backup_set_id) AS p FROM ({SETS})
  WHERE type = 'L' AND f >= TIMESTAMP '2001-12-31' - INTERVAL 2000 DAY) WHERE p IS NOT NULL AND first_lsn <> p""")
def _(t):
    return P.chain_breaks(sets(t), orders_as_of(), days=2000)


@query("k80_checksum_audit", f"""
SELECT database_name, f AS backup_finish_date, {KIND} AS backup_type, '*** NO CHECKSUM ***' AS checksum_status, device AS physical_device_name FROM ({SETS}) WHERE f >= TIMESTAMP '2001-12-31' - INTERVAL 1000 DAY AND type <> 'D'""")
def _(t):
    return P.checksum_audit(sets(t), media(t), orders_as_of(), days=1000)


@query("k80_backup_encryption", f"""
SELECT backup_set_id, {KIND} AS backup_type, CASE WHEN o_orderpriority <> '5-LOW' THEN 'cert_' || o_orderpriority END AS certificate, {fx('size / 1048576.0', 2)} AS size_mb FROM ({SETS}) ORDER BY f DESC, backup_set_id LIMIT 50""")
def _(t):
    certs = t.orders.select(F.col("o_orderpriority").alias("encryptor_thumbprint")).distinct().where("encryptor_thumbprint <> '5-LOW'").withColumn("certificate", F.concat(F.lit("cert_"), "encryptor_thumbprint"))
    return P.backup_encryption(sets(t), certs).select("backup_set_id", "backup_type", "certificate", "size_mb")


@query("k81_backup_throughput", f"""
SELECT backup_set_id, database_name, {KIND} AS backup_type, secs AS duration_sec, {fx('size / 1048576.0', 2)} AS size_mb, {fx('csize / 1048576.0', 2)} AS compressed_mb, {fx('100.0 - csize * 100.0 / CAST(size AS DOUBLE)', 2)} AS compression_pct,
  CASE WHEN secs <> 0 THEN {fx('size / 1048576.0 / CAST(secs AS DOUBLE)', 2)} END AS mb_per_sec FROM ({SETS}) ORDER BY f DESC, backup_set_id LIMIT 50""")
def _(t):
    return P.backup_throughput(sets(t), 50)


@query("k82_backup_health", f"""
WITH l AS (SELECT database_name, max(f) FILTER (type = 'D') AS lf, max(f) FILTER (type = 'I') AS ld, max(f) FILTER (type = 'L') AS ll, max(csize // 1048576) FILTER (type = 'D') AS fc, max({fx('CAST(size AS DOUBLE) / CAST(csize AS DOUBLE)', 2)}) FILTER (type = 'D') AS cr
  FROM ({SETS}) WHERE f > TIMESTAMP '2001-12-31' - INTERVAL 1000 DAY GROUP BY 1),
c AS (SELECT c_custkey AS database_name, CAST(floor(abs(c_acctbal)) AS BIGINT) AS u, CAST(20000 AS BIGINT) AS lk, c_custkey * 10 AS dk FROM customer)
SELECT database_name, lf AS last_full, ld AS last_diff, ll AS last_log, fc AS full_compressed_mb, cr AS compression_ratio, {fx('dk / 1024.0', 2)} AS data_mb, {fx('lk / 1024.0', 2)} AS log_mb, {fx('CAST(u AS DOUBLE) / CAST(lk AS DOUBLE)', 2)} * 100 AS log_used_pct
FROM c LEFT JOIN l USING (database_name)""")
def _(t):
    row = lambda name, c: t.customer.select(F.col("c_custkey").alias("instance_name"), F.lit(name).alias("counter_name"), c.cast("bigint").alias("cntr_value"))
    counters = (row("Log File(s) Used Size (KB)   ", F.floor(F.abs("c_acctbal"))).unionByName(row("Log File(s) Size (KB)", F.lit(20000))).unionByName(row("Data File(s) Size (KB)", F.col("c_custkey") * 10)))
    return P.backup_health(databases(t).select("database_name"), sets(t), counters, orders_as_of(), days=1000)


@query("k83_restore_history", f"""
SELECT l_partkey AS destination_database_name, l_shipdate AS restore_date, device AS physical_device_name, s AS backup_start_date, database_name AS source_database_name FROM lineitem JOIN ({SETS}) ON backup_set_id = l_orderkey""")
def _(t):
    restores = t.lineitem.select(F.col("l_orderkey").alias("backup_set_id"), F.col("l_partkey").alias("destination_database_name"), F.col("l_shipdate").alias("restore_date"))
    return P.restore_history(restores, sets(t), media(t)).drop("backup_finish_date")


@query("k83_verify_commands", f"""
SELECT database_name, f AS backup_finish_date, device AS physical_device_name, 'RESTORE VERIFYONLY FROM DISK = N''' || device || ''' WITH CHECKSUM;' AS verify_command FROM ({SETS}) WHERE type = 'D' AND f >= TIMESTAMP '2001-12-31' - INTERVAL 1000 DAY""")
def _(t):
    return P.verify_commands(sets(t), media(t), orders_as_of(), days=1000)


WORDS = lambda s: f"({s}) // 3600 || ' hour(s), ' || ({s}) % 3600 // 60 || ' min, ' || ({s}) % 60 || ' sec'"


@query("k84_progress", f"""
SELECT o_orderkey AS session_id, {WORDS("date_diff('second', o_orderdate, TIMESTAMP '2001-12-31')")} AS running_time, {WORDS("CAST(floor(o_totalprice) AS BIGINT)")} AS est_time_to_go, TIMESTAMP '2001-12-31' + to_seconds(CAST(floor(o_totalprice) AS BIGINT)) AS estimated_end
FROM orders WHERE o_orderstatus <> 'P'""")
def _(t):
    rows = t.orders.select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("start_time"), (F.floor("o_totalprice") * 1000).alias("estimated_completion_ms"),
                           decode("o_orderstatus", {"F": "BACKUP DATABASE", "O": "RESTORE LOG", "P": "SELECT"}).alias("command"))
    return P.progress(rows, orders_as_of()).select("session_id", "running_time", "est_time_to_go", "estimated_end")


@query("k84_restoring", """
SELECT doc_id AS session_id, lang AS database_name FROM documents d JOIN (SELECT DISTINCT lang FROM documents WHERE lang <> 'en') n USING (lang) WHERE false
UNION ALL SELECT d.doc_id, n.lang FROM documents d JOIN (SELECT DISTINCT lang FROM documents WHERE lang <> 'en') n ON contains(d.text, n.lang)""")
def _(t):
    names = t.documents.select(F.col("lang").alias("database_name"), F.when(F.col("lang") == "en", "ONLINE").otherwise("RESTORING").alias("state_desc")).distinct()
    requests = t.documents.select(F.col("doc_id").alias("session_id"), "text", F.lit("RESTORE DATABASE").alias("command"))
    return P.restoring(requests, names).select("session_id", "database_name")


@query("k84_eta", """
SELECT c_custkey AS database_name, a AS initial_progress, b AS second_progress, b - a AS progress_difference, CASE WHEN b > a THEN (100 - b) / (b - a) * (10 / CAST(60 AS DOUBLE)) END AS estimated_minutes
FROM (SELECT c_custkey, abs(c_acctbal) / 200.0 AS a, greatest(c_acctbal, 0) / 100.0 AS b FROM customer)""")
def _(t):
    sample = lambda c: t.customer.select(F.col("c_custkey").alias("database_name"), c.alias("percent_complete"))
    return P.eta(sample(F.abs("c_acctbal") / 200.0), sample(F.greatest("c_acctbal", F.lit(0.0)) / 100.0), seconds=10)


@query("k85_check_age", """
SELECT c_custkey AS database_name, date_diff('day', x, TIMESTAMP '2001-12-31') AS days_since_last_check, CASE WHEN x = TIMESTAMP '1900-01-01' THEN '*** NEVER CHECKED ***' WHEN date_diff('day', x, TIMESTAMP '2001-12-31') > 400 THEN '*** OVERDUE ***' ELSE 'OK' END AS status
FROM (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN TIMESTAMP '1900-01-01' ELSE (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) END AS x FROM customer WHERE c_acctbal >= 0)""")
def _(t):
    last = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("m"))
    never = F.lit("1900-01-01").cast("timestamp_ntz")
    dbs = (t.customer.join(last, "c_custkey", "left").select(F.col("c_custkey").alias("database_name"), F.when(F.col("c_mktsegment") == "BUILDING", never).otherwise(F.col("m")).alias("last_good_check"),
                                                             F.when(F.col("c_acctbal") >= 0, "ONLINE").otherwise("OFFLINE").alias("state_desc")))
    return P.check_age(dbs, orders_as_of(), days=400).select("database_name", "days_since_last_check", "status")


@query("k85_suspect_pages", """
SELECT l_orderkey AS page_id, p_name AS name, CASE l_linenumber WHEN 1 THEN '823 error (I/O error)' WHEN 2 THEN 'Bad checksum' WHEN 3 THEN 'Torn page' WHEN 4 THEN 'Restored (after repair)' WHEN 5 THEN 'Repaired (DBCC)' WHEN 7 THEN 'Deallocated (DBCC)' END AS event_description
FROM lineitem JOIN part ON p_partkey = l_partkey""")
def _(t):
    pages = t.lineitem.select(F.lit(1).alias("database_id"), F.col("l_partkey").alias("file_id"), F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("event_type"))
    files = t.part.select(F.lit(1).alias("database_id"), F.col("p_partkey").alias("file_id"), F.col("p_name").alias("name"))
    return P.suspect_pages(pages, files).select("page_id", "name", "event_description")


@query("k85_verify_option", """
SELECT c_name AS database_name, CASE WHEN c_mktsegment <> 'BUILDING' THEN '*** CHANGE TO CHECKSUM ***' ELSE 'OK' END AS recommendation, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'ALTER DATABASE [' || c_name || '] SET PAGE_VERIFY CHECKSUM WITH NO_WAIT;' END AS fix_command
FROM customer WHERE c_acctbal >= 0""")
def _(t):
    dbs = t.customer.select(F.col("c_name").alias("database_name"), F.when(F.col("c_mktsegment") == "BUILDING", "CHECKSUM").otherwise("NONE").alias("page_verify_option_desc"), F.when(F.col("c_acctbal") >= 0, "ONLINE").otherwise("OFFLINE").alias("state_desc"))
    return P.verify_option_audit(dbs).select("database_name", "recommendation", "fix_command")
