"""Backup, restore and integrity history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.scalars import (boundaries, bytes_to, decode, fixed, format_duration, int_div, pct, quote_name, rules,
                                 safe_div, shift)
from ..operators.aggregates import last_by_kind
from ..operators.joins import contains_join
from ..operators.windows import as_list, neighbour

MB = 1048576.0


def backup_type(column: str = "type") -> Column:
    return decode(column, V.BACKUP_TYPES)


def backup_history(sets: DataFrame, media: DataFrame, database: str = "", n: int | None = None) -> DataFrame:
    """Backups with kind, size, duration and device; of one database if named, the newest ``n`` if given."""
    rows = sets if database == "" else sets.where(F.col("database_name") == database)
    rows = rows.join(media, "media_set_id")
    if n is not None:
        rows = rows.orderBy(F.desc("backup_start_date"), "backup_set_id").limit(n)
    secs = boundaries("second", "backup_start_date", "backup_finish_date")
    return rows.withColumns({
        "backup_type": backup_type(), "backup_duration": format_duration(secs, "hms"),
        "size_mb": bytes_to("backup_size"), "size_gb": bytes_to("backup_size", "gb"),
        "compressed_mb": bytes_to("compressed_backup_size"), "compressed_gb": bytes_to("compressed_backup_size", "gb")})


def last_backups(databases: DataFrame, sets: DataFrame) -> DataFrame:
    """Every database with its last backup of each kind."""
    kinds = {"D": "last_full", "I": "last_diff", "L": "last_log"}
    return databases.join(last_by_kind(sets, "database_name", "type", "backup_finish_date", kinds), "database_name", "left")


def backup_status(databases: DataFrame, sets: DataFrame, as_of, full_hours: int = 168, log_minutes: int = 60) -> DataFrame:
    """Last backups with alerts: no or old full backup, no or old log backup under full recovery."""
    hours, minutes = boundaries("hour", "last_full", as_of), boundaries("minute", "last_log", as_of)
    full = F.col("recovery_model_desc") == "FULL"
    rows = last_backups(databases.where("state_desc = 'ONLINE'"), sets)
    return rows.withColumns({
        "hours_since_full": hours, "minutes_since_log": minutes,
        "full_status": rules([(F.col("last_full").isNull(), "*** NO FULL BACKUP ***"), (hours > full_hours, "*** FULL BACKUP OVERDUE ***")], "OK"),
        "log_status": rules([(full & F.col("last_log").isNull(), "*** NO LOG BACKUP (FULL recovery!) ***"),
                             (full & (minutes > log_minutes), "*** LOG BACKUP OVERDUE ***")], "OK")})


def recent_backups(databases: DataFrame, sets: DataFrame, as_of, hours: int = 24, kind: str | None = "D") -> DataFrame:
    """Every database next to its recent backups; null where there is none."""
    recent = sets.where(F.col("backup_finish_date") >= shift(as_of, "hour", -hours))
    if kind:
        recent = recent.where(F.col("type") == kind)
    return databases.join(recent.select("database_name", "backup_finish_date", "type"), "database_name", "left")


def missing_backups(databases: DataFrame, sets: DataFrame, as_of, hours: int = 24, kind: str | None = "D") -> DataFrame:
    return recent_backups(databases, sets, as_of, hours, kind).where("backup_finish_date is null").select(*databases.columns)


def log_gaps(databases: DataFrame, sets: DataFrame, as_of, minutes: int = 60) -> DataFrame:
    """Online databases under full recovery without a log backup in the last ``minutes``."""
    last = sets.where("type = 'L'").groupBy("database_name").agg(F.max("backup_finish_date").alias("last_log"))
    rows = databases.where("recovery_model_desc = 'FULL' and state_desc = 'ONLINE'").join(last, "database_name", "left")
    rows = rows.withColumn("minutes_since_last_log", boundaries("minute", "last_log", as_of))
    return rows.where(F.col("last_log").isNull() | (F.col("minutes_since_last_log") > minutes))


def chain_breaks(sets: DataFrame, as_of, days: int = 7, block: Column | None = None) -> DataFrame:
    """Log backups that do not start where the one before ended. The first in the window is no break."""
    window = sets.where((F.col("type") == "L") & (F.col("backup_finish_date") >= shift(as_of, "day", -days)))
    window = window.withColumn("_block", block if block is not None else F.col("backup_finish_date").cast("date"))
    rows = neighbour(window, "database_name", ["backup_finish_date", "backup_set_id"], "_block", {"prev_last_lsn": "last_lsn"})
    return rows.where("prev_last_lsn is not null and first_lsn <> prev_last_lsn").select(
        "database_name", "backup_finish_date", "first_lsn", "prev_last_lsn", F.lit("*** CHAIN BREAK ***").alias("chain_status"))


def checksum_audit(sets: DataFrame, media: DataFrame, as_of, days: int = 30) -> DataFrame:
    bad = sets.where((F.col("backup_finish_date") >= shift(as_of, "day", -days)) & ~F.col("has_backup_checksums"))
    return bad.join(media, "media_set_id").select("database_name", "backup_finish_date", backup_type().alias("backup_type"),
                                                  F.lit("*** NO CHECKSUM ***").alias("checksum_status"), "physical_device_name")


def backup_encryption(sets: DataFrame, certificates: DataFrame, n: int = 50) -> DataFrame:
    newest = sets.orderBy(F.desc("backup_finish_date"), "backup_set_id").limit(n)
    return newest.join(certificates, "encryptor_thumbprint", "left").withColumns(
        {"backup_type": backup_type(), "size_mb": bytes_to("backup_size"), "compressed_mb": bytes_to("compressed_backup_size")})


def backup_throughput(sets: DataFrame, n: int = 50) -> DataFrame:
    secs = boundaries("second", "backup_start_date", "backup_finish_date")
    return (sets.orderBy(F.desc("backup_finish_date"), "backup_set_id").limit(n)
            .select("backup_set_id", "database_name", backup_type().alias("backup_type"), secs.alias("duration_sec"), bytes_to("backup_size").alias("size_mb"),
                    bytes_to("compressed_backup_size").alias("compressed_mb"),
                    fixed(100.0 - safe_div(F.col("compressed_backup_size") * 100.0, "backup_size"), 2).alias("compression_pct"),
                    fixed(safe_div(F.col("backup_size") / MB, secs), 2).alias("mb_per_sec")))


HEALTH_COUNTERS = {"Log File(s) Used Size (KB)": "log_used_kb", "Log File(s) Size (KB)": "log_kb", "Data File(s) Size (KB)": "data_kb"}


def backup_health(databases: DataFrame, sets: DataFrame, counters: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Sizes, log use and last backups per database.

    Counters and backups are each brought to one row per database before the join.
    """
    sizes = counters.groupBy(F.col("instance_name").alias("database_name")).agg(
        *[F.max(F.when(F.rtrim("counter_name") == name, F.col("cntr_value"))).alias(c) for name, c in HEALTH_COUNTERS.items()])
    recent = sets.where(F.col("backup_finish_date") > shift(as_of, "day", -days))
    when = lambda kind, c: F.max(F.when(F.col("type") == kind, c))
    last = recent.groupBy("database_name").agg(
        when("D", F.col("backup_finish_date")).alias("last_full"), when("I", F.col("backup_finish_date")).alias("last_diff"), when("L", F.col("backup_finish_date")).alias("last_log"),
        when("D", int_div("compressed_backup_size", 1048576)).alias("full_compressed_mb"),
        when("D", fixed(safe_div("backup_size", "compressed_backup_size"), 2)).alias("compression_ratio"))
    return (databases.join(sizes.where("log_kb > 0 and data_kb is not null and log_used_kb is not null"), "database_name").join(last, "database_name", "left")
            .withColumns({"data_mb": fixed(F.col("data_kb") / 1024.0, 2), "log_mb": fixed(F.col("log_kb") / 1024.0, 2),
                          "log_used_pct": fixed(safe_div("log_used_kb", "log_kb"), 2) * 100}).drop(*HEALTH_COUNTERS.values()))


def restore_history(restores: DataFrame, sets: DataFrame, media: DataFrame) -> DataFrame:
    return (restores.join(sets, "backup_set_id").join(media, "media_set_id")
            .select("destination_database_name", "restore_date", "physical_device_name", "backup_start_date", "backup_finish_date",
                    F.col("database_name").alias("source_database_name")))


def verify_commands(sets: DataFrame, media: DataFrame, as_of, days: int = 7) -> DataFrame:
    command = F.concat(F.lit("RESTORE VERIFYONLY FROM DISK = N'"), "physical_device_name", F.lit("' WITH CHECKSUM;"))
    return (sets.where((F.col("type") == "D") & (F.col("backup_finish_date") >= shift(as_of, "day", -days))).join(media, "media_set_id")
            .select("database_name", "backup_finish_date", "physical_device_name", command.alias("verify_command")))


# --- progress --------------------------------------------------------------

def progress(requests: DataFrame, as_of, commands=V.BACKUP_COMMANDS) -> DataFrame:
    """Running backups and restores with time spent, time to go and end time."""
    left = int_div("estimated_completion_ms", 1000)
    return requests.where(F.col("command").isin(*commands)).withColumns({
        "running_time": format_duration(boundaries("second", "start_time", as_of), "words"),
        "est_time_to_go": format_duration(left, "words"), "estimated_end": shift(as_of, "second", left)})


def restoring(requests: DataFrame, databases: DataFrame) -> DataFrame:
    """Restores matched to the databases their text names."""
    names = databases.where("state_desc = 'RESTORING'").select("database_name")
    return contains_join(requests.where("command = 'RESTORE DATABASE'"), names, "text", "database_name")


def eta(first: DataFrame, second: DataFrame, seconds: float = 10, key: str = "database_name") -> DataFrame:
    """Minutes to go from the progress between two samples; null without progress."""
    a = first.select(key, F.col("percent_complete").alias("initial_progress"))
    b = second.select(key, F.col("percent_complete").alias("second_progress"))
    diff = F.col("second_progress") - F.col("initial_progress")
    todo = (100 - F.col("second_progress")) / F.when(diff > 0, diff) * (seconds / 60.0)
    return a.join(b, key, "left").withColumns({"progress_difference": diff, "estimated_minutes": todo})


# --- integrity -------------------------------------------------------------

def check_age(databases: DataFrame, as_of, days: int = 7) -> DataFrame:
    never = F.lit("1900-01-01").cast("timestamp_ntz")
    age = boundaries("day", "last_good_check", as_of)
    return databases.where("state_desc = 'ONLINE'").withColumns({
        "days_since_last_check": age,
        "status": rules([(F.col("last_good_check") == never, "*** NEVER CHECKED ***"), (age > days, "*** OVERDUE ***")], "OK")})


def suspect_pages(pages: DataFrame, files: DataFrame) -> DataFrame:
    return pages.join(files, ["database_id", "file_id"]).withColumn("event_description", decode("event_type", V.PAGE_ERRORS))


def verify_option_audit(databases: DataFrame) -> DataFrame:
    """Page verification per online database, with the command that corrects it."""
    wrong = F.col("page_verify_option_desc") != "CHECKSUM"
    command = F.concat(F.lit("ALTER DATABASE "), quote_name("database_name"), F.lit(" SET PAGE_VERIFY CHECKSUM WITH NO_WAIT;"))
    return databases.where("state_desc = 'ONLINE'").withColumns({
        "recommendation": F.when(wrong, "*** CHANGE TO CHECKSUM ***").otherwise("OK"), "fix_command": F.when(wrong, command)})
