"""Jobs, schedules and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.scalars import boundaries, clock_text, decode, fixed, has_flag, hhmmss_seconds, int_datetime, rules, safe_div, shift
from ..operators.ranking import latest_per_key, top_k_per_group
from ..operators.sets import append_new, retain


def running_jobs(activity: DataFrame, jobs: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    live = activity.where("start_execution_date is not null and stop_execution_date is null")
    return (live.join(jobs.select("job_id", "job_name"), "job_id").join(requests, "session_id", "left")
            .withColumn("elapsed_seconds", boundaries("second", "start_execution_date", as_of)))


def last_run(history: DataFrame) -> DataFrame:
    """Newest history row of each job, by instance number."""
    return latest_per_key(history, "job_id", "instance_id", ["run_date", "run_time", "run_duration", "run_status"])


def job_overview(jobs: DataFrame, history: DataFrame, categories: DataFrame, schedules: DataFrame) -> DataFrame:
    """Every job with its category, schedule and last run, where known."""
    last = last_run(history).withColumns({"last_start": int_datetime("run_date", "run_time"), "last_duration": clock_text("run_duration")})
    return (jobs.join(last.drop("run_date", "run_time"), "job_id", "left").join(categories, "category_id", "left")
            .join(schedules, "job_id", "left"))


def job_history(history: DataFrame, jobs: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Whole-job runs of the last hours."""
    rows = history.where("step_id = 0").withColumn("run_at", int_datetime("run_date", "run_time"))
    return (rows.where(F.col("run_at") > shift(as_of, "hour", -hours)).join(jobs.select("job_id", "job_name"), "job_id")
            .select("job_name", "run_at", "message", "run_status", "run_duration"))


def failed_steps(history: DataFrame, jobs: DataFrame) -> DataFrame:
    return history.where("step_id > 0 and run_status <> 1").join(jobs.select("job_id", "job_name"), "job_id")


def recent_failures(history: DataFrame, jobs: DataFrame, as_of, hours: int = 24, n: int = 25) -> DataFrame:
    """Failed, retried and cancelled runs of the last hours, newest first."""
    rows = history.where("run_status in (0, 2, 3)").withColumn("run_at", int_datetime("run_date", "run_time"))
    rows = rows.where(F.col("run_at") >= shift(as_of, "hour", -hours)).orderBy(F.desc("run_at"), "instance_id").limit(n)
    return rows.join(jobs.select("job_id", "job_name"), "job_id").select("job_name", "run_at", "step_id", "run_status", "message", "instance_id")


def last_status(history: DataFrame, jobs: DataFrame) -> DataFrame:
    last = last_run(history.where("step_id = 0"))
    return last.join(jobs.select("job_id", "job_name"), "job_id").select(
        "job_id", "job_name", int_datetime("run_date", "run_time").alias("last_run"), decode("run_status", V.JOB_STATUS).alias("status"))


def last_runs(jobs: DataFrame, history: DataFrame, n: int = 3) -> DataFrame:
    """Last ``n`` runs per job; a job that never ran stays."""
    top = top_k_per_group(history.where("step_id = 0"), "job_id", [F.desc("run_date"), F.desc("run_time"), F.desc("instance_id")], n)
    return jobs.join(top, "job_id", "left").withColumn("run_status_desc", decode("run_status", V.JOB_STATUS))


# --- schedules -------------------------------------------------------------

def text(c) -> Column:
    return F.col(c).cast("string")


def weekdays(flags: str = "freq_interval") -> Column:
    """Days of a weekday mask, Sunday first."""
    return F.concat_ws(", ", *[F.when(has_flag(flags, bit), day) for bit, day in V.WEEKDAY_BITS.items()])


def occurs() -> Column:
    return decode("freq_type", V.FREQUENCY_TYPES, "")


def occurs_detail() -> Column:
    kind = F.col("freq_type")
    months = F.concat(F.lit(" of every "), text("freq_recurrence_factor"), F.lit(" month(s)"))
    return rules([
        (kind == 1, "Once"),
        (kind == 4, F.concat(F.lit("Every "), text("freq_interval"), F.lit(" day(s)"))),
        (kind == 8, F.concat(F.lit("Every "), text("freq_recurrence_factor"), F.lit(" weeks(s) on "), weekdays())),
        (kind == 16, F.concat(F.lit("Day "), text("freq_interval"), months)),
        (kind == 32, F.concat(F.lit("The "), decode("freq_relative_interval", V.RELATIVE_WEEKS), F.lit(" "),
                              decode("freq_interval", V.RELATIVE_DAYS), months))], "")


def frequency() -> Column:
    """From ``_start`` and ``_end``, the times of day in text."""
    sub, start, end = F.col("freq_subday_type"), F.col("_start"), F.col("_end")
    every = lambda unit: F.concat(F.lit("Occurs every "), text("freq_subday_interval"), F.lit(f" {unit} between "), start, F.lit(" and "), end)
    return rules([(sub == 1, F.concat(F.lit("Occurs once at "), start))] + [(sub == code, every(unit)) for code, unit in V.SUBDAY_UNITS.items()], "")


def schedule_text(schedules: DataFrame) -> DataFrame:
    """Schedules in words, with the next run; a run date of 0 shows as 1900-01-01."""
    next_run = F.coalesce(int_datetime("next_run_date", "next_run_time"), F.when(F.col("next_run_date") == 0, F.lit("1900-01-01").cast("timestamp_ntz")))
    # Both times are made once and not in every branch.
    schedules = schedules.withColumns({"_start": clock_text("active_start_time"), "_end": clock_text("active_end_time")})
    out = schedules.withColumns({"occurs": occurs(), "occurs_detail": occurs_detail(), "frequency": frequency(), "next_run": next_run})
    return out.drop("_start", "_end")


def avg_duration(history: DataFrame) -> DataFrame:
    """Average seconds of whole-job runs, from packed durations."""
    secs = hhmmss_seconds("run_duration")
    return history.where("step_id = 0").groupBy("job_id").agg(F.sum(secs).alias("_s"), F.count(F.lit(1)).alias("_n")).select(
        "job_id", fixed(safe_div("_s", "_n"), 2).alias("avg_duration_sec"))


# --- audits ----------------------------------------------------------------

def job_audit(jobs: DataFrame, rule: str, steps: DataFrame | None = None, proxies: DataFrame | None = None, owner: str = "sa") -> DataFrame:
    """``owner``: jobs of another owner. ``subsystem``: steps that run shell code.
    ``proxy``: steps with the proxy they run under, N/A without one."""
    if rule == "owner":
        return jobs.where(F.col("owner") != owner)
    if rule == "subsystem":
        return steps.where(F.col("subsystem").isin("PowerShell", "CmdExec")).join(jobs.select("job_id", "job_name"), "job_id")
    if rule == "proxy":
        named = proxies.select("proxy_id", "proxy_name")
        return (jobs.select("job_id", "job_name").join(steps, "job_id").join(named, "proxy_id", "left")
                .withColumn("proxy_name", F.coalesce("proxy_name", F.lit("N/A"))))
    raise ValueError(f"unknown rule {rule}")


def alert_audit(alerts: DataFrame) -> DataFrame:
    """Alerts with what sets them off, how often they did and when last (null if never)."""
    return alerts.select(
        "alert_name", "event_source", "message_id", "severity", "enabled", "has_notification", "delay_between_responses",
        "occurrence_count", int_datetime("last_occurrence_date", "last_occurrence_time").alias("last_occurrence"))


# --- logs ------------------------------------------------------------------

def search_logs(logs: DataFrame, pattern: str, column: str = "text") -> DataFrame:
    return logs.where(F.contains(F.lower(F.col(column)), F.lit(pattern.lower())))


def store_logs(target: DataFrame, new: DataFrame, as_of, days: int = 30, key: str = "log_date") -> DataFrame:
    """Stored log plus the lines of new times, without lines older than ``days``."""
    return retain(target.unionByName(append_new(target, new, key)), key, days, as_of)
