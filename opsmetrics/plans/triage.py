"""First-look bundle: an ordered set of reports over whatever tables were collected."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..session import materialise
from . import backups, blocking, counters, jobs, sessions, storage, workload


@dataclass
class Triage:
    """Reports by name, in order, still lazy; and the reason for each one that could not be built or run."""

    reports: dict[str, DataFrame] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    def run(self, limit: float | None = None) -> Triage:
        """Run each report on its own and go on from its written rows; one that fails is noted and does not stop the rest.

        With ``limit``, a report that takes more seconds is noted as well: its jobs, which carry its tag, are
        cancelled, and it is not waited for.
        """
        out = Triage(errors=dict(self.errors))
        for name, report in self.reports.items():
            found = _in_time(report.sparkSession, lambda report=report: materialise(report), limit)
            if isinstance(found, DataFrame):
                out.reports[name] = found
            else:
                out.errors[name] = found
        return out


def _in_time(spark: SparkSession, work: Callable[[], DataFrame], limit: float | None) -> DataFrame | str:
    """What ``work`` returns, or why it did not."""
    tag, found = f"triage-{uuid.uuid4().hex}", []

    def run() -> None:
        try:
            spark.sparkContext.addJobTag(tag)
            found.append(work())
        except Exception as error:  # a report must not stop the others
            found.append(str(error).splitlines()[0])
        finally:
            spark.sparkContext.removeJobTag(tag)

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(limit)
    if thread.is_alive():
        spark.sparkContext.cancelJobsWithTag(tag)
        return f"stopped after {limit:g} s"
    return found[0]


def posture(databases: DataFrame) -> DataFrame:
    """State and settings of each database, as far as they were collected."""
    return databases.select("database_name", *[c for c in V.POSTURE if c in databases.columns])


def parts(tables: dict[str, DataFrame], n: int, as_of) -> dict[str, Callable[[], DataFrame]]:
    t = tables
    return {
        "database_posture": lambda: posture(t["databases"]),
        "running_requests": lambda: sessions.running_requests(t["requests"], t["sessions"], t["texts"], n),
        "head_blockers": lambda: blocking.head_blockers(t["requests"]),
        "top_waits": lambda: counters.wait_totals(t["waits"], n=20),
        "top_cpu": lambda: workload.top_statements(t["statements"], "worker_time", n),
        "top_reads": lambda: workload.top_statements(t["statements"], "logical_reads", n),
        "top_elapsed": lambda: workload.top_statements(t["statements"], "elapsed_time", n, how="avg"),
        "memory": lambda: storage.page_life(t["counters"]),
        "temp_space": lambda: sessions.temp_space(t["session_pages"], t["sessions"]).orderBy(F.desc("net_pages"), "session_id").limit(n),
        "file_latency": lambda: storage.file_latency(t["file_io"], t["files"], "data"),
        "volume_space": lambda: storage.volume_space(t["volumes"]),
        "last_backups": lambda: backups.last_backups(t["databases"], t["backups"]),
        "log_gaps": lambda: backups.log_gaps(t["databases"], t["backups"], as_of, minutes=24 * 60),
        "failed_jobs": lambda: jobs.recent_failures(t["job_history"], t["jobs"], as_of, n=n),
    }


def triage(tables: dict[str, DataFrame], as_of, n: int = 25) -> Triage:
    """Build every report; one that fails is noted and does not stop the rest."""
    out = Triage()
    for name, build in parts(tables, n, as_of).items():
        try:
            out.reports[name] = build()
        except KeyError as missing:
            out.errors[name] = f"table not collected: {missing.args[0]}"
        except Exception as error:  # a report must not stop the others
            out.errors[name] = str(error).splitlines()[0]
    return out
