"""Stand-ins for collected telemetry, derived from the given tables.

Every DataFrame here has a SQL twin of the same rows, used by the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import int_div

ORDERS_AS_OF = "timestamp_ntz'2001-12-31 00:00:00'"
EVENTS_AS_OF = "timestamp_ntz'2024-01-31 00:00:00'"
EVENTS_SPLIT = "timestamp_ntz'2024-01-16 00:00:00'"


def orders_as_of() -> Column:
    return F.expr(ORDERS_AS_OF)


def events_as_of() -> Column:
    return F.expr(EVENTS_AS_OF)


def money(c) -> Column:
    """Two-decimal doubles as exact decimals, so that sums are exact."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def fx(expr: str, scale: int) -> str:
    """SQL twin of functions.scalars.fixed."""
    f = f"{10.0 ** scale:.1f}"
    return f"(floor(CAST({expr} AS DOUBLE) * {f} + 0.5) / {f})"


# --- SQL twins of the derived inputs ---------------------------------------

TREE_SQL = """
SELECT c_custkey AS sid, c_custkey // 8 AS blk,
       CAST(floor(abs(c_acctbal)) AS BIGINT) AS wait_ms, c_mktsegment AS wait_type
FROM customer WHERE c_custkey > 0"""

COUNTERS_SQL = """
SELECT event_type AS counter, batch,
       CAST(sum(n) OVER w AS BIGINT) AS tasks, sum(v) OVER w AS wait_ms
FROM (SELECT event_type, CAST(ts AS DATE) AS batch, count(*) AS n,
             CAST(sum(CAST(value * 100 AS BIGINT)) AS BIGINT) AS v
      FROM events GROUP BY 1, 2)
WINDOW w AS (PARTITION BY event_type ORDER BY batch)"""


class Tables:
    """The given tables by name, read on first use, and the inputs derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def customer_tree(self) -> DataFrame:
        """Sessions with the session that blocks them; 0 is not blocked."""
        return self.customer.where("c_custkey > 0").select(
            F.col("c_custkey").alias("sid"),
            int_div("c_custkey", 8).alias("blk"),
            F.floor(F.abs("c_acctbal")).cast("bigint").alias("wait_ms"),
            F.col("c_mktsegment").alias("wait_type"))

    def daily_counters(self) -> DataFrame:
        """Counters that only grow: a running total per event type, one batch per day."""
        from ..operators.windows import running

        daily = (self.events.groupBy(F.col("event_type").alias("counter"),
                                     F.col("ts").cast("date").alias("batch"))
                 .agg(F.count(F.lit(1)).alias("n"),
                      F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("v")))
        out = running(daily.withColumn("_month", F.trunc("batch", "month")), ["counter"], ["batch"],
                      "_month", {"tasks": "n", "wait_ms": "v"})
        return out.select("counter", "batch", F.col("tasks").cast("bigint").alias("tasks"),
                          F.col("wait_ms").cast("bigint").alias("wait_ms"))

    def spread(self, df: DataFrame, key: str) -> DataFrame:
        """Rows of a one-file table over all cores, as documents from many files would be."""
        return df.repartition(self.spark.sparkContext.defaultParallelism, key)

    def events_xml(self) -> DataFrame:
        """One event document per row."""
        value = lambda name, c: F.concat(F.lit(f'<data name="{name}"><value>'), c.cast("string"),
                                         F.lit("</value></data>"))
        action = lambda name, c: F.concat(F.lit(f'<action name="{name}"><value>'), c.cast("string"),
                                          F.lit("</value></action>"))
        doc = F.concat(F.lit('<event name="'), F.col("event_type"), F.lit('" timestamp="'),
                       F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('">'),
                       value("duration", money("value")), value("props", F.col("props")),
                       action("session_id", F.col("user_id")), F.lit("</event>"))
        return self.spread(self.events, "event_id").select("event_id", doc.alias("event_data"))

    # --- waits per user: one row per user and capture time ------------------

    def user_snapshots(self) -> DataFrame:
        """Cumulative waits per user at three capture times; an event counts in every capture after it."""
        captures = F.filter(F.array(*[F.lit(c).cast("timestamp_ntz") for c in CAPTURES]), lambda c: c > F.col("ts"))
        cents = F.round(F.col("value") * 100).cast("bigint")
        return (self.events.withColumn("runtime", F.explode(captures))
                .groupBy("runtime", wait_name().alias("wait_type"))
                .agg(F.count(F.lit(1)).alias("waiting_tasks_count"), F.sum(cents).alias("wait_time_ms"),
                     F.sum(F.when(F.col("event_type") == "view", cents).otherwise(0)).alias("signal_wait_time_ms"),
                     F.max(cents).alias("max_wait_time_ms")))

    def user_waits(self) -> DataFrame:
        """The same over the whole table: one row per wait type."""
        cents = F.round(F.col("value") * 100).cast("bigint")
        return (self.events.groupBy(wait_name().alias("wait_type"))
                .agg(F.count(F.lit(1)).alias("waiting_tasks_count"), F.sum(cents).alias("wait_time_ms"),
                     F.sum(F.when(F.col("event_type") == "view", cents).otherwise(0)).alias("signal_wait_time_ms"),
                     F.max(cents).alias("max_wait_time_ms")))


CAPTURES = ["2024-01-06 00:00:00", "2024-01-16 00:00:00", "2024-01-26 00:00:00"]
# A few users stand for wait types that reports treat in their own way.
SPECIAL_USERS = {1: "SOS_SCHEDULER_YIELD", 2: "DIRTY_PAGE_POLL", 3: "WAITFOR", 4: "LCK_M_X", 5: "LCK_M_S", 6: "PAGEIOLATCH_SH"}


def wait_name() -> Column:
    from ..functions.scalars import decode

    return decode("user_id", SPECIAL_USERS, F.concat(F.lit("USER_"), F.col("user_id").cast("string")))


_WAIT_NAME_SQL = ("CASE user_id " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in SPECIAL_USERS.items())
                  + " ELSE 'USER_' || user_id END")
_WAIT_AGG_SQL = f"""{_WAIT_NAME_SQL} AS wait_type, CAST(count(*) AS BIGINT) AS waiting_tasks_count,
  CAST(sum(CAST(value * 100 AS BIGINT)) AS BIGINT) AS wait_time_ms,
  CAST(sum(CASE WHEN event_type = 'view' THEN CAST(value * 100 AS BIGINT) ELSE 0 END) AS BIGINT) AS signal_wait_time_ms,
  CAST(max(CAST(value * 100 AS BIGINT)) AS BIGINT) AS max_wait_time_ms"""
USER_WAITS_SQL = f"SELECT {_WAIT_AGG_SQL} FROM events GROUP BY 1"
USER_SNAPSHOTS_SQL = f"""SELECT runtime, {_WAIT_AGG_SQL} FROM events JOIN (VALUES {', '.join(f"(TIMESTAMP '{c}')" for c in CAPTURES)}) c(runtime)
ON ts < runtime GROUP BY ALL"""
