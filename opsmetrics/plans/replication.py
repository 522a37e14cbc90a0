"""Replication latency, backlog and history; replicas and seeding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.scalars import boundaries, decode, int_div, safe_div, shift
from ..functions.xml import entry, parse_events
from ..operators.joins import role_join
from ..operators.windows import BLOCK, as_list, attach, range_blocks, ranked, running
from ..session import materialise

SUBSCRIPTION = ["publisher", "publisher_db", "publication", "subscriber", "subscriber_db"]


def tracer_latency(tokens: DataFrame, history: DataFrame, publications: DataFrame, agents: DataFrame, servers: DataFrame) -> DataFrame:
    """Seconds of each leg per tracer: publisher to distributor to subscriber."""
    rows = (history.withColumnRenamed("parent_tracer_id", "tracer_id").join(tokens, "tracer_id").join(publications, "publication_id").join(agents, "agent_id"))
    rows = role_join(rows, servers, "server_id", {"p": "publisher_id", "s": "subscriber_id"}, ["name"])
    leg = lambda a, b: boundaries("second", a, b)
    return (rows.withColumnsRenamed({"p_name": "publisher", "s_name": "subscriber"})
            .select(*SUBSCRIPTION, "tracer_id", "publisher_commit", "distributor_commit", "subscriber_commit",
                    leg("publisher_commit", "distributor_commit").alias("pub_to_dist_sec"), leg("distributor_commit", "subscriber_commit").alias("dist_to_sub_sec"),
                    leg("publisher_commit", "subscriber_commit").alias("total_latency_sec")))


def replication_lag(tracers: DataFrame, as_of, hours: int = 1, keys=SUBSCRIPTION) -> DataFrame:
    """Recent tracers with their latency, and the oldest pending ones with their age.

    ``rank_order`` counts from the newest tracer of a subscription.
    """
    keys = as_list(keys)
    done = tracers.where((F.col("publisher_commit") > shift(as_of, "hour", -hours)) & F.col("total_latency_sec").isNotNull())
    pending = tracers.where("total_latency_sec is null")
    oldest = pending.groupBy(*keys).agg(F.min("publisher_commit").alias("_first"))
    pending = attach(pending, oldest, keys).where("publisher_commit = _first").drop("_first")
    rows = done.unionByName(pending).withColumn("_day", F.col("publisher_commit").cast("date"))
    rows = rows.withColumn("_ago", F.datediff(F.col("_day"), F.lit("1970-01-01").cast("date")))
    rows = materialise(rows.withColumn("lag_sec", F.coalesce("total_latency_sec", boundaries("second", "publisher_commit", as_of))))
    return ranked(rows, keys, "publisher_commit", descending=True, block="_ago", rank="rank_order").drop("_day", "_ago")


def pending_commands(agents: DataFrame, history: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands past the last one delivered, per subscription.

    Commands are counted per sequence number, then marks and counts are put in one order,
    so no command is paired with each subscription of its database.
    """
    group = ["publisher_database_id", "publication", "subscriber_db"]
    last = history.groupBy("agent_id").agg(F.max("xact_seqno").alias("seq"))
    marks = (agents.where("subscriber_db <> 'virtual'").join(last, "agent_id", "left").groupBy(*group)
             .agg(F.max("seq").alias("last_xact_seqno")))
    db = ["publisher_database_id"]
    counts = commands.groupBy(*db, "xact_seqno").agg(F.count(F.lit(1)).alias("n"))
    axis = counts.withColumn("is_mark", F.lit(0)).unionByName(
        marks.where("last_xact_seqno is not null").select(*db, F.col("last_xact_seqno").alias("xact_seqno"), F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("is_mark")).distinct())
    order = ["xact_seqno", "is_mark"]
    rows = range_blocks(axis, *db, *order)
    done = (running(rows, db, order, BLOCK, {"delivered": "n"}).where("is_mark = 1")
            .select(*db, F.col("xact_seqno").alias("last_xact_seqno"), "delivered"))
    totals = counts.groupBy(*db).agg(F.sum("n").alias("total"))
    out = marks.join(totals, db).join(done, db + ["last_xact_seqno"], "left")
    return out.select(*group, "last_xact_seqno", (F.col("total") - F.coalesce("delivered", F.lit(0))).alias("pending_commands")).where("pending_commands > 0")


def large_transactions(commands: DataFrame, transactions: DataFrame, databases: DataFrame, publisher_db: str, as_of, n: int = 1000) -> DataFrame:
    """Today's transactions of one publisher database with more than ``n`` commands."""
    wanted = databases.where(F.col("publisher_db") == publisher_db).select("publisher_database_id")
    key = ["publisher_database_id", "xact_seqno"]
    today = transactions.where(F.col("entry_time") >= F.date_trunc("day", as_of).cast("timestamp_ntz"))
    return (commands.join(wanted, "publisher_database_id", "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("command_count"))
            .where(F.col("command_count") > n).join(today, key).select("entry_time", "xact_seqno", "command_count"))


def agent_progress(history: DataFrame, agent: int, n: int = 10) -> DataFrame:
    """Newest rows of an agent with the commands and minutes since the row before."""
    from pyspark.sql import Window as W

    order = [F.desc("xact_seqno"), F.desc("time")]
    top = (history.where(F.col("agent_id") == agent).orderBy(*order).limit(n)
           .withColumn("_s", F.from_xml("comments", "_cmds int, _state int, _work int, _idle int")))
    w = W.orderBy(*order)
    return (top.select("*", *[F.col(f"_s._{c}").alias(f"stats_{c}") for c in ("cmds", "state", "work", "idle")]).drop("_s")
            .withColumns({"row_num": F.row_number().over(w), "cmd_diff": F.col("stats_cmds") - F.lead("stats_cmds").over(w),
                          "minutes_between_rows": boundaries("minute", F.lead("time").over(w), "time")}))


def agent_history(history: DataFrame, as_of=None, hours: int = 24, n: int = 1000, agent: int | None = None) -> DataFrame:
    """Newest history rows of the last hours, or of one agent."""
    rows = history if as_of is None else history.where(F.col("time") > shift(as_of, "hour", -hours))
    rows = rows if agent is None else rows.where(F.col("agent_id") == agent)
    return rows.orderBy(F.desc("start_time"), F.desc("time"), "row_id").limit(n)


def recent_errors(errors: DataFrame, as_of, days: int = 7, n: int = 1000) -> DataFrame:
    return errors.where(F.col("time") > shift(as_of, "day", -days)).orderBy(F.desc("time"), "error_id").limit(n)


def last_delivered(history: DataFrame) -> DataFrame:
    return history.where("xact_seqno is not null").groupBy("agent_id").agg(F.max("xact_seqno").alias("last_delivered_seqno"))


def next_after(transactions: DataFrame, marks: DataFrame) -> DataFrame:
    """First transaction past the mark of each publisher database."""
    rows = transactions.join(marks, "publisher_database_id").where(F.col("xact_seqno") > F.col("last_seqno"))
    return rows.groupBy("publisher_database_id").agg(F.min_by(F.struct("xact_seqno", "entry_time"), "xact_seqno").alias("t")).select(
        "publisher_database_id", "t.xact_seqno", "t.entry_time")


def commands_of(commands: DataFrame, seq, database) -> DataFrame:
    return commands.where((F.col("xact_seqno") == seq) & (F.col("publisher_database_id") == database)).agg(F.count(F.lit(1)).alias("command_count"))


# --- publications ----------------------------------------------------------

def subscriptions(publications: DataFrame, agents: DataFrame, subs: DataFrame, databases: DataFrame) -> DataFrame:
    real = agents.where("subscriber_db <> 'virtual'").select("publication", "agent_id", "subscriber_db")
    return (publications.join(real, "publication", "left").join(subs, ["publisher_db", "subscriber_db"], "left").join(databases, "publisher_db")
            .withColumn("subscription_status", decode("status", V.SUBSCRIPTION_STATUS)).drop("status").distinct())


def to_reinitialise(subs: DataFrame, agents: DataFrame) -> DataFrame:
    return subs.where("status in (0, 1)").join(agents, "agent_id")


def latest_snapshot(agents: DataFrame, history: DataFrame) -> DataFrame:
    """Last good snapshot per publication; null where none succeeded."""
    good = history.where("runstatus = 2").groupBy("agent_id").agg(F.max("start_time").alias("s"), F.max("delivered_commands").alias("c"))
    return (agents.join(good, "agent_id", "left").groupBy("publisher_db", "publication")
            .agg(F.max("s").alias("last_snapshot_start"), F.max("c").alias("last_snapshot_commands")))


PUBLICATION_TYPES = {0: "Transactional", 1: "Snapshot", 2: "Merge"}


def topology(publications: DataFrame, articles: DataFrame, subs: DataFrame) -> DataFrame:
    """One row per node: publisher, publication, its articles as a count with sizes, subscribers.

    Sort by ``path`` for the tree; ``line`` is the node as printed.
    """
    two_way = F.when(F.col("allow_queued"), " (2-way)").otherwise(" (1-way)")
    kind = F.concat(decode("publication_type", PUBLICATION_TYPES), F.when(F.col("publication_type") == 0, two_way).otherwise(""))
    path = lambda *parts: F.concat_ws(" / ", *parts)
    node = lambda df, depth, what, p, label: df.select(F.lit(depth).alias("depth"), F.lit(what).alias("node"), p.alias("path"), label.alias("label"))
    pubs = publications.withColumn("_p", path("publisher", "publication"))
    keys = pubs.select("publication_id", "_p")
    n = articles.groupBy("publication_id").agg(F.count(F.lit(1)).alias("n"), F.sum("reserved_kb").alias("r"), F.sum("used_kb").alias("u"), F.sum("index_kb").alias("i"))
    size = lambda c: F.col(c).cast("string")
    counted = keys.join(n, "publication_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sizes = F.concat(size("n"), F.lit(" article(s)"), F.coalesce(F.concat(F.lit("; Reserved Space = "), size("r"), F.lit(" KB, Used Space = "), size("u"),
                                                                          F.lit(" KB, Index Space = "), size("i"), F.lit(" KB")), F.lit("")))
    label = F.concat("publication", F.lit(" (Publication ID: "), F.col("publication_id").cast("string"), F.lit("; Publication type: "), kind,
                     F.lit("; Publication database: "), "publication_db", F.lit(")"))
    people = subs.join(keys, "publication_id")
    rows = (node(publications.select("publisher").distinct(), 1, "publisher", F.col("publisher"), F.col("publisher"))
            .unionByName(node(pubs, 2, "publication", F.col("_p"), label))
            .unionByName(node(counted, 3, "articles", path("_p", F.lit("articles")), sizes))
            .unionByName(node(people, 3, "subscriber", path("_p", F.lit("subscribers"), "subscriber"),
                              F.concat("subscriber", F.lit(" (Subscription database: "), "subscription_db", F.lit(")")))))
    return rows.withColumn("line", F.concat(F.repeat(F.lit(" "), (F.col("depth") - 1) * 6 + 1), F.lit("|---- "), "label"))


# --- replicas --------------------------------------------------------------

def replica_health(states: DataFrame, key: str = "database_id") -> DataFrame:
    off = lambda c, good: F.sum(F.when(F.col(c) != good, 1).otherwise(0))
    return states.groupBy(key).agg(F.avg(F.col("secondary_lag_seconds") * 1.0).cast("double").alias("avg_lag_seconds"), off("synchronization_health", 2).alias("non_healthy"),
                                   off("database_state", 0).alias("non_online"), off("is_suspended", 0).alias("suspended"))


def replica_status(states: DataFrame, fabric: DataFrame, links: DataFrame) -> DataFrame:
    """Each replica state with its role and endpoint: of its own fabric replica, else of its link."""
    delay = boundaries("millisecond", "last_commit_time", "last_redone_time") / 1024.0
    return (states.join(fabric, "replica_id", "left").join(links, "group_database_id", "left")
            .withColumns({"replica_role": F.coalesce("fabric_role", "link_type"), "endpoint_url": F.coalesce("replication_endpoint_url", "partner_server"),
                          "last_redo_delay_sec": delay}))


def problem_replicas(states: DataFrame) -> DataFrame:
    return states.where((F.col("synchronization_health") != 2) | (F.col("database_state") != 0) | (F.col("is_suspended") == 1)
                        | ((F.col("synchronization_state") != 2) & F.col("is_commit_participant")))


def group_replicas(groups: DataFrame, replicas: DataFrame, states: DataFrame) -> DataFrame:
    return groups.join(replicas, "group_id").join(states, "replica_id")


def seeding(stats: DataFrame, operations: DataFrame | None = None) -> DataFrame:
    """Size, copied part and speed in whole MB, waits in whole seconds."""
    rows = stats if operations is None else stats.join(operations, "operation_id")
    mb = lambda c: int_div(int_div(c, 1024), 1024)
    return rows.withColumns({"database_mb": mb("database_size_bytes"), "transferred_mb": mb("transferred_size_bytes"), "mb_per_sec": mb("transfer_rate_bytes_per_second"),
                             "disk_wait_sec": int_div("disk_io_wait_ms", 1000), "network_wait_sec": int_div("network_wait_ms", 1000)})


def failover_events(events: DataFrame, xml: str = "event_data") -> DataFrame:
    """State changes of replicas that became primary."""
    e = parse_events(events, xml).where(entry("data", "current_state", "int") == 1)
    return e.select(F.col("event_time").alias("failover_time"), F.col("labels")["previous_state"].alias("previous_state"), F.col("labels")["current_state"].alias("current_state"),
                    F.col("data")["availability_group_name"].alias("group_name"), F.col("data")["availability_replica_name"].alias("new_primary"))
