"""Event reports: blocked processes, deadlock lists, long statements and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.scalars import int_div, to_local
from ..functions.xml import EVENT_SCHEMA, entry, explode_events, parse_events, xml_query


def or_na(column, blank_only: bool = False) -> Column:
    """Blank, or also null, shown as not available."""
    c = F.col(column) if isinstance(column, str) else column
    shown = F.when(c == "", V.NOT_AVAILABLE).otherwise(c)
    return shown if blank_only else F.coalesce(shown, F.lit(V.NOT_AVAILABLE))


def blocking_events(events: DataFrame, xml: str = "event_data", zone: str = "UTC", names: DataFrame | None = None) -> DataFrame:
    """Blocked process and deadlock events with local times; missing names show as not available.

    ``names`` may give object_id, schema_name and table_name.
    """
    report = F.nullif(F.regexp_extract(F.col(xml), r"(?s)<blocked-process-report[^>]*monitorLoop.*?</blocked-process-report>", 0), F.lit(""))
    e = parse_events(events, xml).withColumns({"_blocked": report, "_deadlock": xml_query(xml, "deadlock")})
    field = lambda name, t="string": F.when(F.col("event_name") == "blocked_process_report", entry("data", name, t))
    rows = e.select(
        *[c for c in events.columns if c != xml],
        F.when(F.col("_blocked").isNull(), "Deadlock").otherwise("Blocked Process").alias("report_type"),
        to_local("event_time", zone).alias("event_time"), or_na(F.col("actions")["client_app_name"], True).alias("client_app_name"),
        or_na(F.col("actions")["client_hostname"], True).alias("client_host_name"), field("database_name").alias("database_name"),
        field("object_id", "int").alias("object_id"), field("index_id", "int").alias("index_id"), int_div(field("duration", "bigint"), 1000).alias("duration_ms"),
        F.when(F.col("event_name") == "blocked_process_report", F.col("labels")["lock_mode"]).alias("lock_mode"),
        F.coalesce("_blocked", "_deadlock").alias("report"))
    if names is None:
        return rows
    return rows.join(names, "object_id", "left").withColumns({c: or_na(c) for c in ("schema_name", "table_name")})


def deadlocks(documents: DataFrame, xml: str = "target_data", n: int = 20, ring_buffer: bool = True) -> DataFrame:
    """Newest ``n`` deadlocks with their graph, from ring buffers or from single event documents."""
    if ring_buffer:
        piece = F.explode(F.regexp_extract_all(F.col(xml), F.lit(r'(?s)(<event\s[^>]*name="xml_deadlock_report".*?</event>)'), F.lit(1)))
        documents = documents.select(piece.alias("event_data"))
        xml = "event_data"
    e = parse_events(documents, xml).where("event_name = 'xml_deadlock_report'")
    return (e.select(F.col("event_time").alias("deadlock_time"), xml_query(xml, "deadlock").alias("deadlock_graph"), entry("data", "database_name").alias("database_name"))
            .orderBy(F.desc("deadlock_time"), "deadlock_graph").limit(n))


def event_report(events: DataFrame, fields: dict, xml: str = "event_data") -> DataFrame:
    """Chosen fields of every event; ``fields`` maps a column to (data, label or action; name; type)."""
    e = parse_events(events, xml)
    maps = {"data": "data", "label": "labels", "action": "actions"}
    keep = [c for c in events.columns if c != xml]
    return e.select(*keep, "event_name", "event_time", *[entry(maps[part], name, t).alias(c) for c, (part, name, t) in fields.items()])
