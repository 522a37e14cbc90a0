"""Deadlock documents as tables: processes, resources, and who owns or waits for what.

A document is parsed once; it is small, so lists inside it are handled in place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.xml import CORRUPT, xml_attributes, xml_elements
from ..session import materialise

#: Number of a deadlock within its document.
NUMBER = "deadlock_no"
PROCESS_FIELDS = ["id", "spid", "ecid", "status", "taskpriority", "logused", "waitresource", "waittime", "lockMode", "transactionname",
                  "lasttranstarted", "trancount", "clientapp", "hostname", "hostpid", "loginname", "isolationlevel", "currentdb", "sbid", "priority", "xactid"]
RESOURCE_FIELDS = ["id", "dbid", "objectname", "indexname", "hobtid", "associatedObjectId", "mode", "subresource"]


def attributes(names) -> str:
    return ", ".join(f"_{n}: string" for n in names)


_EDGE = "array<struct<_id: string, _mode: string, _requestType: string>>"
_SIDES = f"owner: {_EDGE}, waiter: {_EDGE}, `owner-list`: struct<owner: {_EDGE}>, `waiter-list`: struct<waiter: {_EDGE}>"
_FIELDS = f"_resource_kind: string, resource_attributes: string, {attributes(RESOURCE_FIELDS)}"
_PROCESS = (f"struct<{attributes(PROCESS_FIELDS)}, executionStack: struct<frame: array<struct<_procname: string, _line: string, _VALUE: string>>>, "
            "inputbuf: string>")


def _resources(fields: str) -> str:
    return f"`resource-list` struct<resource: array<struct<{fields}>>>"


_VICTIMS = "_victim string, `victim-list` struct<victimProcess: array<struct<_id: string>>>"
_PROCESSES = f"`process-list` struct<process: array<{_PROCESS}>>"
#: What of the processes decides on a document's error: a text field that holds elements does not parse.
_CHECKED = "`process-list` struct<process: array<struct<inputbuf: string>>>"
SCHEMA = f"{_VICTIMS}, {_PROCESSES}, {_resources(f'{_FIELDS}, {_SIDES}')}"
_PARTS = "(?:resource-list|owner-list|waiter-list|owner|waiter)"
# No part of these gives characters back: what follows a name or a value cannot begin within it.
_NAME = r"([A-Za-z_][\w.:-]*+)"
_OPEN = rf"""<(?!{_PARTS}[\s/>]){_NAME}((?:[^>"']++|"[^"]*"|'[^']*')*+)>"""
_EMPTY = rf"""<(?!{_PARTS}[\s/>]){_NAME}((?:[^>"'/]++|/(?!>)|"[^"]*"|'[^']*')*+)/>"""
_CLOSE = rf"</(?!{_PARTS}\s*>)[A-Za-z_][\w.:-]*+\s*>"


def resource_list(xml: Column) -> Column:
    return F.regexp_extract(xml, r"(?s)<resource-list\b[^>]*>.*?</resource-list>", 0)


def one_resource_tag(xml: Column, listed: Column) -> Column:
    """Every element of the resource list ``listed`` as ``resource``, its own name kept as an attribute, the text of all its attributes as an element.

    Any kind is then read by one schema, in document order.
    """
    opened = '<resource resource_kind="$1"$2><resource_attributes><![CDATA[$2]]></resource_attributes>'
    paired = F.regexp_replace(listed, _EMPTY, "<$1$2></$1>")
    named = F.regexp_replace(F.regexp_replace(paired, _CLOSE, "</resource>"), _OPEN, opened)
    return F.when(listed != "", F.replace(xml, listed, named)).otherwise(xml)


@dataclass
class DeadlockTables:
    """``graphs``: one row per deadlock. The rest carry the document id and the deadlock's number in it."""

    graphs: DataFrame
    processes: DataFrame
    resources: DataFrame
    edges: DataFrame


def tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+\n", "\n"), r"\n\s+", "\n"))


def label(spid: str = "spid", ecid: str = "ecid") -> Column:
    thread = F.when((F.coalesce(ecid, F.lit("")) != "") & (F.col(ecid) != "0"), F.concat(F.lit(" / ECID "), ecid)).otherwise("")
    return F.concat(F.lit("SPID "), F.coalesce(spid, F.lit("?")), thread)


def deadlock_tables(documents: DataFrame, doc_id: str, xml: str, keep: bool = True) -> DeadlockTables:
    """Shred each document's deadlock elements, whatever wraps them; ``deadlock_no`` counts them from 0.

    Documents without one, and elements that do not parse, stay in ``graphs`` with an error.
    With ``keep`` the parsed documents are written once and all tables read from there;
    without it every table that is used parses anew, and only what it shows.
    """
    key = [doc_id, NUMBER]
    found = xml_elements(xml, "deadlock")
    parts = documents.select(doc_id, F.posexplode_outer(found).alias("_no", "_part")).select(doc_id, F.coalesce("_no", F.lit(0)).alias(NUMBER), "_part")
    # A column of its own, so that it is searched for once.
    listed = parts.withColumn("_listed", resource_list(F.col("_part")))

    def read(schema: str) -> DataFrame:
        parsed = F.from_xml(one_resource_tag(F.col("_part"), F.col("_listed")), f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
        # The one-element explode keeps later filters and selections from repeating the parse.
        docs = listed.select("*", F.explode(F.array(parsed)).alias("_d"))
        error = (F.when(F.col("_part").isNull(), "no deadlock element").when(F.col(f"_d.{CORRUPT}").isNotNull(), "malformed document")
                 .when(F.col("_d.process-list").isNull(), "no process list"))
        if _VICTIMS not in schema:
            return docs.select(*key, error.alias("error"), "_d")
        ids = F.coalesce(F.transform(F.col("_d.victim-list.victimProcess"), lambda v: v["_id"]), F.array().cast("array<string>"))
        victims = F.array_distinct(F.filter(F.concat(ids, F.array("_d._victim")), lambda v: v.isNotNull() & (v != "")))
        return docs.select(*key, victims.alias("victim_ids"), error.alias("error"), "_d")

    written = materialise(read(SCHEMA)) if keep else None

    def parsed(*schema: str) -> DataFrame:
        return written if keep else read(", ".join(schema))

    graphs = parsed(SCHEMA)
    good = parsed(_VICTIMS, _PROCESSES).where("error is null")
    p = good.select(*key, "victim_ids", F.posexplode("_d.process-list.process").alias("process_index", "p"))
    frames = F.coalesce(F.transform("p.executionStack.frame", lambda f: tidy(f["_VALUE"])), F.array().cast("array<string>"))
    known = F.filter(frames, lambda s: (s != "") & (F.lower(s) != "unknown"))
    procs = F.coalesce(F.transform("p.executionStack.frame", lambda f: F.concat_ws(" ", f["_procname"], tidy(f["_VALUE"]))), F.array().cast("array<string>"))
    first = F.when(F.size(known) > 0, F.get(known, F.lit(0))).otherwise(F.get(frames, F.lit(0)))
    text = tidy(F.col("p.inputbuf"))
    processes = p.select(*key, "process_index", *[F.col(f"p._{n}").alias(n) for n in PROCESS_FIELDS],
                         F.array_contains("victim_ids", F.col("p._id")).alias("is_victim"),
                         F.coalesce(F.nullif(first, F.lit("")), text).alias("primary_sql"), text.alias("input_sql"), F.array_join(procs, " ").alias("frames"))

    def listed_resources(fields: str) -> DataFrame:
        good = parsed(_CHECKED, _resources(fields)).where("error is null")
        return good.select(*key, F.posexplode("_d.resource-list.resource").alias("resource_index", "r"))

    r = listed_resources(_FIELDS)
    resources = r.select(*key, "resource_index", F.col("r._resource_kind").alias("kind"), xml_attributes("r.resource_attributes").alias("attributes"), *[F.col(f"r._{n}").alias(n) for n in RESOURCE_FIELDS])
    none = F.array().cast(_EDGE)

    def side(role: str) -> Column:
        """Owners or waiters of each resource, from its list or directly below it."""
        found = F.concat(F.coalesce(F.col(f"r.{role}-list.{role}"), none), F.coalesce(F.col(f"r.{role}"), none))
        return F.transform(found, lambda e: F.struct(F.lit(role).alias("role"), e["_id"].alias("process_id"), e["_mode"].alias("mode"), e["_requestType"].alias("request_type")))

    # Both sides from one parse.
    edges = listed_resources(_SIDES).select(*key, "resource_index", F.explode(F.concat(side("owner"), side("waiter"))).alias("e")).select(*key, "resource_index", "e.*")

    return DeadlockTables(graphs.drop("_d"), processes, resources, edges)


def resource_label() -> Column:
    named = F.concat_ws(" • ", "kind", F.nullif("objectname", F.lit("")), F.nullif("indexname", F.lit("")))
    return named


def deadlock_summary(t: DeadlockTables, doc_id: str) -> DataFrame:
    """Counts per deadlock, the victims, who took part, and a text that says it."""
    key = [doc_id, NUMBER]
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))), ", ")
    p = t.processes.withColumn("label", label())
    per_p = p.groupBy(*key).agg(F.count(F.lit(1)).alias("processes"), joined("clientapp").alias("applications"), joined("hostname").alias("hosts"),
                                  F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("is_victim"), F.struct("process_index", "label")))), lambda v: v["label"]), ", ").alias("victims"))
    per_r = t.resources.groupBy(*key).agg(F.count(F.lit(1)).alias("resources"))
    per_e = t.edges.groupBy(*key).agg(F.count(F.lit(1)).alias("edges"), joined("mode").alias("lock_modes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    rows = (t.graphs.select(*key, F.size("victim_ids").cast("bigint").alias("victim_ids"), "error").join(per_p, key, "left").join(per_r, key, "left").join(per_e, key, "left")
            .withColumns({c: zero(c) for c in ("processes", "resources", "edges")}))
    said = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("not specified"))
    text = F.concat(F.when(F.coalesce("victims", F.lit("")) != "", F.concat(F.lit("Victim process(es): "), "victims")).otherwise("Victim process was not explicitly identified"),
                    F.lit(". Participants: "), F.col("processes").cast("string"), F.lit("; resources involved: "), F.col("resources").cast("string"),
                    F.lit(". Applications seen: "), said("applications"), F.lit(". Hosts seen: "), said("hosts"), F.lit(". Lock modes seen: "), said("lock_modes"), F.lit("."))
    return rows.withColumn("summary", F.when(F.col("error").isNull(), text))


def deadlock_edges(t: DeadlockTables, doc_id: str) -> DataFrame:
    """Who waits for whom: each waiter of a resource next to each of its owners."""
    deadlock = [doc_id, NUMBER]
    key = [*deadlock, "resource_index"]
    who = lambda role: (t.edges.where(F.col("role") == role).join(t.processes.select(*deadlock, F.col("id").alias("process_id"), label().alias("label")), [*deadlock, "process_id"], "left")
                        .select(*key, F.coalesce("label", "process_id").alias(role), F.col("mode").alias(f"{role}_mode")))
    return (t.resources.select(*key, resource_label().alias("resource")).join(who("waiter"), key).join(who("owner"), key))


def deadlock_filter(t: DeadlockTables, doc_id: str, text: str = "", role: str = "all") -> DataFrame:
    """Processes that hold ``text`` in any of their fields and have a role: victims, owners, waiters or all."""
    p = t.processes
    if text:
        fields = ["id", "spid", "clientapp", "hostname", "loginname", "waitresource", "lockMode", "primary_sql", "input_sql", "frames"]
        hay = F.lower(F.concat_ws(" ", *fields))
        p = p.where(F.contains(hay, F.lit(text.lower())))
    if role == "victims":
        return p.where("is_victim")
    if role in ("owners", "waiters"):
        part = t.edges.where(F.col("role") == role[:-1]).select(doc_id, NUMBER, F.col("process_id").alias("id")).distinct()
        return p.join(part, [doc_id, NUMBER, "id"], "left_semi")
    if role != "all":
        raise ValueError(f"unknown role {role}")
    return p
