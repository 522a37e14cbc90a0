"""Event documents: one parse per row, then plain struct and map access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import col

# One event: named data and action entries, each with a value and maybe a label in text.
EVENT_SCHEMA = (
    "_name string, _timestamp string, "
    "data array<struct<_name: string, value: string, text: string>>, "
    "action array<struct<_name: string, value: string, text: string>>"
)
# Ring buffer record, read for host health, memory, login and connection records.
RECORD_SCHEMA = (
    "_id bigint, _type string, _time bigint, "
    "SchedulerMonitorEvent struct<SystemHealth: struct<SystemIdle: int, ProcessUtilization: int>>, "
    "ResourceMonitor struct<Notification: string, IndicatorsProcess: int, IndicatorsSystem: int>, "
    "MemoryRecord struct<AvailablePhysicalMemory: bigint, AvailableVirtualAddressSpace: bigint>, "
    "Error struct<SPID: bigint, ErrorCode: string, CallingAPIName: string, APIName: string>, "
    "ConnectivityTraceRecord struct<RecordType: string, RecordSource: string, Spid: int, "
    "RemoteHost: string, RemotePort: string, LocalPort: string, "
    "TdsBuffersInformation: struct<TdsInputBufferError: string, TdsOutputBufferError: string, "
    "TdsInputBufferBytes: string>, "
    "TdsDisconnectFlags: struct<PhysicalConnectionIsKilled: int, DisconnectDueToReadError: int, "
    "NetworkErrorFoundInInputStream: int, ErrorFoundBeforeLogin: int, SessionIsKilled: int, "
    "NormalDisconnect: int, NormalLogout: int>>"
)
CORRUPT = "_corrupt_record"


def parse_xml(text, schema: str) -> Column:
    """Permissive parse; text that is no document lands in ``_corrupt_record``."""
    return F.from_xml(col(text), f"{schema}, {CORRUPT} string",
                      {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})


def named(entries, part: str = "value") -> Column:
    """Map of entry name to one part; the first entry of a name counts."""
    entries = F.coalesce(col(entries), F.expr("cast(array() as array<struct<_name: string, value: string, text: string>>)"))
    pairs = F.transform(entries, lambda e: F.struct(e["_name"].alias("k"), e[part].alias("v")))
    seen = F.filter(pairs, lambda e: e["k"].isNotNull())
    first = F.filter(seen, lambda e, i: F.array_position(F.transform(seen, lambda x: x["k"]), e["k"]) == i + 1)
    return F.map_from_entries(first)


def parse_events(df: DataFrame, xml: str) -> DataFrame:
    """Adds event_name, event_time, data, labels, actions and the corrupt text, if any."""
    # The one-element explode keeps later filters and selections from repeating the parse.
    event = F.explode(F.array(parse_xml(xml, EVENT_SCHEMA)))
    return (df.withColumn("_event", event)
            .withColumn("event_name", F.col("_event._name"))
            .withColumn("event_time", F.col("_event._timestamp").try_cast("timestamp_ntz"))
            .withColumn("data", named("_event.data"))
            .withColumn("labels", named("_event.data", "text"))
            .withColumn("actions", named("_event.action"))
            .withColumn("corrupt", F.col(f"_event.{CORRUPT}"))
            .drop("_event"))


def entry(map_col: str, name: str, type_: str = "string") -> Column:
    value = F.col(map_col)[name]
    return value if type_ == "string" else value.try_cast(type_)


def xml_value(text, path: str, type_: str = "string") -> Column:
    """One value by path, for a single use. Parse once with parse_events for several."""
    found = F.xpath_string(col(text), F.lit(path))
    value = F.when(found != "", found).when(xml_exists(text, path), found)
    return value if type_ == "string" else value.try_cast(type_)


def xml_exists(text, path: str) -> Column:
    return F.xpath_boolean(col(text), F.lit(f"boolean({path})"))


def xml_query(text, tag: str) -> Column:
    """Text of the first element ``tag``, markup kept; null when there is none."""
    pattern = f"(?s)<{tag}(?:\\s[^>]*)?(?:/>|>.*?</{tag}>)"
    return F.nullif(F.regexp_extract(col(text), pattern, 0), F.lit(""))


def xml_elements(text, tag: str) -> Column:
    """Texts of all elements ``tag`` in document order, markup kept; one of them does not hold another."""
    pattern = f"(?s)<{tag}(?:\\s[^>]*)?(?:/>|>.*?</{tag}>)"
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0))


def xml_attributes(text) -> Column:
    """Map of the attributes in the text of a start tag; of a name that is given twice the first counts."""
    pair = r"""([A-Za-z_][\w.:-]*)\s*=\s*(?:"[^"]*"|'[^']*')"""
    value = r"""[A-Za-z_][\w.:-]*\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    names = F.regexp_extract_all(col(text), F.lit(pair), F.lit(1))
    double, single = (F.regexp_extract_all(col(text), F.lit(value), F.lit(i)) for i in (1, 2))
    entries = F.transform(names, lambda n, i: F.struct(n.alias("k"), _unescaped(F.concat(double[i], single[i])).alias("v")))
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(names, e["k"]) == i + 1))


#: Character references by name (fixed by the format); ``&amp;`` comes last.
_REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def _unescaped(text: Column) -> Column:
    for name, char in _REFERENCES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def explode_events(df: DataFrame, xml: str, tag: str = "event", schema: str = EVENT_SCHEMA,
                   outer: bool = False) -> DataFrame:
    """One row per ``tag`` element of a document that holds many.

    A document that does not parse gives one row with a null element and its text in ``corrupt``.
    """
    element = f"struct<{_as_fields(schema)}>"
    doc = F.from_xml(col(xml), f"{tag} array<{element}>, {CORRUPT} string",
                     {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    generator = F.explode_outer if outer else F.explode
    # The one-element explode keeps later steps from repeating the parse.
    parsed = df.withColumn("_doc", F.explode(F.array(doc))).withColumn("corrupt", F.col(f"_doc.{CORRUPT}"))
    listed = F.when(F.col("corrupt").isNotNull(), F.array(F.lit(None).cast(element))).otherwise(F.col(f"_doc.{tag}"))
    return parsed.withColumn(tag, generator(listed)).drop("_doc")


def _as_fields(schema: str) -> str:
    """Top-level ``name type`` pairs as ``name: type`` struct fields."""
    depth, fields, start = 0, [], 0
    for i, ch in enumerate(schema):
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and depth == 0:
            fields.append(schema[start:i])
            start = i + 1
    fields.append(schema[start:])
    return ", ".join(": ".join(f.strip().split(" ", 1)) for f in fields)
