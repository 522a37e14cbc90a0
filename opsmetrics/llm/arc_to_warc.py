"""Legacy web archives (ARC, versions 1 and 2) converted to WARC, and WARC read back.

1. Read ARC. An archive is a gzipped stream of lines that one task reads in order. Its version block names
   the fields of its header lines; a header line declares the length of the network document behind it. A task holds one
   record at a time.
2. Convert. A record's identifier is made of the archive's name and the record's place in it, so that a second run gives the
   same; the 14-digit date becomes a WARC date; a document with an HTTP header is a response, any other a resource; payload
   and block get SHA-1 digests. Of responses with equal payloads the first in order stays whole and the others
   revisit it. Digests decide that, payloads are not gathered; equal SHA-256 and length are taken as equal.
3. Write and read WARC with Spark's text sink and source: records end as the format wants, and each file
   starts with a warcinfo record.

Defined results: a shorter date stands for its first second, one that cannot be read for the archive's own, else for the year 1970;
a line that should be a header and is none is skipped; a document cut off by the end of its archive is kept and marked as
truncated; white space in a URL is percent-encoded, and a missing URL is written as ``-``; an archive that is not gzipped and
large enough to be split is refused. For tables: a null html is an empty payload, null keys come last in order, repeated
rows are records of their own, an empty table gives an empty archive; other columns, whatever their names, are not written.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, materialise

#: Header fields by version of the ARC format (fixed by the format).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Names of the fields by which a row's key travels through both formats.
KEY, REFERS_KEY = "X-Record-Key", "WARC-Refers-To-Key"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
CAPTURED = "20240101000000"
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(text: str) -> str | None:
    """``YYYYMMDDhhmmss``, or its first 4, 6, 8, 10 or 12 digits, as a WARC date."""
    if not re.fullmatch(r"(\d\d){2,7}", text):
        return None
    try:
        return dt.datetime.strptime(text + "00000101000000"[len(text):], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ").zfill(20)
    except ValueError:
        return None


class ArcHeaders:
    """Header lines of one archive, by the fields that its version block names."""

    def __init__(self):
        self.names, self.date = ARC_FIELDS[1].lower().split(), None

    def __call__(self, line: bytes) -> dict | None:
        text = line.decode("utf-8", "replace").rstrip("\r")
        if text.startswith("filedesc:"):
            values = text.split(" ")
            if len(values) < 5 or not values[-1].isdecimal():
                return None
            return {"url": values[0], "archive-date": values[2], "length": int(values[-1])}
        values = text.rsplit(" ", len(self.names) - 1)
        head = dict(zip(self.names, values))
        if len(values) != len(self.names) or not values[-1].isdecimal() or not head.get("archive-date", "").isdecimal():
            return None
        return head | {"length": int(values[-1])}

    def seen(self, head: dict, body: bytes) -> None:
        if not head["url"].startswith("filedesc:"):
            return
        lines = body.decode("utf-8", "replace").split("\n")
        version = lines[0].split(" ")[0]
        named = lines[1].strip() if len(lines) > 1 and lines[1].startswith("URL ") else ARC_FIELDS[2 if version == "2" else 1]
        self.names, self.date = named.lower().split(), warc_date(head["archive-date"])


class WarcHeaders:
    """Header lines of WARC records, up to the empty line behind them."""

    def __init__(self):
        self.fields: dict | None = None

    def __call__(self, line: bytes) -> dict | None:
        text = line.decode("utf-8", "replace").rstrip("\r")
        if self.fields is None:
            if text.startswith("WARC/"):
                self.fields = {}
        elif text:
            name, _, value = text.partition(":")
            self.fields[name.strip().lower()] = value.strip()
        else:
            fields, self.fields = self.fields, None
            return fields | {"length": int(fields.get("content-length", 0))}
        return None

    def seen(self, head: dict, body: bytes) -> None:
        pass


def records(lines: Iterator[tuple[str, bytes]], headers) -> Iterator[tuple]:
    """(file, headers, head, document, whether it is cut off) for the lines of archives, file by file."""
    file, state, head, held, got = None, None, None, [], 0
    for name, line in lines:
        if name != file:
            if head is not None:
                yield file, state, head, b"".join(held)[:-1], True
            file, state, head = name, headers(), None
        line += b"\n"
        while line:
            if head is None:
                head, held, got = state(line[:-1]), [], 0
                line = b""
            else:
                held.append(line)
                got += len(line)
                line = b""
            if head is not None and got >= head["length"]:
                body = b"".join(held)
                # What stands behind the document in its last line begins the next record.
                line, body = body[head["length"]:], body[:head["length"]]
                line = line if line.strip() else b""
                state.seen(head, body)
                yield file, state, head, body, False
                head = None
    if head is not None:
        yield file, state, head, b"".join(held)[:-1], True


def http_parts(document: bytes) -> tuple[bytes, bytes, dict] | None:
    """Header, body and header fields of an HTTP message; None for other documents."""
    if not document.startswith(b"HTTP/"):
        return None
    ends = [(at, n) for mark in (b"\r\n\r\n", b"\n\n") for at, n in [(document.find(mark), len(mark))] if at >= 0]
    at, n = min(ends) if ends else (len(document), 0)
    fields = {}
    for line in document[:at].decode("utf-8", "replace").splitlines()[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return document[:at + n], document[at + n:], fields


def _arc_record(file, state: ArcHeaders, head: dict, body: bytes, cut: bool, number: int) -> tuple:
    parts = http_parts(body)
    header, payload, fields = parts if parts else (b"", body, {})
    name = file.rsplit("/", 1)[-1]
    identifier = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{number}")
    date = warc_date(head["archive-date"]) or state.date or "1970-01-01T00:00:00Z"
    return (f"<urn:uuid:{identifier}>", head["url"], head.get("ip-address", ""), date, head.get("content-type", ""), parts is not None,
            fields.get(KEY.lower()), header, payload, len(payload), base32(payload), hashlib.sha256(payload).digest(),
            base32(body), base32(header), cut)


_ARC = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("content_type", pa.string()),
                  ("http", pa.bool_()), ("key", pa.string()), ("header", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                  ("payload_digest", pa.string()), ("sha256", pa.binary()), ("block_digest", pa.string()), ("header_digest", pa.string()),
                  ("truncated", pa.bool_())])
_WARC = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("date", pa.string()), ("url", pa.string()), ("key", pa.string()),
                   ("refers_to_id", pa.string()), ("refers_to_key", pa.string()), ("payload_bytes", pa.int64()),
                   ("payload_digest", pa.string()), ("intact", pa.bool_())])


def _warc_record(file, state, head: dict, body: bytes, cut: bool, number: int) -> tuple:
    kind, http = head.get("warc-type"), http_parts(body)
    header, payload, fields = http if http else (b"", body, {})
    declared = head.get("warc-payload-digest", "").removeprefix("sha1:")
    size, digest = len(payload), base32(payload)
    intact = not cut and head.get("warc-block-digest") == f"sha1:{base32(body)}"
    if kind == "revisit":  # the payload is elsewhere; its header still tells of it
        size, digest = int(fields.get("content-length", 0)), declared
    elif declared:
        intact = intact and declared == digest
    return (kind, head.get("warc-record-id"), head.get("warc-date"), head.get("warc-target-uri"), fields.get(KEY.lower()),
            head.get("warc-refers-to"), head.get(REFERS_KEY.lower()), size, digest, intact)


def _parse(headers, make, skip, schema: pa.Schema):
    def lines(batches):
        for batch in batches:
            if any(batch.column("part").to_pylist()):
                raise ValueError("an archive was split; archives must be gzipped")
            yield from zip(batch.column("file").to_pylist(), batch.column("line").to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, file, number = [], 0, None, 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
        for record in records(lines(batches), headers):
            number = number + 1 if record[0] == file else 0
            file = record[0]
            if skip(record[2]):
                continue
            held.append(make(*record, number))
            size += len(record[3])
            if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield pack()
                held, size = [], 0
        if held:
            yield pack()

    return run


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of archives with their file, in order within each."""
    m = F.col("_metadata")
    split = (m["file_block_start"] > 0) | (m["file_block_length"] < m["file_size"])
    return spark.read.option("lineSep", "\n").text(paths).select(
        m["file_path"].alias("file"), F.col("value").cast("binary").alias("line"), split.alias("part"))


def read_arc(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The records of ARC archives with identifiers, dates and digests as WARC has them."""
    skip = lambda head: head["url"].startswith("filedesc:")
    schema = ("record_id string, url string, ip string, date string, content_type string, http boolean, key string, header binary, payload binary, "
              "payload_bytes bigint, payload_digest string, sha256 binary, block_digest string, header_digest string, truncated boolean")
    return _lines(spark, paths).mapInArrow(_parse(ArcHeaders, _arc_record, skip, _ARC), schema)


def read_warc(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The records of WARC archives but warcinfo: type, id, date, url, keys, payload's size and digest, and whether digests agree."""
    skip = lambda head: head.get("warc-type") == "warcinfo"
    schema = ("record_type string, record_id string, date string, url string, key string, refers_to_id string, refers_to_key string, "
              "payload_bytes bigint, payload_digest string, intact boolean")
    return _lines(spark, paths).mapInArrow(_parse(WarcHeaders, _warc_record, skip, _WARC), schema)


def _first_in_file() -> Column:
    """True for the first row a task writes."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0


def write_arc(df: DataFrame, path: str, version: int, key_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One ARC record per row, with an HTTP header that carries the row's key."""
    html = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    key = F.to_json(F.struct(F.col(f"`{key_col}`").alias("key")))
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    for mark, code in ((" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D"), ("\x0b", "%0B"), ("\x0c", "%0C")):
        url = F.replace(url, F.lit(mark), F.lit(code))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"),
                    F.lit(f"\r\n{KEY}: "), F.col("key"), F.lit("\r\n\r\n"))
    rows = df.select(key.alias("key"), F.when(url == "", "-").otherwise(url).alias("url"), html.alias("html"))
    rows = rows.withColumn("document", F.concat(head, F.col("html")))
    middle = f"0.0.0.0 {CAPTURED} text/html" + (" 200 - - 0 -" if version == 2 else "")
    line = F.concat_ws(" ", "url", F.lit(middle), F.octet_length("document").cast("string"))
    about = f"{version} 0 opsmetrics\n{ARC_FIELDS[version]}\n"
    block = f"filedesc://archive.arc 0.0.0.0 {CAPTURED} text/plain{' 200 - - 0 -' if version == 2 else ''} {len(about)}\n{about}\n"
    record = F.concat(F.when(_first_in_file(), block).otherwise(""), line, F.lit("\n"), F.col("document"))
    rows.select(record.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def write_warc(records_: DataFrame, path: str) -> None:
    """WARC records of ``read_arc`` rows with ``first``, the record they revisit (record_id, url, date, key), or null."""
    revisit, line = F.col("first").isNotNull(), lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    given = lambda there, name, value: F.when(there, line(name, value)).otherwise("")
    block = F.concat(F.col("header").cast("string"), F.when(revisit, "").otherwise(F.col("payload").cast("string")))
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").when(F.col("http"), "response").otherwise("resource")),
        line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("url")),
        given(~F.col("ip").isin("", "-", "0.0.0.0"), "WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.when(revisit, F.col("header_digest")).otherwise(F.col("block_digest")))),
        given(F.col("truncated"), "WARC-Truncated", F.lit("unspecified")),
        given(revisit, "WARC-Profile", F.lit(PROFILE)),
        given(revisit, "WARC-Refers-To", F.col("first.record_id")),
        given(revisit, "WARC-Refers-To-Target-URI", F.col("first.url")),
        given(revisit, "WARC-Refers-To-Date", F.col("first.date")),
        given(revisit & F.col("first.key").isNotNull(), REFERS_KEY, F.col("first.key")),
        line("Content-Type", F.when(F.col("http"), "application/http; msgtype=response").otherwise(F.col("content_type"))),
        line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"))
    about = "software: opsmetrics\r\nformat: WARC File Format 1.0\r\n"
    info = ("WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:", f">\r\nWARC-Date: {warc_date(CAPTURED)}\r\n"
            f"Content-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n{about}\r\n\r\n")
    name = F.concat(F.lit(str(uuid.uuid4())[:24]), F.lpad(F.hex(F.spark_partition_id().cast("bigint")), 12, "0"))
    start = F.when(_first_in_file(), F.concat(F.lit(info[0]), F.lower(name), F.lit(info[1]))).otherwise("")
    out = records_.withColumn("block", block).select(F.concat(start, head, F.col("block")).alias("value"))
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def convert(spark: SparkSession, paths: list[str], out: str, order: list[Column] | None = None) -> None:
    """ARC archives to WARC archives in ``out``. ``order`` says which of equal payloads is the first: by date and identifier, if not given."""
    parsed = materialise(read_arc(spark, paths))
    order = order or [F.col("date")]
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("record_id"), F.col("url"), F.col("date"), F.col("key"))
    small = parsed.where("http").select("sha256", "payload_bytes", place.alias("place"))
    firsts = small.groupBy("sha256", "payload_bytes").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = small.join(materialise(firsts.drop("n")), ["sha256", "payload_bytes"]).where("place.record_id <> first.record_id")
    again = again.select("place.record_id", F.struct("first.record_id", "first.url", "first.date", "first.key").alias("first"))
    write_warc(parsed.join(materialise(again), "record_id", "left"), out)


def archive_pages(df: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows written as ARC archives of both versions, converted and read back: key, payload_bytes, payload_digest, record_type, refers_to."""
    spark, folder = df.sparkSession, f"{checkpoint_dir(df.sparkSession).rstrip('/')}/archive-{uuid.uuid4().hex}"
    version = F.pmod(F.xxhash64(F.col(f"`{key_col}`")), F.lit(2)) + 1
    for v in ARC_FIELDS:
        write_arc(df.where(version == v), f"{folder}/arc-{v}", v, key_col, url_col, html_col)
    kind = df.schema[key_col].dataType.simpleString()
    value = lambda c: F.from_json(c, f"key {kind}")["key"]
    convert(spark, [f"{folder}/arc-{v}" for v in ARC_FIELDS], f"{folder}/warc", [value(F.col("key")).isNull(), value(F.col("key"))])
    back = read_warc(spark, [f"{folder}/warc"])
    return back.select(value(F.col("key")).alias(key_col), "payload_bytes", "payload_digest", "record_type", value(F.col("refers_to_key")).alias("refers_to"))
