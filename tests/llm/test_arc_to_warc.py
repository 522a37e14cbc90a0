"""Archives written, converted and read back; odd archives by hand."""

import base64
import gzip
import hashlib
import random

import pytest

from opsmetrics.llm.arc_to_warc import archive_pages, convert, read_arc, read_warc, warc_date

SCHEMA = "page_id bigint, url string, html string, key string, value string"


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def pages():
    pick = random.Random(4)
    texts = ["", None, "<p>é\r\n\r\n\n</p>\n", "\n", "\r\n\r\nWARC/1.0\r\n", "1 2 3 4 5\n" * 9, "x" * 3_000_000, *[f"<p>{i}" for i in range(40)]]
    rows = [(i, pick.choice(["http://a.b/ c", "", None, "ftp://x/\ny", "http://ü/"]), t) for i, t in enumerate(texts * 2)]
    return rows + [(500 + i, "http://hot", "<b>same</b>") for i in range(200)] + [(3, "u", "<p>0"), (3, "u", "<p>0"), (None, "u", "<p>1"), (None, "u", "lone"), (-5, "u", "\n")]


def test_round_trip(spark):
    rows = pages()
    got = archive_pages(spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA).repartition(6)).collect()
    least, n = {}, {}
    for i, _, t in rows:
        t = t or ""
        n[t] = n.get(t, 0) + 1
        least[t] = min(least.get(t, (True, 0)), (i is None, i or 0))
    whole = [t for t in least]
    assert len(got) == len(rows)
    assert sorted((r["page_id"] is None, r["page_id"] or 0, r["payload_bytes"], r["payload_digest"]) for r in got) == \
        sorted((i is None, i or 0, len((t or "").encode()), digest(t or "")) for i, _, t in rows)
    responses = [r for r in got if r["record_type"] == "response"]
    assert sorted(r["payload_digest"] for r in responses) == sorted(map(digest, whole))
    by_digest = {digest(t): least[t] for t in whole}
    for r in got:
        first = by_digest[r["payload_digest"]]
        if r["record_type"] == "response":
            assert (r["page_id"] is None, r["page_id"] or 0) == first and r["refers_to"] is None
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == (None if first[0] else first[1])


def test_empty_table(spark):
    assert archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0


ARC_1 = (b"filedesc://one.arc 0.0.0.0 19980102030405 text/plain 73\n1 0 someone\nURL IP-address Archive-date Content-type Archive-length\n\n"
         b"http://a/ 1.2.3.4 1998 text/html 42\nHTTP/1.0 200 OK\nContent-Type: a/b\n\nhello\n!\n\n"
         b"dns:a 1.2.3.4 19980231000000 text/dns 4\na\nb\n\n"
         b"no header at all\n"
         b"http://b/ 1.2.3.4 199802 text/html 0\n\n"
         b"http://c/ 1.2.3.4 19980203 text/html 100\nHTTP/1.0 200 OK\n\ncut")
ARC_2 = (b"filedesc://two.arc 0.0.0.0 20000101000000 text/plain 200 - - 0 two.arc 122\n2 0 someone\n"
         b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n\n"
         b"http://d/x y 5.6.7.8 20000102030405 text/html 200 abc - 0 two.arc 26\nHTTP/1.0 200 OK\r\n\r\nhello\n!\n")


def test_archives_by_hand(spark, tmp_path):
    size = lambda arc: len(arc.split(b"\n", 1)[1].split(b"\n\n", 1)[0]) + 1
    one, two = ARC_1.replace(b"plain 73", b"plain %d" % size(ARC_1)), ARC_2.replace(b"two.arc 122", b"two.arc %d" % size(ARC_2))
    for name, data in (("one", one), ("two", two)):
        (tmp_path / f"{name}.arc.gz").write_bytes(gzip.compress(data))
    paths = [str(tmp_path / "*.arc.gz")]
    rows = {r["url"]: r for r in read_arc(spark, paths).collect()}
    assert set(rows) == {"http://a/", "dns:a", "http://b/", "http://c/", "http://d/x y"}
    assert bytes(rows["http://a/"]["payload"]) == b"hello\n!" and rows["http://a/"]["date"] == "1998-01-01T00:00:00Z"
    assert bytes(rows["dns:a"]["payload"]) == b"a\nb\n" and not rows["dns:a"]["http"] and rows["dns:a"]["date"] == "1998-01-02T03:04:05Z"
    assert rows["http://b/"]["payload_bytes"] == 0 and rows["http://b/"]["date"] == "1998-02-01T00:00:00Z"
    assert rows["http://c/"]["truncated"] and bytes(rows["http://c/"]["payload"]) == b"cut"
    assert bytes(rows["http://d/x y"]["payload"]) == b"hello\n!"
    assert [r["record_id"] for r in read_arc(spark, paths).orderBy("url").collect()] == [rows[u]["record_id"] for u in sorted(rows)]
    convert(spark, paths, str(tmp_path / "warc"))
    back = {r["url"]: r for r in read_warc(spark, [str(tmp_path / "warc")]).collect()}
    assert set(back) == set(rows) and all(r["intact"] for r in back.values())
    assert back["dns:a"]["record_type"] == "resource" and back["http://a/"]["record_type"] == "response"
    again = back["http://d/x y"]
    assert again["record_type"] == "revisit" and again["refers_to_id"] == rows["http://a/"]["record_id"]
    data = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "warc").glob("*.gz"))
    assert data.count(b"WARC/1.0\r\n") == data.count(b"WARC-Type: warcinfo\r\n") + 5 and data.endswith(b"\r\n\r\n")
    assert b"WARC-IP-Address: 5.6.7.8\r\n" in data and b"WARC-Truncated: unspecified\r\n" in data


def test_split_archives_are_refused(spark, tmp_path):
    (tmp_path / "plain.arc").write_bytes(ARC_2 * 50)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        with pytest.raises(Exception, match="must be gzipped"):
            read_arc(spark, [str(tmp_path / "plain.arc")]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_dates():
    assert warc_date("20060102030405") == "2006-01-02T03:04:05Z" and warc_date("0999") == "0999-01-01T00:00:00Z"
    assert warc_date("20061") is None and warc_date("20061301") is None and warc_date("") is None
