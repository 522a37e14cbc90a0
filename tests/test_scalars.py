"""Golden values and boundaries of the scalar helpers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsmetrics.functions import scalars as S


@pytest.fixture(scope="module")
def one(spark):
    row = spark.range(1)
    return lambda *cols: tuple(row.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def test_numbers(one):
    assert one(S.fixed(F.lit(123.918392), 3)) == (123.918,)
    assert one(S.safe_div(F.lit(1), F.lit(0)), S.safe_div(F.lit(1), F.lit(0), 0), S.safe_div(F.lit(1), F.lit(4))) == (None, 0.0, 0.25)
    assert one(S.int_div(F.lit(-7), F.lit(2)), S.int_div(F.lit(7), F.lit(0)), S.int_div(F.lit(7), F.lit(0), 0)) == (-3, None, 0)


def test_bands_hit_exactly_on_the_cut(one):
    steps = [(5, "a"), (10, "b")]
    label = lambda v: S.band(F.lit(v).cast("double"), steps, "c")
    assert one(label(4.999), label(5.0), label(9.999), label(10.0), label(None)) == ("a", "b", "b", "c", "c")


def test_text(one):
    assert one(S.text_len(F.lit("SQL Functions   "))) == (13,)
    assert one(S.mask_email(F.lit("sara@aaa.com"))) == ("sa*****@aaa.com",)
    assert one(S.quote_name(F.lit("a]b")), S.quote_name(F.lit("a'b"), "'")) == ("[a]]b]", "'a''b'")
    assert one(S.slice_statement(F.lit("SELECT 1; SELECT 2"), F.lit(20), F.lit(-1))) == ("SELECT 2",)
    assert one(S.slice_statement(F.lit("SELECT 1; SELECT 2"), F.lit(0), F.lit(14))) == ("SELECT 1",)
    none = F.lit(None).cast("int")
    assert one(S.slice_statement(F.lit("SELECT 1; SELECT 2"), none, none)) == ("SELECT 1; SELECT 2",)
    assert one(S.slice_statement(F.lit("SELECT 1; SELECT 2"), F.lit(20), none)) == ("SELECT 2",)
    assert one(S.path_drive(F.lit("c:\\data\\x.mdf")), S.path_prefix(F.lit("a/b/c/d"), "/", 2)) == ("C:", "a/b")


def test_boundaries(one):
    a, b = ts("2024-01-01 00:59:59.999"), ts("2024-01-01 01:01:00")
    assert one(S.boundaries("hour", a, b), S.boundaries("minute", a, b), S.boundaries("second", a, b)) == (1, 2, 61)
    y = (ts("2023-12-31"), ts("2024-01-01"))
    assert one(*[S.boundaries(u, *y) for u in ("year", "quarter", "month", "day", "week")]) == (1, 1, 1, 1, 0)
    assert one(S.boundaries("week", ts("2024-01-06"), ts("2024-01-07"))) == (1,)
    assert one(S.boundaries("day", ts("2024-01-02"), ts("2024-01-01"))) == (-1,)


def test_age(one):
    born = ts("2000-02-29")
    assert one(S.age_years(born, ts("2001-02-28")), S.age_years(born, ts("2001-03-01")), S.age_years(born, ts("2000-02-29"))) == (0, 1, 0)


def test_packed_times(one):
    assert one(S.int_datetime(F.lit(20240131), F.lit(93005)), S.int_datetime(F.lit(0), F.lit(0))) == (dt.datetime(2024, 1, 31, 9, 30, 5), None)
    assert one(S.hhmmss_seconds(F.lit(12345)), S.hhmmss_seconds(F.lit(1000000))) == (5025, 360000)
    assert one(S.format_duration(F.lit(90061), "hms"), S.format_duration(F.lit(90061), "words")) == ("01:01:01", "25 hour(s), 1 min, 1 sec")
    assert one(S.format_duration(F.lit(90061007), "days")) == ("01 01:01:01.007",)


def test_local_time_across_a_clock_change(one):
    assert one(S.to_local(ts("2024-07-01 12:00:00"), "America/New_York"), S.to_local(ts("2024-01-01 12:00:00"), "America/New_York")) == (
        dt.datetime(2024, 7, 1, 8), dt.datetime(2024, 1, 1, 7))


def test_ticks_and_hex(one):
    assert one(S.ticks_to_time(F.lit(0), F.lit(5_000_000_000), ts("2024-03-01"))) == (dt.datetime(2024, 3, 1) - dt.timedelta(milliseconds=5_000_000_000),)
    assert one(S.hex_to_int(F.lit("0x139F")), S.has_flag(F.lit(6), 2), S.has_flag(F.lit(6), 3)) == (5023, True, False)


def test_like(one):
    assert one(S.like(F.lit("LCK_M_S"), "LCK\\_%", "\\"), S.like(F.lit("LCKXM"), "LCK\\_%", "\\"), S.like(F.lit("a%b"), "a!%b", "!"), S.like(F.lit("AB"), "a_", ignore_case=True)) == (True, False, True, True)


def test_backslashes_are_plain_and_padding_never_cuts(spark):
    from pyspark.sql import functions as F

    from opsmetrics.functions import scalars as S

    df = spark.createDataFrame([("CORP\\alice", "D:\\data"), ("CORPalice", "D:data")], "login string, path string")
    found = df.select(S.like("login", "CORP\\%").alias("a"), S.like("login", "CORP\\alice").alias("b"), S.like("path", "D:\\%").alias("c"))
    assert [tuple(r) for r in found.collect()] == [(True, True, True), (False, False, False)]
    escaped = spark.range(1).select(S.like(F.lit("a_c"), "a!_c", escape="!").alias("x"), S.like(F.lit("abc"), "a!_c", escape="!").alias("y"))
    assert tuple(escaped.first()) == (True, False)
    one = spark.range(1).select(S.pad_left(F.lit(1234), 2).alias("p"), S.clock_text(F.lit(1003015)).alias("c"),
                                S.format_duration(F.lit(120 * 86400 * 1000), "days").alias("d")).first()
    assert tuple(one) == ("1234", "100:30:15", "120 00:00:00.000")
