"""Scalar column helpers: arithmetic, text, time and unit conversions.

Everything here returns a plain Column, so it stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000
# Units with a fixed length, in microseconds.
FIXED_UNITS = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": MICROS,
    "minute": 60 * MICROS,
    "hour": 3600 * MICROS,
}
BYTE_UNITS = {"kb": 1024.0, "mb": 1048576.0, "gb": 1073741824.0, "tb": 1099511627776.0}


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else (c if isinstance(c, Column) else F.lit(c))


# --- numbers ---------------------------------------------------------------

def fixed(value, scale: int) -> Column:
    """Round half up to ``scale`` decimals, as a double."""
    factor = 10.0 ** scale
    return F.floor(col(value).cast("double") * factor + 0.5) / F.lit(factor)


def safe_div(a, b, zero=None) -> Column:
    """``a / b``; a zero divisor gives ``zero`` (null by default) instead of an error."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(b == 0, F.lit(zero).cast("double")).otherwise(a / F.nullif(b, F.lit(0.0)))


def int_div(a, b, zero=None) -> Column:
    """Truncating division of whole numbers, guarded like :func:`safe_div`."""
    a, b = col(a).cast("bigint"), col(b).cast("bigint")
    quotient = F.call_function("div", a, F.nullif(b, F.lit(0).cast("bigint")))
    return F.when(b == 0, F.lit(zero).cast("bigint")).otherwise(quotient)


def pct(part, whole, scale: int | None = None, zero=None) -> Column:
    share = safe_div(100.0 * col(part).cast("double"), whole, zero)
    return share if scale is None else fixed(share, scale)


def int_avg(value) -> Column:
    """Average of whole numbers, truncated to a whole number."""
    value = col(value).cast("bigint")
    return int_div(F.sum(value), F.count(value))


def weighted_avg(value, weight) -> Column:
    """Sum of value times weight over the sum of weights."""
    value, weight = col(value), col(weight)
    return safe_div(F.sum(value * weight), F.sum(weight))


def has_flag(flags, mask: int) -> Column:
    flags = col(flags)
    return flags.bitwiseAND(F.lit(mask).cast("bigint")) == F.lit(mask)


# --- labels ----------------------------------------------------------------

COMPARE = {
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "==": lambda c, v: c == v,
}


def band(value, steps, otherwise=None, op: str = "<") -> Column:
    """First step whose comparison holds gives the label.

    ``steps`` is a list of ``(cut, label)``; a null value falls through to ``otherwise``.
    """
    return rules([(COMPARE[op](col(value), F.lit(cut)), label) for cut, label in steps], otherwise)


def rules(steps, otherwise=None) -> Column:
    """Ordered ``(condition, label)`` pairs, first match wins."""
    otherwise = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    out = None
    for condition, label in steps:
        label = label if isinstance(label, Column) else F.lit(label)
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(otherwise) if out is not None else otherwise


def decode(value, mapping: dict, default=None) -> Column:
    """Code to label; an unknown code gives ``default``."""
    value = col(value)
    return rules([(value == F.lit(code), label) for code, label in mapping.items()], default)


# --- matching --------------------------------------------------------------

def like(value, pattern: str, escape: str | None = None, ignore_case: bool = False) -> Column:
    """``%`` and ``_`` wildcards. Without ``escape`` every other character, a backslash too, stands for itself."""
    value = col(value)
    if ignore_case:
        value, pattern = F.lower(value), pattern.lower()
    # Spark's LIKE always has an escape character; one that the pattern lacks escapes nothing.
    unused = next(c for c in map(chr, range(1, 1 << 16)) if c not in pattern)
    return F.like(value, F.lit(pattern), F.lit(escape or unused))


def since(ts, n: int, unit: str, as_of) -> Column:
    """True for times at most ``n`` units before ``as_of``."""
    return col(ts) >= shift(as_of, unit, -n)


def optional_match(column, value) -> Column:
    """Equality filter that is switched off by an empty value."""
    return F.lit(True) if value in (None, "") else col(column) == F.lit(value)


# --- text ------------------------------------------------------------------

def text_len(value) -> Column:
    """Length without trailing blanks."""
    return F.length(F.rtrim(col(value)))


def mask_email(value, keep: int = 2, fill: int = 5) -> Column:
    """First ``keep`` characters, a fixed run of stars, then everything from the ``@``."""
    value = col(value)
    return F.concat(F.substring(value, 1, keep), F.lit("*" * fill),
                    F.substr(value, F.locate("@", value)))


def one_line(value, blank: str = "") -> Column:
    """Line breaks removed, or each replaced by ``blank``."""
    value = col(value)
    return F.replace(F.replace(value, F.lit("\n"), F.lit(blank)), F.lit("\r"), F.lit(blank))


def short_text(value, n: int, blank: str = "") -> Column:
    """Cut to ``n`` characters, then line breaks out."""
    return one_line(F.left(col(value), F.lit(n)), blank)


def slice_statement(text, start, end) -> Column:
    """Statement between two byte offsets of two-byte characters; end -1 is the end of text.

    No start is the beginning, no end is the end of text.
    """
    text, start, end = col(text), F.coalesce(col(start), F.lit(0)), F.coalesce(col(end), F.lit(-1))
    stop = F.when(end == -1, F.length(text) * 2).otherwise(end)
    return F.substr(text, (int_div(start, 2) + 1).cast("int"), (int_div(stop - start, 2) + 1).cast("int"))


def quote_name(value, quote: str = "[") -> Column:
    """Identifier in brackets (or another quote), with the closing mark doubled."""
    close = {"[": "]", "(": ")", "<": ">", "{": "}"}.get(quote, quote)
    return F.concat(F.lit(quote), F.replace(col(value), F.lit(close), F.lit(close * 2)), F.lit(close))


def path_drive(path, width: int = 2) -> Column:
    return F.left(F.upper(col(path)), F.lit(width))


def path_prefix(path, separator: str, nth: int) -> Column:
    """Part before the ``nth`` separator; the whole path when there are fewer."""
    return F.substring_index(col(path), separator, nth)


def pad_left(value, width: int, fill: str = "0") -> Column:
    """Pad to ``width``; longer values stay whole."""
    text = col(value).cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit(fill))


# --- dates and times -------------------------------------------------------

def instant_micros(ts) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def shift(ts, unit: str, n) -> Column:
    """Add ``n`` whole units."""
    return F.timestamp_add(unit.upper(), col(n).cast("int"), col(ts))


def boundaries(unit: str, a, b) -> Column:
    """Number of unit boundaries crossed from ``a`` to ``b``."""
    unit = unit.lower()
    a, b = col(a), col(b)
    if unit in FIXED_UNITS:
        size = F.lit(FIXED_UNITS[unit])
        return F.floor(instant_micros(b) / size) - F.floor(instant_micros(a) / size)
    days = F.datediff(b.cast("date"), a.cast("date")).cast("bigint")
    if unit == "day":
        return days
    if unit == "week":  # weeks start on Sunday; 1970-01-04 was the first one
        ordinal = lambda d: F.floor((F.unix_date(d.cast("date")) + 4) / 7)
        return ordinal(b) - ordinal(a)
    months = lambda d: (F.year(d) * 12 + F.month(d) - 1).cast("bigint")
    if unit == "month":
        return months(b) - months(a)
    if unit == "quarter":
        return F.floor(months(b) / 3) - F.floor(months(a) / 3)
    if unit == "year":
        return (F.year(b) - F.year(a)).cast("bigint")
    raise ValueError(f"unknown unit {unit}")


def age_years(born, as_of) -> Column:
    """Completed years."""
    born, as_of = col(born), col(as_of)
    birthday = lambda d: F.month(d) * 100 + F.dayofmonth(d)
    return (F.year(as_of) - F.year(born)
            - F.when(birthday(born) > birthday(as_of), 1).otherwise(0)).cast("bigint")


def int_datetime(day, time=0) -> Column:
    """yyyymmdd and hhmmss whole numbers to a timestamp; day 0 gives null."""
    day, time = col(day), col(time)
    digits = F.concat(day.cast("string"), pad_left(time, 6))
    return F.when(day != 0, F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss"))).cast("timestamp_ntz")


def hhmmss_seconds(packed) -> Column:
    """Packed HHMMSS duration to seconds."""
    packed = col(packed).cast("bigint")
    return (int_div(packed, 10000) * 3600 + int_div(packed % 10000, 100) * 60 + packed % 100)


def clock_text(packed) -> Column:
    """Packed HHMMSS to ``HH:MM:SS``; 100 hours and more keep all their digits."""
    packed = col(packed).cast("bigint")
    return F.concat_ws(":", pad_left(int_div(packed, 10000), 2), pad_left(int_div(packed % 10000, 100), 2), pad_left(packed % 100, 2))


def format_duration(value, style: str = "hms") -> Column:
    """Seconds (``hms``, ``words``) or milliseconds (``days``) to text.

    ``hms`` wraps at a day, as a clock does.
    """
    value = col(value).cast("bigint")
    text = lambda c: c.cast("string")
    if style == "hms":
        s = value % 86400
        return F.concat_ws(":", pad_left(int_div(s, 3600), 2), pad_left(int_div(s % 3600, 60), 2),
                           pad_left(s % 60, 2))
    if style == "words":
        return F.concat(text(int_div(value, 3600)), F.lit(" hour(s), "),
                        text(int_div(value % 3600, 60)), F.lit(" min, "), text(value % 60), F.lit(" sec"))
    if style == "days":
        s = int_div(value, 1000)
        return F.concat(pad_left(int_div(s, 86400), 2), F.lit(" "), format_duration(s, "hms"),
                        F.lit("."), pad_left(value % 1000, 3))
    raise ValueError(f"unknown style {style}")


def format_time(ts, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(col(ts), pattern)


def to_local(ts, zone: str) -> Column:
    """UTC wall clock to the wall clock of ``zone``, right on both sides of a clock change."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), col(ts).cast("timestamp_ntz"))


def ticks_to_time(ticks, now_ticks, now) -> Column:
    """Millisecond tick counter to wall clock, given the counter and the clock at one moment."""
    return F.timestamp_add("MILLISECOND", (col(ticks) - col(now_ticks)).cast("bigint"), col(now))


def is_date(text, pattern: str | None = None) -> Column:
    args = [col(text)] + ([F.lit(pattern)] if pattern else [])
    return F.try_to_timestamp(*args).isNotNull()


# --- units -----------------------------------------------------------------

def pages_to_kb(pages) -> Column:
    return col(pages) * 8


def pages_to_mb(pages, scale: int = 2) -> Column:
    return fixed(col(pages) * 8.0 / 1024, scale)


def bytes_to(size, unit: str = "mb", scale: int = 2) -> Column:
    return fixed(col(size) / BYTE_UNITS[unit], scale)


def hex_to_int(text) -> Column:
    """Hex digits, with or without ``0x``, to a whole number."""
    return F.conv(F.regexp_replace(F.lower(col(text)), "^0x", ""), 16, 10).cast("bigint")


def json_value(text, path: str, type_: str = "string") -> Column:
    return F.get_json_object(col(text), path).try_cast(type_)
