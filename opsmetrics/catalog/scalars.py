"""Group H: scalar functions."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.xml import xml_exists, xml_query, xml_value
from .fixtures import events_as_of, fx, money, orders_as_of
from .registry import query


@query("h1_casts", """
SELECT l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) AS whole, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS exact,
       CAST(l_shipdate AS DATE) AS day, TRY_CAST(l_returnflag AS BIGINT) AS none FROM lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_partkey", F.col("l_quantity").cast("bigint").alias("whole"),
                             money("l_extendedprice").cast("string").alias("exact"), F.col("l_shipdate").cast("date").alias("day"),
                             F.col("l_returnflag").try_cast("bigint").alias("none"))


@query("h2_math", f"""
SELECT l_orderkey, l_partkey, {fx('l_extendedprice / 7', 3)} AS rounded, l_orderkey // 7 AS quotient, l_orderkey % 7 AS rest,
       abs(l_quantity - 25) AS distance, pow(l_linenumber, 2) AS squared, CAST(sign(l_quantity - 25) AS DOUBLE) AS side FROM lineitem""")
def _(t):
    off = F.col("l_quantity") - 25
    return t.lineitem.select("l_orderkey", "l_partkey", S.fixed(F.col("l_extendedprice") / 7, 3).alias("rounded"),
                             S.int_div("l_orderkey", 7).alias("quotient"), (F.col("l_orderkey") % 7).alias("rest"),
                             F.abs(off).alias("distance"), F.pow("l_linenumber", F.lit(2)).alias("squared"), F.signum(off).alias("side"))


@query("h3_safe_divide", """
SELECT l_orderkey, l_partkey, l_extendedprice / nullif(l_tax, 0) AS or_null, CASE WHEN l_discount = 0 THEN 0.0 ELSE l_tax / l_discount END AS or_zero FROM lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_partkey", S.safe_div("l_extendedprice", "l_tax").alias("or_null"),
                             S.safe_div("l_tax", "l_discount", 0).alias("or_zero"))


@query("h4_nulls", """
SELECT d.doc_id, coalesce(l.quality, -1) AS quality, nullif(d.lang, 'en') AS other_lang, coalesce(l.toxic, l.quality, 9) AS first_known
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _(t):
    return t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.nullif(F.col("lang"), F.lit("en")).alias("other_lang"),
        F.coalesce("toxic", "quality", F.lit(9)).alias("first_known"))


@query("h5_text", """
SELECT c_custkey, left(c_name, 3) AS l, right(c_name, 4) AS r, substring(c_name, 3, 6) AS mid, CAST(length(rtrim(c_name || '  ')) AS BIGINT) AS len,
       CAST(instr(c_name, '#') AS BIGINT) AS at, replace(c_name, 'Customer', 'CU') AS swapped, reverse(c_name) AS back, upper(c_name) AS up,
       lower(c_mktsegment) AS low, ltrim('  ' || c_mktsegment) AS trimmed FROM customer""")
def _(t):
    name = F.col("c_name")
    return t.customer.select(
        "c_custkey", F.left(name, F.lit(3)).alias("l"), F.right(name, F.lit(4)).alias("r"), F.substring(name, 3, 6).alias("mid"),
        S.text_len(F.concat(name, F.lit("  "))).cast("bigint").alias("len"), F.locate("#", name).cast("bigint").alias("at"),
        F.replace(name, F.lit("Customer"), F.lit("CU")).alias("swapped"), F.reverse(name).alias("back"), F.upper(name).alias("up"),
        F.lower("c_mktsegment").alias("low"), F.ltrim(F.concat(F.lit("  "), "c_mktsegment")).alias("trimmed"))


@query("h6_padding", """
SELECT o_orderkey, repeat('ab', CAST(o_orderkey % 4 AS INTEGER)) AS repeated, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS padded,
       left(o_orderpriority, 1) || ':' || substring(o_orderpriority, 3) AS stuffed FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", F.repeat(F.lit("ab"), (F.col("o_orderkey") % 4).cast("int")).alias("repeated"),
                           S.pad_left("o_orderkey", 8).alias("padded"),
                           F.overlay("o_orderpriority", F.lit(":"), F.lit(2), F.lit(1)).alias("stuffed"))


@query("h7_mask_email", """
SELECT c_custkey, left(e, 2) || '*****' || substring(e, instr(e, '@')) AS masked FROM (SELECT c_custkey, lower(c_name) || '@' || lower(c_mktsegment) || '.com' AS e FROM customer)""")
def _(t):
    email = F.concat(F.lower("c_name"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".com"))
    return t.customer.select("c_custkey", S.mask_email(email).alias("masked"))


@query("h8_short_text", """
SELECT doc_id, replace(replace(left(text, 255), chr(10), ''), chr(13), '') AS short_text FROM documents""")
def _(t):
    return t.documents.select("doc_id", S.short_text("text", 255).alias("short_text"))


@query("h9_statement_slice", """
SELECT doc_id, substring(text, CAST(s // 2 + 1 AS INTEGER), CAST((CASE WHEN e = -1 THEN length(text) * 2 ELSE e END - s) // 2 + 1 AS INTEGER)) AS statement
FROM (SELECT doc_id, text, 2 * (n_chars // 10) AS s, CASE WHEN lang = 'en' THEN -1 ELSE 2 * (n_chars // 2) END AS e FROM documents)""")
def _(t):
    start = S.int_div("n_chars", 10) * 2
    end = F.when(F.col("lang") == "en", -1).otherwise(S.int_div("n_chars", 2) * 2)
    return t.documents.select("doc_id", S.slice_statement("text", start, end).alias("statement"))


@query("h10_command_text", """
SELECT p_partkey, 'ALTER INDEX [' || replace(p_name || ']', ']', ']]') || '] ON [' || replace(p_type, ']', ']]') || '] REORGANIZE;' AS command FROM part""")
def _(t):
    return t.part.select("p_partkey", F.concat(F.lit("ALTER INDEX "), S.quote_name(F.concat("p_name", F.lit("]"))), F.lit(" ON "),
                                               S.quote_name("p_type"), F.lit(" REORGANIZE;")).alias("command"))


@query("h11_concat", """
SELECT d.doc_id, d.lang || '/' || CAST(l.quality AS VARCHAR) AS strict, concat_ws('/', d.lang, CAST(l.quality AS VARCHAR)) AS lenient
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _(t):
    quality = F.col("quality").cast("string")
    return t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", F.concat("lang", F.lit("/"), quality).alias("strict"), F.concat_ws("/", "lang", quality).alias("lenient"))


@query("h12_paths", """
SELECT page_id, left(upper(url), 2) AS drive, array_to_string(string_split(url, '/')[1:3], '/') AS site FROM pages""")
def _(t):
    return t.pages.select("page_id", S.path_drive("url").alias("drive"), S.path_prefix("url", "/", 3).alias("site"))


@query("h13_date_diff", """
SELECT o_orderkey, date_diff('month', o_orderdate, TIMESTAMP '2001-12-31') AS months, date_diff('day', o_orderdate, TIMESTAMP '2001-12-31') AS days,
       date_diff('year', o_orderdate, TIMESTAMP '2001-12-31') AS years, date_diff('quarter', o_orderdate, TIMESTAMP '2001-12-31') AS quarters,
       date_diff('hour', o_orderdate + INTERVAL 59 MINUTE, o_orderdate + INTERVAL 61 MINUTE) AS hours, o_orderdate + INTERVAL 90 SECOND AS later FROM orders""")
def _(t):
    now = orders_as_of()
    minutes = lambda n: S.shift("o_orderdate", "minute", n)
    return t.orders.select(
        "o_orderkey", S.boundaries("month", "o_orderdate", now).alias("months"), S.boundaries("day", "o_orderdate", now).alias("days"),
        S.boundaries("year", "o_orderdate", now).alias("years"), S.boundaries("quarter", "o_orderdate", now).alias("quarters"),
        S.boundaries("hour", minutes(59), minutes(61)).alias("hours"), S.shift("o_orderdate", "second", 90).alias("later"))


@query("h13_event_diff", """
SELECT event_id, date_diff('second', ts, TIMESTAMP '2024-01-31') AS seconds, date_diff('minute', ts, TIMESTAMP '2024-01-31') AS minutes,
       date_diff('millisecond', ts, TIMESTAMP '2024-01-31') AS millis, (DATE '2024-01-31' - DATE '1969-12-28') // 7 - (CAST(ts AS DATE) - DATE '1969-12-28') // 7 AS weeks FROM events""")
def _(t):
    now = events_as_of()
    return t.events.select("event_id", S.boundaries("second", "ts", now).alias("seconds"), S.boundaries("minute", "ts", now).alias("minutes"),
                           S.boundaries("millisecond", "ts", now).alias("millis"), S.boundaries("week", "ts", now).alias("weeks"))


@query("h14_date_parts", """
SELECT o_orderkey, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(year(o_orderdate) AS BIGINT) AS y,
       dayname(o_orderdate) AS name, true AS is_date, false AS not_date FROM orders""")
def _(t):
    date = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.dayofmonth(date).cast("bigint").alias("d"), F.month(date).cast("bigint").alias("m"),
                           F.year(date).cast("bigint").alias("y"), F.date_format(date, "EEEE").alias("name"),
                           S.is_date(date.cast("string")).alias("is_date"), S.is_date("o_orderpriority").alias("not_date"))


@query("h15_age", """
SELECT o_orderkey, CAST(floor((19970615 - CAST(strftime(o_orderdate, '%Y%m%d') AS INT)) / 10000.0) AS BIGINT) AS age FROM orders""")
def _(t):
    # Rows after the date have a negative age.
    return t.orders.select("o_orderkey", S.age_years("o_orderdate", F.lit("1997-06-15").cast("timestamp_ntz")).alias("age"))


@query("h16_int_datetime", """
SELECT o_orderkey, o_orderdate + to_seconds(o_orderkey % 86400) AS at FROM orders""")
def _(t):
    day = F.date_format("o_orderdate", "yyyyMMdd").cast("int")
    s = F.col("o_orderkey") % 86400
    time = S.int_div(s, 3600) * 10000 + S.int_div(s % 3600, 60) * 100 + s % 60
    return t.orders.select("o_orderkey", S.int_datetime(day, time).alias("at"))


@query("h17_packed_duration", """
SELECT o_orderkey, o_orderkey % 400000 AS seconds FROM orders""")
def _(t):
    s = F.col("o_orderkey") % 400000
    packed = S.int_div(s, 3600) * 10000 + S.int_div(s % 3600, 60) * 100 + s % 60
    return t.orders.select("o_orderkey", S.hhmmss_seconds(packed).alias("seconds"))


@query("h18_duration_text", """
SELECT o_orderkey, printf('%02d:%02d:%02d', (s % 86400) // 3600, s % 3600 // 60, s % 60) AS hms, s // 3600 || ' hour(s), ' || s % 3600 // 60 || ' min, ' || s % 60 || ' sec' AS words,
       printf('%02d %02d:%02d:%02d.%03d', s // 86400, (s % 86400) // 3600, s % 3600 // 60, s % 60, m % 1000) AS days
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS s, CAST(floor(o_totalprice) AS BIGINT) * 1000 + o_orderkey % 1000 AS m FROM orders)""")
def _(t):
    s = F.floor("o_totalprice")
    return t.orders.select("o_orderkey", S.format_duration(s, "hms").alias("hms"), S.format_duration(s, "words").alias("words"),
                           S.format_duration(s * 1000 + F.col("o_orderkey") % 1000, "days").alias("days"))


@query("h19_time_text", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS full, strftime(ts, '%d/%m/%Y') AS short FROM events""")
def _(t):
    return t.events.select("event_id", S.format_time("ts").alias("full"), S.format_time("ts", "dd/MM/yyyy").alias("short"))


@query("h20_local_time", """
SELECT event_id, ts - INTERVAL 5 HOUR AS new_york, ts + INTERVAL 330 MINUTE AS kolkata FROM events""")
def _(t):
    return t.events.select("event_id", S.to_local("ts", "America/New_York").alias("new_york"), S.to_local("ts", "Asia/Kolkata").alias("kolkata"))


@query("h20_summer_time", """
WITH x AS (SELECT o_orderkey, o_orderdate + to_seconds(o_orderkey % 86400) AS moment, make_date(year(o_orderdate), 4, 1) AS april,
                  make_date(year(o_orderdate), 10, 31) AS october FROM orders),
     y AS (SELECT *, april + CAST((7 - dayofweek(april)) % 7 AS INT) + INTERVAL 7 HOUR AS starts, october - CAST(dayofweek(october) AS INT) + INTERVAL 6 HOUR AS ends FROM x)
SELECT o_orderkey, CASE WHEN moment >= starts AND moment < ends THEN moment - INTERVAL 4 HOUR ELSE moment - INTERVAL 5 HOUR END AS new_york,
       moment + INTERVAL 330 MINUTE AS kolkata FROM y""")
def _(t):
    # Clock changes of the years in the data: first Sunday of April to last Sunday of October, at 2 o'clock there.
    at = t.orders.select("o_orderkey", F.expr("o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 86400)").alias("at"))
    return at.select("o_orderkey", S.to_local("at", "America/New_York").alias("new_york"), S.to_local("at", "Asia/Kolkata").alias("kolkata"))


@query("h21_ticks", """
SELECT event_id, TIMESTAMP '2024-01-31' - to_milliseconds(100000000 - event_id * 977) AS at FROM events""")
def _(t):
    return t.events.select("event_id", S.ticks_to_time(F.col("event_id") * 977, F.lit(100000000), events_as_of()).alias("at"))


@query("h22_units", f"""
SELECT doc_id, {fx('n_chars * 8.0 / 1024', 2)} AS mb, n_chars * 8 AS kb, {fx('n_chars / 1024.0', 2)} AS from_bytes FROM documents""")
def _(t):
    return t.documents.select("doc_id", S.pages_to_mb("n_chars").alias("mb"), S.pages_to_kb("n_chars").alias("kb"),
                              S.bytes_to("n_chars", "kb").alias("from_bytes"))


@query("h23_xml_value", """
SELECT event_id, CAST(user_id AS INTEGER) AS session_id, event_type AS name, CAST(NULL AS VARCHAR) AS absent FROM events""")
def _(t):
    return t.events_xml().select("event_id", xml_value("event_data", "/event/action[@name='session_id']/value", "int").alias("session_id"),
                                 xml_value("event_data", "/event/@name").alias("name"),
                                 xml_value("event_data", "/event/data[@name='absent']/value").alias("absent"))


@query("h24_xml_subtree", """
SELECT event_id, event_type = 'error' AS is_error, '<action name="session_id"><value>' || user_id || '</value></action>' AS subtree FROM events""")
def _(t):
    return t.events_xml().select("event_id", xml_exists("event_data", "/event[@name='error']").alias("is_error"),
                                 xml_query("event_data", "action").alias("subtree"))


@query("h25_hex", "SELECT o_orderkey, o_orderkey * 31 AS number FROM orders")
def _(t):
    digits = F.concat(F.lit("0x"), F.lower(F.hex(F.col("o_orderkey") * 31)))
    return t.orders.select("o_orderkey", S.hex_to_int(digits).alias("number"))


@query("h26_sequence_order", """
SELECT o_custkey, lpad(hex(max(o_orderkey)), 20, '0') AS last_seq, CAST(count(*) FILTER (o_orderkey > 255) AS BIGINT) AS after FROM orders GROUP BY 1""")
def _(t):
    # Binary numbers of one width compare byte by byte.
    seq = F.unhex(F.lpad(F.hex("o_orderkey"), 20, "0"))
    mark = F.unhex(F.lit("000000000000000000FF"))
    return (t.orders.select("o_custkey", seq.alias("seq")).groupBy("o_custkey")
            .agg(F.hex(F.max("seq")).alias("last_seq"), F.count_if(F.col("seq") > mark).alias("after")))


@query("h27_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.events.select("event_id", S.json_value("props", "$.k", "bigint").alias("k"))
