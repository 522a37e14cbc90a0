"""The operators applied to the given tables, next to the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, toxicity
from .arc_to_warc import archive_pages
from .conversation_trie import prefix_trie
from .decontaminate import report
from .exact_dedup import exact_groups
from .html_text import main_text
from .lexical_search import search
from .packing import pack
from .sharding import shard
from .simhash import near_duplicates
from .substring_dedup import repeated_passages
from .url_filters import RULES, host_of, judge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer() -> str:
    """The tokenizer file that the packing query uses; it lies at the same place on all machines."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_substring_dedup")
def op1(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))


#: Words of a text as op2 takes them; A-Z are folded one by one, other letters stay.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query("op2_decontaminate", f"""
    WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS k,
                    array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
             FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS r(i) WHERE len(w) > 0),
    docs AS (SELECT row_number() OVER () AS rn, doc_id, {_WORDS} AS w FROM documents),
    sizes AS (SELECT DISTINCT k FROM wins),
    grams AS (SELECT rn, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
              FROM docs, sizes, unnest(range(1, len(w) - k + 2)) AS r(i)),
    hits AS (SELECT DISTINCT g.rn, g.i, g.k, item_id FROM grams g JOIN wins USING (k, win)),
    found AS (SELECT rn, count(DISTINCT item_id) AS n_items,
                     string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY rn),
    covered AS (SELECT rn, count(DISTINCT pos) AS n_hit FROM hits, unnest(range(i, i + k)) AS r(pos) GROUP BY rn)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM docs LEFT JOIN found USING (rn) LEFT JOIN covered USING (rn)""")
def op2(spark, sf_dir):
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest")


@query("op3_toxicity")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("row.doc_id", toxicity.held_out("row.doc_id").alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op4_sharding")
def op4(spark, sf_dir):
    out = shard(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query("op5_html_text")
def op5(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))


@query("op6_simhash")
def op6(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).drop("kept")


@query("op7_packing")
def op7(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), tokenizer())


@query("op8_exact_dedup", r"""
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                      regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
    g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
                 count(*) OVER (PARTITION BY norm) AS group_size FROM d)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""")
def op8(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


@query("op9_language_id")
def op9(spark, sf_dir):
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    langs, likelihoods = language_id.train(docs)
    none = F.lit(None).cast("bigint")
    rows = docs.select(F.struct("doc_id", none.alias("page_id")).alias("row"), F.col("source").alias("host"), "text", F.lit(False).alias("markup"))
    rows = rows.union(pages.select(F.struct(none.alias("doc_id"), "page_id"), host_of(F.col("url")), "html", F.lit(True)))
    out = language_id.identify(rows, langs, likelihoods)
    return out.select("row.doc_id", "row.page_id", "lang", "posterior", "text_lang", "declared")


@query("op10_url_filters")
def op10(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"), RULES).withColumn("mined", F.array_join("mined", " "))


#: Distinct terms of a text as op11 takes them.
_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@query("op11_lexical_search", f"""
    WITH docs AS (SELECT row_number() OVER () AS rn, doc_id, {_TERMS} AS w FROM documents),
    sizes AS (SELECT rn, doc_id, len(w) AS n FROM docs WHERE len(w) > 0),
    counts AS (SELECT rn, term, count(*) AS tf FROM (SELECT rn, unnest(w) AS term FROM docs) GROUP BY rn, term),
    total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
    weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
                FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), total),
    items AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
    parts AS (SELECT item_id, rn, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS part
              FROM items JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (rn), total),
    scored AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM parts JOIN sizes USING (rn) GROUP BY item_id, rn, doc_id)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= 50""")
def op11(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _base32_sql(digest: str) -> str:
    """Base 32 of a hexadecimal number: five hexadecimal digits are four of these."""
    value = "CAST(instr('123456789abcdef', substr({0}, i + {1}, 1)) AS BIGINT)"
    five = " + ".join(f"{value.format(digest, k + 1)} * {16 ** (4 - k)}" for k in range(5))
    char = lambda shift: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((({five}) // {1 << shift}) % 32 AS INTEGER) + 1, 1)"
    return f"array_to_string(list_transform(range(0, 40, 5), lambda i: {' || '.join(char(s) for s in (15, 10, 5, 0))}), '')"


@query("op12_warc", f"""
    WITH p AS (SELECT row_number() OVER () AS rn, page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, row_number() OVER w AS place, first_value(page_id) OVER w AS first
          FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id NULLS LAST, rn))
    SELECT page_id, payload_bytes, {_base32_sql('hex')} AS payload_digest,
           CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN first END AS refers_to FROM d""")
def op12(spark, sf_dir):
    return archive_pages(table(spark, sf_dir, "pages"))


#: crc32 of a number's decimal digits, bit by bit.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda c: list_transform(range(8), lambda b: CAST((ascii(c) // CAST(pow(2, b) AS BIGINT)) % 2 AS BIGINT))))),
    lambda r, b: CASE WHEN xor(r, b) % 2 = 1 THEN xor(xor(r, b) // 2, CAST(3988292384 AS BIGINT)) ELSE xor(r, b) // 2 END), CAST(4294967295 AS BIGINT))"""


@query("op13_conversation_trie", f"""
    WITH raw AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS pos FROM raw),
    c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM raw)),
    rebuilt AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = base AND pos <= h
                UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
    turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d FROM rebuilt),
    paths AS (SELECT conv_id, d, list([role, text]) OVER (PARTITION BY conv_id ORDER BY d) AS path, strlen(text) AS bytes FROM turns
              UNION ALL SELECT conv_id, 0, [], 0 FROM c),
    lengths AS (SELECT conv_id, max(d) AS n FROM paths GROUP BY conv_id),
    nodes AS (SELECT min(conv_id) AS conv_id, d AS depth, path, count(*) AS n_convs, any_value(bytes) AS bytes,
                     coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = n), '') AS ends
              FROM paths JOIN lengths USING (conv_id) GROUP BY d, path),
    kids AS (SELECT p.depth, p.path, min(p.conv_id) AS parent, count(k.path) AS n_children FROM nodes p LEFT JOIN nodes k
             ON k.depth = p.depth + 1 AND k.path[1:p.depth] = p.path GROUP BY p.depth, p.path),
    below AS (SELECT x.depth, x.path, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves,
                     CAST(sum((y.n_convs - 1) * y.bytes) AS BIGINT) AS saved_tokens
              FROM nodes x JOIN nodes y ON y.depth >= x.depth AND y.path[1:x.depth] = x.path
              JOIN kids k ON k.depth = y.depth AND k.path = y.path GROUP BY x.depth, x.path)
    SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.parent AS parent_conv_id, n.n_convs, k.n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256
    FROM nodes n JOIN kids k ON k.depth = n.depth AND k.path = n.path JOIN below b ON b.depth = n.depth AND b.path = n.path
    LEFT JOIN kids p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]""")
def op13(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))
