"""Columns that are named like the operators' own change no result."""

import pytest
from pyspark.sql import functions as F

from opsmetrics.llm import decontaminate, exact_dedup, html_text, packing, sharding, simhash, substring_dedup, toxicity, url_filters
from opsmetrics.llm.queries import table, tokenizer

SF = "/root/testdata/sf0.001"
NAMES = ("uid id row norm h rep fp first last key n ids sha chars gid at part base kept score value place fine other host path url2 "
         "tokens label verdict rule size shard slot item hit words found data best").split()


def crowded(df):
    return df.withColumns({n: F.lit("x") for n in NAMES if n not in df.columns})


def rows(df, drop=()):
    return sorted(map(repr, (r.asDict() for r in df.drop(*NAMES, *drop).collect())))


OPERATORS = {
    "substring_dedup": lambda s, d, p: substring_dedup.repeated_passages(d),
    "decontaminate": lambda s, d, p: decontaminate.report(d, table(s, SF, "benchmark")),
    "toxicity": lambda s, d, p: toxicity.score(d, toxicity.train(table(s, SF, "documents"), table(s, SF, "labels")), ["doc_id"]).select("row.doc_id", F.round("score", 6).alias("s")),
    "sharding": lambda s, d, p: sharding.shard(d, shards=24).select("doc_id", "text_crc32"),
    "html_text": lambda s, d, p: html_text.main_text(p),
    "simhash": lambda s, d, p: simhash.near_duplicates(d).select("doc_id", "fingerprint", "component_id"),
    "simhash rows": lambda s, d, p: simhash.distinct_rows(d).select("doc_id", "text"),
    "packing": lambda s, d, p: packing.pack(d, tokenizer()).groupBy("doc_id").agg(F.sum("length").alias("t")),
    "exact_dedup": lambda s, d, p: exact_dedup.exact_groups(d).select("doc_id", "keep_id", "group_size", "text_sha256"),
    "exact_dedup rows": lambda s, d, p: exact_dedup.distinct_rows(d).select("doc_id", "text"),
    "url_filters": lambda s, d, p: url_filters.judge(p, url_filters.RULES).select("page_id", F.col("verdict").alias("v"), F.col("rule").alias("r")),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_other_columns(name, spark):
    docs, pages = table(spark, SF, "documents"), table(spark, SF, "pages")
    plain, full = OPERATORS[name](spark, docs, pages), OPERATORS[name](spark, crowded(docs), crowded(pages))
    assert rows(plain) == rows(full)
