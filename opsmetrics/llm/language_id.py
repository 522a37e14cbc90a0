"""Language identification by Bayesian fusion of evidence.

* Text: counts of hashed three-byte sequences per language, summed over all labelled documents, give the
  likelihood of a text. Neighbouring sequences are not independent, so it is weighted by ``WEIGHT``.
* Declared language: how often pages of each language (by their text) declare it, smoothed.
* Host prior: languages per host, smoothed towards its domain, that towards the address suffix, that towards all
  rows. The counts come from one grouped aggregation that is rolled up level by level.

The posterior is the product of the three. The likelihood table has languages x ``BUCKETS`` numbers; it and the
languages, which are those of the labels, are all that goes through the driver.

Defined results: a null or empty text has a flat likelihood, so the other evidence decides; a missing
declaration says nothing; a null host shares the host ``''``; without labelled texts the language is null;
repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

BUCKETS = 1 << 14
WEIGHT = 0.2
SMOOTH = 5.0
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))
_MARKUP = re.compile(rb"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[a-zA-Z/!?][^>]*>", re.S | re.I)
_DECLARED = re.compile(rb"<html\b[^>]*?\slang\s*=\s*[\"']?\s*([a-zA-Z]{2,8})", re.I)


def sequences(text: bytes) -> np.ndarray:
    """Buckets of the three-byte sequences of a text, letters only, words framed by one space."""
    data = np.frombuffer(b" " + b" ".join(text.translate(_FOLD).split()) + b" ", np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.uint32)
    codes = data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]
    return (codes * np.uint32(2654435761)) >> np.uint32(32 - 14)


def plain(page: bytes) -> bytes:
    return _MARKUP.sub(b" ", page)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            held = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            held += np.bincount(sequences(text.as_buffer().to_pybytes()), minlength=BUCKETS)
    for lang, held in sums.items():
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used)), "bucket": pa.array(used.astype(np.int32)), "n": pa.array(held[used])})


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the logarithms of their sequence frequencies, from all labelled texts."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.collect()  # languages x BUCKETS at most
    langs = sorted({r["lang"] for r in got})
    table = np.full((len(langs), BUCKETS), 0.5)
    for r in got:
        table[langs.index(r["lang"]), r["bucket"]] += r["n"]
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _score(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray(broadcast.value.T)
        for batch in batches:
            declared, logs, best = [], [], []
            for text, markup in zip(batch.column("text"), batch.column("markup").to_pylist()):
                data = text.as_buffer().to_pybytes()
                found = _DECLARED.search(data) if markup else None
                declared.append(found[1].decode().lower() if found else None)
                codes = sequences(plain(data) if markup else data)
                used, n = np.unique(codes, return_counts=True)
                fit = WEIGHT * (n @ table[used]) if len(codes) and table.shape[1] else np.zeros(table.shape[1])
                logs.append(fit.tolist())
                best.append(int(fit.argmax()) if len(codes) and len(fit) else None)
            kept = {n: batch.column(n) for n in batch.schema.names if n not in ("text", "markup")}
            yield pa.RecordBatch.from_pydict(kept | {"declared": pa.array(declared, pa.string()), "fit": pa.array(logs, pa.list_(pa.float64())),
                                                     "best": pa.array(best, pa.int32())})

    return run


def _counts(langs: int):
    return F.array(*[F.sum(F.coalesce(F.col("best") == i, F.lit(False)).cast("double")) for i in range(langs)])


def _smoothed(counts: str, parent: str, m: float):
    """Counts of one level with ``m`` rows' worth of the level above."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, parent, lambda n, p: (n + m * p) / (total + m))


def _rolled_up(table: DataFrame, langs: int, *keys: str) -> DataFrame:
    return table.groupBy(*keys).agg(F.array(*[F.sum(F.col("n")[i]) for i in range(langs)]).alias("n"))


def identify(rows: DataFrame, langs: list[str], table: np.ndarray, smooth: float = SMOOTH) -> DataFrame:
    """``row``, lang, posterior, text_lang and declared for rows with ``row``, ``host``, ``text`` and ``markup``.

    ``markup`` tells that the text is HTML. ``host`` without a dot has no domain or suffix of its own.
    """
    sent = rows.sparkSession.sparkContext.broadcast(table)
    labels = F.split("host", r"\.")
    rows = rows.select("row", F.coalesce("host", F.lit("")).alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "markup")
    kept = [T.StructField("row", rows.schema["row"].dataType), T.StructField("host", T.StringType())]
    schema = T.StructType([*kept, *T.StructType.fromDDL("declared string, fit array<double>, best int").fields])
    scored = materialise(rows.mapInArrow(_score(sent), schema))
    n = len(langs)
    if not n:
        return scored.select("row", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"),
                             F.lit(None).cast("string").alias("text_lang"), "declared")
    names = F.array(*[F.lit(x) for x in langs])

    judged = scored.where("best is not null")
    size = F.size(labels)
    hosts = materialise(scored.groupBy("host").agg(_counts(n).alias("n")).withColumns({
        "domain": F.array_join(F.slice(labels, F.greatest(size - 1, F.lit(1)), F.least(size, F.lit(2))), "."),
        "suffix": F.when(size > 1, F.element_at(labels, -1)).otherwise(F.lit(""))}))
    every = _rolled_up(hosts, n).first()
    whole = [x or 0.0 for x in every["n"]] if every and every["n"][0] is not None else [0.0] * n
    overall = F.array(*[F.lit((x + 1.0) / (sum(whole) + n)) for x in whole])
    suffixes = _rolled_up(hosts, n, "suffix").withColumn("p", _smoothed("n", overall, smooth)).select("suffix", F.col("p").alias("sp"))
    domains = _rolled_up(hosts, n, "domain", "suffix").join(suffixes, "suffix").withColumn("dp", _smoothed("n", "sp", smooth)).select("domain", "suffix", "dp")
    priors = hosts.join(domains, ["domain", "suffix"]).withColumn("prior", _smoothed("n", "dp", smooth)).select("host", "prior")

    said = materialise(judged.where("declared is not null").groupBy("declared").agg(_counts(n).alias("n")))
    many = said.count()
    spoken = _rolled_up(said, n).first()["n"]
    totals = F.array(*[F.lit((x or 0.0) + many + 1.0) for x in spoken])
    declares = said.select("declared", F.zip_with("n", totals, lambda a, b: F.log((a + 1) / b)).alias("told"))

    out = scored.join(priors, "host", "left").join(declares, "declared", "left")
    flat = F.array_repeat(F.lit(0.0), n)
    evidence = F.zip_with(F.zip_with("fit", F.coalesce(F.transform("prior", lambda p: F.log(p)), F.transform(overall, lambda p: F.log(p))),
                                     lambda a, b: a + b), F.coalesce("told", flat), lambda a, b: a + b)
    out = out.withColumn("e", evidence).withColumn("top", F.array_max("e"))
    mass = F.aggregate("e", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    at = F.array_position("e", F.col("top")).cast("int")
    return out.select("row", F.element_at(names, at).alias("lang"), (1 / mass).alias("posterior"),
                      F.when(F.col("best").isNotNull(), F.element_at(names, F.col("best") + 1)).alias("text_lang"), "declared")
