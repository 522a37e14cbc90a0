"""From raw documents to packed sequences: toxicity, exact and near duplicates, benchmark passages, packing.

Every stage works on all rows of its predecessor. All but the last keep the columns of ``documents``.
A stage's result is to be written before the next stage of the same thread is called: that one removes the tables
which the stage before wrote on the way.

Defined results of the stages: null and empty texts score as such, are copies of each other, have no benchmark words, and pack to
their closing token; null ids stay as they are and never win over another id; repeated rows are copies; an empty
table gives an empty table; very long texts are read whole; columns besides id and text travel along, whatever their names.
"""

from __future__ import annotations

import threading
import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmetrics.llm import decontaminate, exact_dedup, packing, simhash, toxicity
from opsmetrics.llm.queries import table, tokenizer
from opsmetrics.session import checkpoint_dir, drop_tables, recorded

_state = threading.local()


def stage(fn):
    """Removes the tables of the stage before, whose result this one reads, and keeps account of its own."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, _state.__dict__.setdefault("tables", []))
        with recorded() as made:
            out = fn(spark, docs, sf_dir)
        _state.tables = made
        return out

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold, by a model trained on the labels of the rows that are not held out."""
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), docs.columns)
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("row.*")


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.distinct_rows(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near fingerprints, by the settings of the near-duplicate query."""
    return simhash.distinct_rows(docs)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), max_coverage=0)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A trained score, fingerprints and a tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read by the next."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, run_stage in STAGES:
        run_stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    drop_tables(spark, _state.tables)
    return docs
