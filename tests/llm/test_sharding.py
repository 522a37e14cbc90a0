"""Sharding against a plain Python version of the permutation."""

import struct
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from opsmetrics.llm.sharding import ROUNDS, permuted, shard

SCHEMA = "doc_id bigint, text string, size string, slot string"


def spark_hash(seed, k, x):
    h = xxhash.xxh64_intdigest(struct.pack("<q", seed), 42)
    # an int is hashed as 4 bytes, a long as 8
    h = xxhash.xxh64_intdigest(struct.pack("<i", k), h)
    return xxhash.xxh64_intdigest(struct.pack("<q", x), h)


def place(x, n, seed):
    bits = max(2, (n - 1).bit_length())
    high, low = bits // 2, bits - bits // 2
    while True:
        left, right = x >> low, x & ((1 << low) - 1)
        for k in range(ROUNDS):
            if k % 2 == 0:
                left ^= spark_hash(seed, k, right) & ((1 << high) - 1)
            else:
                right ^= spark_hash(seed, k, left) & ((1 << low) - 1)
        x = left << low | right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 5, 1000, 1025])
def test_permutation(spark, n):
    rows = spark.range(n).withColumn("p", permuted(F.col("id"), n, 7)).withColumn("back", permuted(F.col("p"), n, 7, backwards=True))
    got = sorted(rows.collect())
    assert [r["p"] for r in got] == [place(i, n, 7) for i in range(n)]
    assert sorted(r["p"] for r in got) == list(range(n))
    assert all(r["back"] == r["id"] for r in got)


def test_odd_rows(spark):
    data = [(None, None, "x", None), (1, "", None, None), (2, "ü" * 70_000, "a", "b")] + [(3, "same", "s", "t")] * 200 + [(3, "other", "", "")]
    got = shard(spark.createDataFrame(data, SCHEMA).repartition(5), shards=7).collect()
    assert len(got) == len(data)
    counts = {}
    for r in got:
        counts.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in data)


def test_same_for_any_partitioning_and_place_by_number(spark):
    data = [(i * 3 % 101, f"text {i}", None, None) for i in range(101)]
    df = spark.createDataFrame(data, SCHEMA)
    one, two = shard(df.repartition(3)).collect(), shard(df.coalesce(1)).collect()
    assert sorted(one) == sorted(two)
    assert {r["doc_id"]: r["slot"] * 24 + r["shard"] for r in one} == {i: place(i, 101, 0) for i in range(101)}


def test_empty(spark):
    assert shard(spark.createDataFrame([], SCHEMA)).count() == 0
