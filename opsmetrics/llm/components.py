"""Connected components of an edge table, by alternating star operations.

Each round replaces every node's links by links to the smallest node it sees, first towards larger
neighbours, then towards smaller ones; the table converges to one star per component in a number of
rounds that grows with the logarithm of the size. Each task first contracts its own edges with a
union-find over at most ``CHUNK`` edges, which removes most rounds. Links of a hub are combined by
``min`` before the shuffle and never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

CHUNK = 200_000


def union_find(pairs) -> dict:
    """Each node of ``pairs`` with the smallest node it is connected to."""
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in list(parent)}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []

    def stars():
        found = [(a, b) for a, b in union_find(held).items() if a != b]
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        held += zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())
        if len(held) >= CHUNK:
            yield stars()
            held = []
    if held:
        yield stars()


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Link each node's larger (or smaller) neighbours, and itself, to the smallest node it sees."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    linked = both.join(least, "a")
    moved = linked.where("b > a" if larger else "b < a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger:
        moved = moved.union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edge table (two bigint columns); root is the smallest node."""
    edges = edges.toDF("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialise(edges.mapInArrow(_contract, "a bigint, b bigint").distinct())
    last = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state[0] == 0 or state == last:
            break
        last = state
        wide = _stars(now, larger=True)
        now = materialise(_stars(wide, larger=False))
    tops = now.select(F.col("b").alias("a"), "b")
    return now.union(tops).distinct().select(F.col("a").alias("node"), F.col("b").alias("root"))
