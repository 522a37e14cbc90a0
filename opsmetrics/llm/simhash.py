"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

A fingerprint has 8 positional bytes. Two fingerprints that differ in at most 2 bits share at least 6 of
them, the guaranteed minimum. The index posts each distinct fingerprint under every set of 6 positions
with their bytes (28 postings), so two fingerprints meet in a posting exactly if their tally of shared
positional bytes reaches the minimum; no pair below it is ever formed. Members of a posting differ in
two bytes only, so a posting has at most 65,536 members whatever the input. They are verified by
flipping up to two bits, which costs 136 lookups a member and not a pair for each two members.

Copies are combined first: the index holds distinct fingerprints, and each component is labelled with
the smallest id of its documents by aggregation.

The index tallies by construction: a set of 6 positions is shared exactly if the tally is 6 or more, so no pair needs
to be counted first.

Defined results: a null or empty text has fingerprint 0 and links like any other; fewer words than a
shingle make one shingle; null ids never label a component that has another id; an empty table gives no
rows; very long texts are hashed whole, in pieces; other columns, whatever their names, only travel along.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .components import components, union_find

SEED = 42
BITS = 64
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: str | bytes | None, words: int = 3) -> int:
    """SimHash of the word shingles of ``text``, an unsigned 64-bit number."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    parts = data.lower().split()  # for bytes: A-Z and the six white space characters only
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    cuts = map(slice, starts[:n].tolist(), ends[len(parts) - n:].tolist())
    hashes = map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = np.fromiter(hashes, np.uint64, min(CHUNK, n - at)) if n - at > CHUNK else np.fromiter(hashes, np.uint64, n - at)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            found = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, words) for t in texts]
            out = np.array(found, np.uint64).view(np.int64)
            columns = {n: batch.column(n) for n in batch.schema.names if n != "text"}
            yield pa.RecordBatch.from_pydict(columns | {"fp": pa.array(out)})

    return run


def _flips(distance: int) -> np.ndarray:
    """All changes of 1 to ``distance`` bits of 16."""
    sets = chain.from_iterable(combinations(range(16), k) for k in range(1, distance + 1))
    return np.array([sum(1 << b for b in bits) for bits in sets], np.int64)


def _verify(kept: list[tuple[int, ...]], distance: int):
    """Edges inside each posting: from every member to the root of its links there."""
    flips = _flips(distance)
    rest = [tuple(p for p in range(8) if p not in positions) for positions in kept]

    def links(members: list[int]) -> Iterator[tuple[int, int]]:
        if len(members) == 2:
            if (members[0] ^ members[1]).bit_count() <= distance:
                yield members[0], members[1]
            return
        there = np.zeros(1 << 16, bool)
        values = np.array(sorted(members), np.int64)
        there[values] = True
        for flip in flips.tolist():
            other = values ^ flip
            hit = there[other] & (other > values)
            yield from zip(values[hit].tolist(), other[hit].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for which, common, members in zip(*(batch.column(n).to_pylist() for n in ("which", "common", "members"))):
                low, high = (8 * p for p in rest[which])
                whole = lambda m: common | (m & 255) << low | (m >> 8) << high  # noqa: B023, E731
                for member, root in union_find(links(members)).items():
                    if member != root:
                        a.append(whole(member))
                        b.append(whole(root))
            signed = [pa.array(np.array([x & (2**64 - 1) for x in v], np.uint64).view(np.int64)) for v in (a, b)]
            yield pa.RecordBatch.from_arrays(signed, names=["a", "b"])

    return run


def links(fingerprints: DataFrame, distance: int = 2) -> DataFrame:
    """Edges ``a, b`` that connect the distinct fingerprints (column ``fp``) within ``distance`` (1 or 2) bits."""
    if distance not in (1, 2):
        raise ValueError("the index serves distances of 1 and 2 bits")
    kept = list(combinations(range(8), 6))
    postings = []
    for which, positions in enumerate(kept):
        low, high = (p for p in range(8) if p not in positions)
        mask = sum(255 << 8 * p for p in positions)
        mask -= (mask >> 63) << 64  # as a signed number
        byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
        postings.append(F.struct(F.lit(which).alias("which"), F.col("fp").bitwiseAND(F.lit(mask).cast("bigint")).alias("common"),
                                 (byte(low) + byte(high) * 256).cast("int").alias("member")))
    posted = fingerprints.select(F.explode(F.array(*postings)).alias("p")).select("p.*")
    # A posting holds distinct members only, 65,536 at most. Those with one member are dropped before they are gathered.
    counted = posted.groupBy("which", "common").agg(F.collect_list("member").alias("members")).where(F.size("members") > 1)
    return counted.mapInArrow(_verify(kept, distance), "a bigint, b bigint")


def _printed(df: DataFrame, id_col: str, text_col: str, words: int, whole: bool) -> DataFrame:
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").alias("id"),
                     *[F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] * whole,
                     F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    fields = [T.StructField(f.name, f.dataType) for f in rows.schema if f.name != "text"]
    return materialise(rows.mapInArrow(_fingerprints(words), T.StructType([*fields, T.StructField("fp", T.LongType())])))


def _first_of_component(printed: DataFrame, distance: int) -> DataFrame:
    """Each distinct fingerprint with the first row of its component: smallest id, null ids last, then row number."""
    place = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("uid"))
    distinct = materialise(printed.groupBy("fp").agg(F.min(place).alias("first")))
    found = components(materialise(links(distinct.select("fp"), distance)))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.drop("first").join(firsts, "root").select("fp", "first")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """One row per row of ``df``: id, fingerprint, component_id, and whether it is the first of its component."""
    printed = _printed(df, id_col, text_col, words, whole=False)
    return printed.join(_first_of_component(printed, distance), "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.id").alias("component_id"), (F.col("uid") == F.col("first.uid")).alias("kept"))


def distinct_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """The first row of each component, with all its columns: smallest id, null ids last, then row number."""
    printed = _printed(df, id_col, text_col, words, whole=True)
    stay = _first_of_component(printed.drop("row"), distance).select(F.col("first.uid").alias("uid")).distinct()
    return printed.select("uid", "row").join(stay, "uid").select("row.*")
