"""Exact deduplication by a recursive (Grace) hash join of a table with itself.

1. Combine. Each input task keeps the texts it has seen in a small open-addressing table and passes a
   text on only the first time; later copies carry the row number of that first one. A full table is
   emptied, so memory is bounded and a copy may simply be passed on again. A text that a third of all
   rows share therefore leaves a task about once.
2. Partition. The texts passed on are shuffled by hash. Each task fills one open-addressing table that
   compares complete contents. Once it is full, texts that it does not hold go to spill files by the next
   bits of the hash, and each file is treated the same way. Every level settles a full table of texts, so
   the recursion ends for any distribution. Spill files are private to a task attempt and deleted by it,
   like Spark's own; a lost task starts over.
3. Count. Sizes and winners are summed per passed-on row, then per group, and go back along the same rows.
   No step gathers a group.

Defined results: long texts are read whole, and other columns, whatever their names, change nothing;
a null text counts as empty; texts are equal if identical after deleting the six white
space characters; of a group the row with the most code points stays, then the smallest id (null ids last),
then the first row read; repeated rows are group members like any other; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

WHITE_SPACE = " \t\n\x0b\x0c\r"
MEMORY = 64 << 20  # bytes of text in one table
FANOUT_BITS = 4


class ContentTable:
    """Open addressing with linear probing. Holds each distinct content once, with the number of its first row."""

    def __init__(self, memory: int):
        self.memory = memory
        self.clear()

    def clear(self) -> None:
        self.slots = [-1] * 1024
        self.entries: list[tuple[int, bytes, int]] = []
        self.used = 0

    @property
    def full(self) -> bool:
        return self.used >= self.memory

    def _slot(self, key: int, content: bytes) -> int:
        """The slot that holds the content, or the free one where it belongs."""
        slots, entries, mask = self.slots, self.entries, len(self.slots) - 1
        at = (key ^ (key >> 32)) & mask
        while (found := slots[at]) >= 0:
            entry = entries[found]
            if entry[0] == key and entry[1] == content:
                break
            at = (at + 1) & mask
        return at

    def find(self, key: int, content: bytes) -> int | None:
        found = self.slots[self._slot(key, content)]
        return None if found < 0 else self.entries[found][2]

    def add(self, key: int, content: bytes, row: int) -> None:
        if 2 * (len(self.entries) + 1) > len(self.slots):
            self.slots = [-1] * (4 * len(self.slots))
            entries, self.entries = self.entries, []
            for entry in entries:
                self._place(entry)
        self._place((key, content, row))
        self.used += len(content) + 64

    def _place(self, entry: tuple[int, bytes, int]) -> None:
        self.slots[self._slot(entry[0], entry[1])] = len(self.entries)
        self.entries.append(entry)


def settle(rows: Iterable[tuple[int, bytes, int]], memory: int, level: int = 0) -> Iterator[tuple[int, int]]:
    """(row, first row with the same content) for each (hash, content, row), in any order."""
    table, spilled = ContentTable(memory), None
    for key, content, row in rows:
        first = table.find(key, content)
        if first is None and not table.full:
            table.add(key, content, row)
            first = row
        if first is not None:
            yield row, first
            continue
        if spilled is None:
            spilled = [tempfile.TemporaryFile(prefix="grace-") for _ in range(1 << FANOUT_BITS)]
        part = (key >> (level * FANOUT_BITS % 60)) & ((1 << FANOUT_BITS) - 1)
        pickle.dump((key, content, row), spilled[part], pickle.HIGHEST_PROTOCOL)
    del table
    for file in spilled or ():
        with file:
            file.seek(0)
            yield from settle(_read(file), memory, level + 1)


def _read(file) -> Iterator[tuple[int, bytes, int]]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _combine(memory: int):
    """Adds ``rep``, the first row of this task with the same content, and empties the text of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable(memory)
        for batch in batches:
            keys, rows = batch.column("h").to_pylist(), batch.column("uid").to_pylist()
            texts, reps, firsts = batch.column("norm"), [], []
            for i, (key, row) in enumerate(zip(keys, rows)):
                content = texts[i].as_buffer().to_pybytes()
                first = table.find(key, content)
                if first is None:
                    if table.full:
                        table.clear()
                    table.add(key, content, row)
                reps.append(row if first is None else first)
                firsts.append(first is None)
            kept = pc.if_else(pa.array(firsts, pa.bool_()), texts, pa.scalar(None, texts.type))
            columns = {n: batch.column(n) for n in batch.schema.names} | {"norm": kept, "rep": pa.array(reps, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _grace(memory: int):
    schema = pa.schema([("rep", pa.int64()), ("gid", pa.int64())])

    def rows(batches):
        for batch in batches:
            texts = batch.column("norm")
            for i, (key, row) in enumerate(zip(batch.column("h").to_pylist(), batch.column("rep").to_pylist())):
                yield key, texts[i].as_buffer().to_pybytes(), row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for pair in settle(rows(batches), memory):
            out.append(pair)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return run


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    norm = F.translate(text, WHITE_SPACE, "")
    return df.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").alias("id"),
                     F.length(text).cast("bigint").alias("chars"), F.sha2(norm, 256).alias("sha"),
                     F.xxhash64(norm).alias("h"), norm.alias("norm"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def _combined(rows: DataFrame, memory: int) -> DataFrame:
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema] + [T.StructField("rep", T.LongType())])
    return rows.mapInArrow(_combine(memory), schema)


def _settled(combined: DataFrame, passed_on: DataFrame, memory: int) -> DataFrame:
    """``rep``, group_size and the row that stays (``best``) for every row passed on."""
    groups = materialise(passed_on.repartition("h").mapInArrow(_grace(memory), "rep bigint, gid bigint"))
    place = F.struct((-F.col("chars")).alias("longest"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("uid"))
    per_rep = combined.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("best"))
    per_group = groups.join(per_rep, "rep").groupBy("gid").agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))
    return groups.join(per_group, "gid").select("rep", "group_size", "best")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256."""
    combined = materialise(_combined(_rows(df, id_col, text_col).drop("row"), memory))
    settled = _settled(combined, combined.where("norm is not null").select("rep", "h", "norm"), memory)
    return combined.drop("norm", "h").join(settled, "rep").select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size",
        (F.col("uid") == F.col("best.uid")).alias("kept"), F.col("sha").alias("text_sha256"))


def distinct_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = MEMORY) -> DataFrame:
    """The rows of ``df`` that stay, one of each group, with all their columns."""
    combined = _combined(_rows(df, id_col, text_col), memory)
    # Whole rows are written, so the normalised text is made again where it is needed.
    combined = materialise(combined.withColumn("first", F.col("norm").isNotNull()).drop("norm", "sha"))
    text = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    passed_on = combined.where("first").select("rep", "h", F.translate(text, WHITE_SPACE, "").alias("norm"))
    stay = _settled(combined.drop("row"), passed_on, memory).select(F.col("best.uid").alias("uid")).distinct()
    return combined.select("uid", "row").join(stay, "uid").select("row.*")
