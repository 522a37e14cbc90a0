"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of the normalised test items. A document's words are streamed
through it while the length of the longest match that ends at each word is tracked. Where that length
reaches the window (10 words, or the whole of a shorter item) the words of the window are hit, and the
state tells which items have it.

The items are read by the driver in blocks of at most ``BLOCK_WORDS`` words, which bounds what is broadcast.
More items mean more passes over the documents, whose hits are merged per document. An item longer than a
block is cut into pieces that overlap by a window less one word, so no window is lost.

Before a document is streamed, runs of words that all occur in some item are found, and shorter runs than
the shortest window are passed over; no window can lie in them.

Defined results: long texts are read whole, and other columns, whatever their names, change nothing;
a null or empty text has no words and no hits; items without words have no windows; items
of one id are one item, and a null id is the empty string; repeated rows are judged alike; with no items
nothing is hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

WINDOW = 10
BLOCK_WORDS = 200_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: A-Z to lower case; every other ASCII character that is no letter or digit becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """All substrings of several word sequences, with the items that own each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items if words]
        for _, codes in coded:
            last = 0
            for code in codes:
                last = self._extend(last, code)
        self.shortest = min((min(len(codes), window) for _, codes in coded), default=window)
        self.owners: dict[int, set[str]] = {}
        self.whole: dict[int, list[tuple[int, str]]] = {}  # short items that end in a state: length and item
        for item, codes in coded:
            state = length = 0
            for code in codes:
                state, length = self.step(state, length, code)
                if length >= window:
                    self.owners.setdefault(self.holding(state, window), set()).add(item)
            if len(codes) < window:
                self.whole.setdefault(self.holding(state, len(codes)), []).append((len(codes), item))
        #: The nearest state on the suffix path, itself included, where a short item ends; -1 if none.
        self.near = [-1] * len(self.link)
        if self.whole:
            for state in sorted(range(len(self.link)), key=self.length.__getitem__):
                self.near[state] = state if state in self.whole else self.near[self.link[state]] if state else -1

    def _new(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, state: int, code: int, target: int) -> int:
        """The state for the shorter strings of ``target`` that follow ``state``; a copy if need be."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(code) == target:
            self.next[state][code] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, code: int) -> int:
        if code in self.next[last]:
            return self._split(last, code, self.next[last][code])
        new, state = self._new(self.length[last] + 1, {}, 0), last
        while state >= 0 and code not in self.next[state]:
            self.next[state][code] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, code, self.next[state][code])
        return new

    def step(self, state: int, length: int, code: int) -> tuple[int, int]:
        """State and length of the longest match after one more word."""
        while state and code not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if code in self.next[state]:
            return self.next[state][code], length + 1
        return 0, 0

    def holding(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of a longer match."""
        while state and self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit spans of word numbers (merged, half open), items hit, and the longest match seen."""
        codes = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (codes >= 0).view(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        longest = 0
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start < self.shortest:
                continue
            state = length = 0
            for at, code in enumerate(codes[start:end].tolist(), start + 1):
                state, length = self.step(state, length, code)
                hit = 0
                if length >= self.window:
                    hit = self.window
                    items |= self.owners[self.holding(state, hit)]
                ended = self.near[state]
                while ended >= 0:
                    for size, item in self.whole[ended]:
                        if size <= length:
                            hit = max(hit, size)
                            items.add(item)
                    ended = self.near[self.link[ended]] if ended else -1
                if hit:
                    longest = max(longest, length)
                    first = at - hit
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, at))
        return spans, items, longest


def item_blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items' words in blocks of bounded size."""
    block, held = [], 0
    step = max(block_words, window)
    rows = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    for item, text in rows.toLocalIterator():
        words = words_of(text.encode("utf-8", "surrogatepass"))
        for at in range(0, max(1, len(words) - window + 1), step):
            piece = words[at:at + step + window - 1]
            if block and held + len(piece) > block_words:
                yield block
                block, held = [], 0
            block.append((item, piece))
            held += len(piece)
    if block:
        yield block


_SCANNED = "n_words bigint, spans array<struct<first: bigint, last: bigint>>, items array<string>, longest bigint"


def _scan(broadcast, window: int):
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton(broadcast.value, window)
        for batch in batches:
            counts, spans, items, longest = [], [], [], []
            for text in batch.column("_text"):
                words = words_of(text.as_buffer().to_pybytes())
                found, owners, most = automaton.scan(words)
                counts.append(len(words))
                spans.append([{"first": a, "last": b} for a, b in found])
                items.append(sorted(owners))
                longest.append(most)
            columns = {n: batch.column(n) for n in batch.schema.names if n != "_text"}
            yield pa.RecordBatch.from_pydict(columns | {
                "n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, span),
                "items": pa.array(items, pa.list_(pa.string())), "longest": pa.array(longest, pa.int64())})

    return run


def scan(df: DataFrame, items: DataFrame, carry: list[str], text_col: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns in ``carry`` of each row as the struct ``row``, with n_words, hit spans, items and the longest match."""
    spark = df.sparkSession
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
                     F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    blocks = item_blocks(items, item_id, item_text, window, block_words)
    first, second = next(blocks, []), next(blocks, None)

    def scanned(of: DataFrame, block: list) -> DataFrame:
        fields = [T.StructField(f.name, f.dataType) for f in of.schema if f.name != "_text"]
        schema = T.StructType(fields + T.StructType.fromDDL(_SCANNED).fields)
        return of.mapInArrow(_scan(spark.sparkContext.broadcast(block), window), schema)

    if second is None:
        out = scanned(rows, first)
    else:  # one pass a block, merged by row
        numbered = materialise(rows.withColumn("_row", F.monotonically_increasing_id()))
        texts, parts = numbered.select("_row", "_text"), None
        for block in (b for some in ([first, second], blocks) for b in some):
            part = materialise(scanned(texts, block))
            parts = part if parts is None else parts.union(part)
        merged = parts.groupBy("_row").agg(
            F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"))
        empty = F.expr("cast(array() as array<struct<first: bigint, last: bigint>>)")
        joined = F.aggregate("spans", empty, lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["last"] >= s["first"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], s["last"]).alias("last")))),
        ).otherwise(F.concat(done, F.array(s))))
        out = numbered.drop("_text").join(merged.withColumn("spans", joined), "_row").drop("_row")
    return out.select("row", "n_words", "spans", "items", "longest")


def hit_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"])


def report(df: DataFrame, items: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """One row per row of ``df``: id, n_words, n_hit, n_items, items_sha256, contaminated, longest match."""
    found = scan(df, items, [id_col], **how).withColumn("n_hit", hit_words())
    return found.select(F.col("row").getField(id_col).alias(id_col), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"), "longest")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and what stands between them; one space is left instead."""
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(data)]
    out, at = [], 0
    for first, last in spans:
        out.append(data[at:places[first][0]].rstrip())
        at = places[last - 1][1]
    out.append(data[at:].lstrip())
    return b" ".join(p for p in out if p).decode("utf-8", "surrogatepass")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans").to_pylist()
        texts = [t if not s else without_spans(t, [(x["first"], x["last"]) for x in s])
                 for t, s in zip(batch.column("text").to_pylist(), spans)]
        yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "text": pa.array(texts, pa.string())})


def decontaminate(df: DataFrame, items: DataFrame, text_col: str = "text", max_coverage: float = 0.2, **how) -> DataFrame:
    """The rows of ``df`` without the spans they share with items.

    A row goes altogether if more than ``max_coverage`` of its words are hit; 0 rejects every row with a hit.
    Otherwise its hit spans are cut out of the text. Rows without hits stay as they are.
    """
    found = scan(df, items, df.columns, text_col=text_col, **how)
    kept = found.where(hit_words() <= F.lit(max_coverage) * F.col("n_words"))
    if max_coverage <= 0:
        return kept.select("row.*")
    cut = kept.select("row", "spans", F.col("row").getField(text_col).alias("text")).mapInArrow(
        _cut, T.StructType([T.StructField("row", kept.schema["row"].dataType), T.StructField("text", T.StringType())]))
    return cut.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns])
