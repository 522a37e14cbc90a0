"""Ranked lexical search of many queries at once by shared subexpressions.

1. Terms of the items are counted over all documents: how many hold a term, how many terms all documents have.
2. Mine. Items are taken in blocks of at most about ``BLOCK`` terms. Each item is a list of terms, most frequent first and
   terms of the same items side by side. Neighbours that two or more items have become a node, lists are put in
   order again, and so on until no neighbours are shared. The nodes form a query-sharing DAG over the terms: a node is
   the sum of two others, and an item the sum of the few nodes left in its list. Work grows with the terms of a block.
3. Score. Each task reads its documents once a block. For a batch of documents every term's accumulator is made
   once, then every node's from its two parts, then the items' sums. All are whole numbers, so sharing
   changes no score. A task keeps the best rows of each item; those of all tasks are ranked in two steps.

The driver holds the terms and the DAG of one block, never anything of documents. An item with more terms than a block
makes a block larger by its own size only. A long text is counted in pieces of ``PIECE`` bytes.

Defined results: a document without terms (null, empty) is not counted and not found; an item without terms gives
no rows; rows with one item id are one item with the terms of all of them; rows that repeat a document id are
documents of their own; of equal scores the smaller id comes first, null last; empty tables give no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise

TOP = 50
BLOCK = 200_000  # terms of the items that are evaluated together
PIECE = 1 << 20
MEMORY = 48 << 20  # bytes of accumulators in a task
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Bytes of terms as they are, A-Z folded, all others to spaces.
_TABLE = bytes(c if c in _KEEP or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xFF]")


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces that end between two terms."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end].translate(_TABLE).split()
        at = end


def share(items: list[list[int]]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Nodes as pairs of terms or earlier nodes, numbered after the terms, and each item as a list of terms and nodes."""
    size = 1 + max((t for item in items for t in item), default=-1)
    nodes: list[tuple[int, int]] = []
    while True:
        where: dict[int, list[int]] = {}
        for i, item in enumerate(items):
            for t in item:
                where.setdefault(t, []).append(i)
        order = {t: (-len(found), found, t) for t, found in where.items()}
        items = [sorted(item, key=order.__getitem__) for item in items]
        counts = Counter(pair for item in items for pair in zip(item, item[1:]))
        names: dict[tuple[int, int], int] = {}
        merged = []
        for item in items:
            out, i = [], 0
            while i < len(item):
                n = counts[tuple(item[i:i + 2])] if i + 1 < len(item) else 0
                if n > 1 and (i + 2 == len(item) or counts[item[i + 1], item[i + 2]] <= n):
                    out.append(names.setdefault((item[i], item[i + 1]), size + len(nodes) + len(names)))
                    i += 2
                else:
                    out.append(item[i])
                    i += 1
            merged.append(out)
        if not names:
            return nodes, items
        nodes += names
        items = merged


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, found = [], []
        for i, text in enumerate(batch.column("text")):
            own = {t for part in terms_of(text.as_buffer().to_pybytes()) for t in part}
            rows += [i] * len(own)
            found += own
        yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(rows, pa.int64())), pa.array(found, pa.binary())],
                                         names=["item", "term"])


class Vocabulary:
    """Counts of a block's terms in texts."""

    def __init__(self, terms: list[bytes]):
        self.size, self.ids = len(terms), {t: i + 1 for i, t in enumerate(terms)}

    def __call__(self, text: bytes) -> tuple[np.ndarray, int]:
        """Occurrences of each term, and the number of all terms."""
        counts, total = np.zeros(self.size, np.int64), 0
        for part in terms_of(text):
            total += len(part)
            codes = np.fromiter(map(self.ids.get, part, repeat(0)), np.int64, len(part))
            counts += np.bincount(codes, minlength=self.size + 1)[1:]
        return counts, total


def _count(terms: list[bytes]):
    """Per task: documents that hold each term; documents (-1) and terms (-2) in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(terms)
        held, docs, total = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for text in batch.column("text"):
                counts, n = words(text.as_buffer().to_pybytes())
                held += counts > 0
                docs += n > 0
                total += n
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((at, [-1, -2])), pa.int64()),
                                          pa.array(np.concatenate((held[at], [docs, total])), pa.int64())], names=["term", "n"])

    return run


def _scores(terms: list[bytes], weights: list[int], docs: int, total: int, nodes: list[tuple[int, int]], items: list[list[int]], top: int):
    """The ``top`` rows of each item among the documents of a task."""
    size = len(terms) + len(nodes)
    lists = [np.array(item, np.int64) for item in items]

    def accumulate(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Scores by item and document."""
        m = 50 + (50 * lengths * docs) // total
        row, term = np.nonzero(counts)
        tf = counts[row, term]
        made = np.zeros((size, len(counts)), np.int64)
        made[term, row] = np.array(weights, np.int64)[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
        for k, (a, b) in enumerate(nodes, len(terms)):
            np.add(made[a], made[b], out=made[k])
        return np.stack([made[item].sum(axis=0) for item in lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, step = Vocabulary(terms), max(16, min(2000, MEMORY // (8 * size)))
        best: list[list[tuple]] = [[] for _ in items]
        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                part = part.take(pc.sort_indices(part.column("id"), null_placement="at_end"))
                ids = part.column("id").to_pylist()
                found = [words(t.as_buffer().to_pybytes()) for t in part.column("text")]
                lengths = np.array([n for _, n in found], np.int64)
                if not lengths.any():
                    continue
                scores = accumulate(np.stack([c for c, _ in found]), lengths)
                for held, row in zip(best, scores):
                    least = -held[-1][0] if len(held) == top else 1
                    at = np.flatnonzero(row >= max(least, 1))
                    if len(at):  # in order of ids, so a stable sort puts ties right
                        at = at[np.argsort(-row[at], kind="stable")[:top]]
                        held += [(-int(row[i]), ids[i] is None, ids[i]) for i in at.tolist()]
                        held.sort(key=lambda x: x if x[2] is not None else (x[0], True))
                        del held[top:]
        if kind is not None:
            rows = [(i, -s, doc) for i, held in enumerate(best) for s, _, doc in held]
            item, score, doc = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(score, pa.int64()), pa.array(doc, kind)],
                                             names=["number", "score", "id"])

    return run


def _best(rows: DataFrame, by: list[str], top: int) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text",
           top: int = TOP, block: int = BLOCK) -> DataFrame:
    """The ``top`` documents of each item: item id, rank, document id, score."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text")
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), text)
    wanted = items.select(F.col(f"`{item_id}`").alias("item"), text)
    item_kind, doc_kind = wanted.schema["item"].dataType.simpleString(), texts.schema["id"].dataType.simpleString()
    pairs = materialise(wanted.mapInArrow(_distinct_terms, f"item {item_kind}, term binary").distinct())
    blocks = -(-pairs.count() // block)
    out = docs.sparkSession.createDataFrame([], f"item {item_kind}, rank int, id {doc_kind}, score bigint")
    for which in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == which).collect()
        if not own:
            continue
        terms = sorted({bytes(r["term"]) for r in own})
        number = {t: i for i, t in enumerate(terms)}
        lists: dict = {}
        for r in own:
            lists.setdefault(r["item"], []).append(number[bytes(r["term"])])
        counts = {r["term"]: r["n"] for r in texts.select("text").mapInArrow(_count(terms), "term bigint, n bigint")
                  .groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n_docs, total = counts.get(-1, 0), counts.get(-2, 0)
        if not n_docs:
            break
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts.get(i, 0) + 1))) for i in range(len(terms))]
        nodes, sums = share(list(lists.values()))
        rows = texts.mapInArrow(_scores(terms, weights, n_docs, total, nodes, sums, top), f"number bigint, score bigint, id {doc_kind}")
        some = _best(rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64))), ["number", "part"], top).drop("rank", "part")
        names = docs.sparkSession.createDataFrame(list(enumerate(lists)), f"number bigint, item {item_kind}")
        found = _best(some, ["number"], top).join(names, "number")
        out = out.union(materialise(found.select("item", "rank", "id", "score")))
    return out.select(F.col("item").alias(item_id), "rank", F.col("id").alias(doc_id), "score")
