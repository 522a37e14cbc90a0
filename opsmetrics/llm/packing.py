"""Packing along a space-filling curve.

A document's tokens are counted into a hashed vector, which is projected to three dimensions; its place on the
Hilbert curve through them is its key. Documents are range-sorted by key, so neighbours on the curve stand
next to each other, and the sorted stream of tokens is cut every ``LENGTH`` tokens. A document's place in the
stream is the sum of the tokens before it, so its pieces follow by arithmetic and only the last sequence is
padded.

Tokens are written once. The range sort moves keys and counts only; the places then join the tokens by row
number, which is even for any input. Documents of one key are ordered by row number, so a large group of
equal documents is spread over ranges like any other.

Defined results: long texts are read whole, and other columns, whatever their names, change nothing;
a null or empty text is the end token alone; ids may be null or repeated, every row is
packed on its own; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise

LENGTH = 2048
END = 1
FEATURES = 256
DIMENSIONS = 3
BITS = 16  # a dimension
CACHE = 600_000  # words
TOGETHER = 256
#: Fixed value: the words of the tokenizer in lower-cased UTF-8 whose other characters are all letters.
WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\s0-9a-z\x80-\xff]+")
_LOCAL = 33  # low bits of monotonically_increasing_id


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of each row of ``points`` (whole numbers below 2**bits)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    level = 1 << (bits - 1)
    while level > 1:  # undo the rotations, from the coarsest cell to the finest
        low = level - 1
        for i in range(n):
            set_ = (x[i] & level) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[n - 1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | (x[i] >> b) & 1
    return index


class Encoder:
    """Token ids of whole texts, by a tokenizer that marks word ends and drops white space.

    Texts of ASCII and of other letters are cut into the tokenizer's own words by ``WORDS``. The ids of each word
    are looked up; new words are encoded many at a time and told apart by the word ends. Texts with other
    characters, or with a special token's opening, go through the tokenizer as they are. Either way the ids are
    those of the tokenizer on the whole text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            raise ValueError("the tokenizer must mark word ends")
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)])
        self.known: dict[bytes, bytes] = {}
        self.letters = {chr(c) for c in range(128)}
        self.end = np.array([END], self.kind).tobytes()

    def _plain(self, data: bytes) -> bool:
        """Whether the words of a text can be looked up."""
        if b"<|" in data:
            return False
        if data.isascii():
            return True
        text = data.decode("utf-8", "replace")
        new = set(text).difference(self.letters)
        if not all(c.isalpha() and c.lower().isalpha() for c in new):
            return False
        self.letters |= new
        return is_normalized("NFC", text)

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _learn(self, new: list[bytes]) -> None:
        width = self.kind.itemsize
        for at in range(0, len(new), TOGETHER):
            part = new[at:at + TOGETHER]
            raw = self._encode([b" ".join(part)])[0]
            cuts = ((np.flatnonzero(self.ends[np.frombuffer(raw, self.kind)]) + 1) * width).tolist()
            if len(cuts) != len(part):
                self.known.update(zip(part, self._encode(part)))
                continue
            self.known.update(zip(part, map(raw.__getitem__, map(slice, [0, *cuts], cuts))))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known.clear()
        plain = [self._plain(t) for t in texts]
        words = [WORDS.findall(t.lower()) if p else [] for t, p in zip(texts, plain)]
        flat = list(chain.from_iterable(words))
        ids = list(map(self.known.get, flat))
        missing = [i for i, found in enumerate(ids) if found is None]
        self._learn(list({flat[i] for i in missing}))
        for i in missing:
            ids[i] = self.known[flat[i]]
        odd = iter(self._encode([t for t, p in zip(texts, plain) if not p]))
        taken = iter(ids)
        return [(b"".join(islice(taken, len(w))) if p else next(odd)) + self.end for w, p in zip(words, plain)]


def directions(seed: int = 0) -> np.ndarray:
    matrix = np.random.default_rng(seed).normal(size=(FEATURES, DIMENSIONS))
    return matrix / np.linalg.norm(matrix, axis=0)


def keys(ids: list[np.ndarray]) -> np.ndarray:
    """Curve keys of documents, from their token counts."""
    vectors = np.stack([np.bincount((i.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24), minlength=FEATURES) for i in ids])
    projected = vectors @ directions() / np.linalg.norm(vectors, axis=1, keepdims=True)
    return hilbert(np.clip((projected + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1))


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """The encoder of a file, kept with its words for the next tasks of a worker."""
    return Encoder(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                data = encoder([t.as_buffer().to_pybytes() for t in part.column("text")])
                ids = [np.frombuffer(d, encoder.kind) for d in data]
                yield pa.RecordBatch.from_pydict({
                    "uid": part.column("uid"), "id": part.column("id"), "key": pa.array(keys(ids), pa.int64()),
                    "n": pa.array([len(i) for i in ids], pa.int64()), "ids": pa.array(data, pa.binary())})

    return run


def _pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                rows, out = [], {n: [] for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
                for i, (first, n, data) in enumerate(zip(part.column("first").to_pylist(), part.column("n").to_pylist(), part.column("ids"))):
                    raw = data.as_buffer()
                    ids = np.frombuffer(raw, np.dtype(f"<u{raw.size // n}")).astype("<u4")
                    at = 0
                    while at < n:
                        sequence, offset = divmod(first + at, length)
                        size = min(n - at, length - offset)
                        rows.append(i)
                        for name, value in zip(out, (at, size, zlib.crc32(ids[at:at + size].tobytes()), n, sequence, offset)):
                            out[name].append(value)
                        at += size
                yield pa.RecordBatch.from_pydict({"id": part.column("id").take(pa.array(rows, pa.int64()))}
                                                 | {n: pa.array(v, pa.int64()) for n, v in out.items()})

    return run


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``tokenizer`` is a file's path."""
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").alias("id"),
                     F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    encoded = materialise(rows.mapInArrow(_encode(tokenizer), f"uid bigint, id {kind}, key bigint, n bigint, ids binary"))

    small = encoded.select("key", "uid", "n")
    placed = materialise(small.repartitionByRange("key", "uid").sortWithinPartitions("key", "uid")
                         .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftrightunsigned("at", _LOCAL)))
    sums = placed.groupBy("part").agg(F.sum("n").alias("total"))
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("total").over(before(W.orderBy("part"))), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(before(W.partitionBy("part").orderBy("at"))), F.lit(0))
    firsts = placed.withColumn("inside", inside).join(bases, "part").select("uid", (F.col("base") + F.col("inside")).alias("first"))

    pieces = encoded.select("uid", "id", "n", "ids").join(firsts, "uid").select("id", "first", "n", "ids").mapInArrow(
        _pieces(length), f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return pieces.withColumnRenamed("id", id_col)
