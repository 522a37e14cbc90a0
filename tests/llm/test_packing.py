"""Packing against the tokenizer itself, and the curve against its own rules."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from opsmetrics.llm import packing
from opsmetrics.llm.packing import Encoder, hilbert, keys, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, ids string, key string"


@pytest.mark.parametrize("dimensions,bits", [(2, 4), (3, 3)])
def test_curve_visits_neighbours(dimensions, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions), -1).reshape(-1, dimensions)
    index = hilbert(grid, bits)
    assert sorted(index) == list(range(len(grid)))
    path = grid[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def texts():
    pick = random.Random(6)
    words = ["The", "naïve", "don't", "x y", "é", "\x1cq", "<|endoftext|>", "1234", "!!!", "日本", "Σ", " "]
    return [" ".join(pick.choices(words, k=pick.choice([1, 9, 400]))) for _ in range(60)] + [None, "", " \n\t", "long\x0b" * 9000, "w" * 30_000] + ["copy of it"] * 40


def test_encoder_is_the_tokenizer():
    plain, encoder = Tokenizer.from_file(PATH), Encoder(PATH)
    for text in texts():
        want = plain.encode(text or "", add_special_tokens=False).ids + [1]
        assert np.frombuffer(encoder([(text or "").encode()])[0], encoder.kind).tolist() == want


@pytest.mark.parametrize("length", [64, 2048])
def test_pieces(spark, length):
    rows = [(None if i == 3 else i // 2, t, "x", None) for i, t in enumerate(texts())]
    got = pack(spark.createDataFrame(rows, SCHEMA).repartition(5), PATH, length=length).collect()
    plain = Tokenizer.from_file(PATH)
    wanted, total = {}, 0
    for i, t, *_ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        wanted.setdefault(i, []).append(ids)
        total += len(ids)
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        cut = [zlib.crc32(np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes())
               for ids in wanted[r["doc_id"]] if len(ids) == r["doc_tokens"]]
        assert r["ids_crc32"] in cut
    assert sum(r["length"] for r in got) == total
    for sequence, parts in used.items():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at == length or sequence == max(used) and at == total - length * max(used)
    assert sorted(used) == list(range(len(used)))


def test_keys_bring_like_documents_together():
    a, b = np.arange(1, 400, dtype=np.uint16), np.arange(5000, 5400, dtype=np.uint16)
    same, near, other = keys([a, np.append(a, 7).astype(np.uint16), b])
    assert abs(same - near) < abs(same - other)


def test_empty(spark):
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_words_are_kept_between_tasks(monkeypatch):
    """A second task of a worker encodes no word that the first one has encoded, and gives the same ids."""
    learned = []
    monkeypatch.setattr(Encoder, "_learn", lambda self, new, learn=Encoder._learn: (learned.extend(new), learn(self, new))[1])
    packing.encoder_of.cache_clear()
    batch = pa.RecordBatch.from_pydict({"uid": [1, 2], "id": [1, 2], "text": ["some words of a text", "other words"]})
    first, second = (next(packing._encode(str(PATH))(iter([batch]))) for _ in range(2))
    assert first.equals(second) and sorted(learned) == sorted(set(learned)) and len(learned) == 6
