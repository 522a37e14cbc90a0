"""Toxicity scores from averaged subword vectors and a linear softmax, trained jointly in numpy.

A word is the average of the vectors of its character n-grams and of itself (hashed into a fixed number of
buckets), so a misspelling shares most of its vectors with the word it comes from. A window of words is the
average of its words, and a linear softmax over two classes scores it. A text is scored by its highest window:
an insult weighs the same in a long text as in a short one. Training fits vectors and softmax together on
the labels of whole texts. In the first rounds the average of the whole text is scored, so n-grams that mark toxic
texts stand out wherever they are; after that the gradient reaches the window that decided. Vectors with
small gradients move slowly, so the rare n-grams of single texts are not learnt by heart.

The model is fitted by the driver on a bounded sample: ``MAX_ROWS`` labelled rows in hash order, at most
``MAX_CHARS`` characters of them, and none longer than a fifth of that. Its size is fixed (``BUCKETS`` x
``DIM``), and what is broadcast is one number per bucket. Scoring reads whole texts of all rows.

Defined results: long texts are read whole, and other columns, whatever their names, change nothing;
a null or empty text scores as a window without words; rows with a null id are scored but
never trained on; null labels do not train; without usable labels every score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 17
DIM = 8
WINDOW = 6
#: Rounds that score whole texts, and the gradient below which a vector moves more slowly.
WHOLE_ROUNDS = 15
FLOOR = 2e-5
MAX_ROWS = 8_000
MAX_CHARS = 20_000_000
THRESHOLD = 0.7
CACHE = 400_000
_WORD = re.compile(r"\w+")


def subwords(word: str) -> list[int]:
    """Buckets of the word itself and of its character n-grams of 3 to 5."""
    framed = f"<{word}>"
    grams = [framed[i:i + n] for n in (3, 4, 5) for i in range(len(framed) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for g in (framed + "w", *grams)]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class Model:
    """The value of each bucket on the way to the difference of the two classes, and the bias."""

    values: np.ndarray
    bias: float

    def word(self, word: str) -> float:
        grams = subwords(word)
        return float(self.values[grams].sum()) / len(grams)


def window_means(values: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Averages of all runs of ``window`` words, or of all words if there are fewer."""
    if len(values) <= window:
        return np.array([values.mean() if len(values) else 0.0])
    sums = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return (sums[window:] - sums[:-window]) / window


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(texts: Iterable[list[str]], toxic: list[int], rounds: int = 50, rate: float = 0.3, seed: int = 0,
        whole: int = WHOLE_ROUNDS, floor: float = FLOOR) -> Model:
    """Train on word lists, which are read once before ``toxic`` is. Adam on all rows at once.

    A row counts through its whole text in the first ``whole`` rounds, then through its highest window.
    """
    codes: dict[str, int] = {}
    rows = [np.fromiter((codes.setdefault(w, len(codes)) for w in t), np.int32, len(t)) for t in texts]
    if len(set(toxic)) < 2 or not codes:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    flat, sizes = array("i"), array("i")
    for word in codes:
        grams = subwords(word)
        flat.extend(grams)
        sizes.append(len(grams))
    flat, sizes = np.frombuffer(flat, np.int32), np.frombuffer(sizes, np.int32)
    used = np.bincount(flat, minlength=BUCKETS) > 0
    del codes
    ends = np.cumsum(sizes, dtype=np.int64)
    starts = ends - sizes
    lengths = np.fromiter(map(len, rows), np.int32, len(rows))
    tokens = np.concatenate(rows)
    text_of = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    del rows
    # First words of all windows, row after row.
    n_windows = np.maximum(lengths - WINDOW + 1, 1)
    first_window = np.cumsum(n_windows) - n_windows
    row_of = np.repeat(np.arange(len(lengths), dtype=np.int32), n_windows)
    begin = np.arange(len(row_of), dtype=np.int32) + np.repeat((np.cumsum(lengths) - lengths - first_window).astype(np.int32), n_windows)
    width = np.minimum(lengths, WINDOW).astype(np.int8)[row_of]

    random = np.random.default_rng(seed)
    vectors = random.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    softmax = random.normal(0, 1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    y = np.asarray(toxic, np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, softmax, bias)]
    for turn in range(1, rounds + 1):
        difference = softmax[:, 1] - softmax[:, 0]
        bucket_values = vectors @ difference
        word_values = np.add.reduceat(bucket_values[flat], starts) / sizes
        if turn <= whole:
            best = np.bincount(text_of, word_values[tokens], len(lengths)) / np.maximum(lengths, 1)
            error = (sigmoid(best + bias[1] - bias[0]) - y) / len(lengths)
            share = np.bincount(tokens, (error / np.maximum(lengths, 1))[text_of], len(sizes))
        else:
            sums = np.concatenate(([0.0], np.cumsum(word_values[tokens], dtype=np.float64)))
            means = (sums[begin + width] - sums[begin]) / np.maximum(width, 1)
            best = np.maximum.reduceat(means, first_window)
            at_best = np.flatnonzero(means == best[row_of])
            pick = at_best[np.unique(row_of[at_best], return_index=True)[1]]
            error = (sigmoid(best + bias[1] - bias[0]) - y) / len(lengths)
            # The words of the deciding windows take the gradient.
            reach = width[pick].astype(np.int64)
            of = np.repeat(np.arange(len(pick)), reach)
            inside = np.arange(len(of)) - np.repeat(np.concatenate(([0], np.cumsum(reach)[:-1])), reach)
            word = tokens[begin[pick][of] + inside]
            share = np.bincount(word, error[of] / np.maximum(reach, 1)[of], len(sizes))
        hot = np.flatnonzero(share)
        spread = np.repeat(share[hot] / sizes[hot], sizes[hot])
        where = flat[np.repeat(starts[hot] - np.cumsum(sizes[hot]) + sizes[hot], sizes[hot]) + np.arange(len(spread))]
        per_bucket = np.bincount(where, spread, BUCKETS).astype(np.float32)
        slope = vectors.T @ per_bucket
        gradients = (per_bucket[:, None] * difference[None, :], np.stack([-slope, slope], 1),
                     np.array([-error.sum(), error.sum()], np.float32))
        for parameter, gradient, (mean, square) in zip((vectors, softmax, bias), gradients, moments):
            mean += 0.1 * (gradient - mean)
            square += 0.001 * (gradient * gradient - square)
            parameter -= rate * (mean / (1 - 0.9 ** turn)) / (np.sqrt(square / (1 - 0.999 ** turn)) + floor)
    return Model(np.where(used, vectors @ (softmax[:, 1] - softmax[:, 0]), 0).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    """Scores whole texts; remembers the values of words it has met."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def __call__(self, text: str | None) -> float:
        words = words_of(text)
        known = self.known
        for word in set(words).difference(known):
            known[word] = self.model.word(word)
        values = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
        if len(known) > CACHE:
            known.clear()
        return float(sigmoid(window_means(values).max() + self.model.bias))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
          max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where(
        F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out("_id"))
    there = docs.select(F.col(id_col).alias("_id"))  # labels of rows that are not in docs take no place in the sample
    chosen = usable.join(there, "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_rows)  # at most max_rows small rows
    texts = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).where(F.length("_text") <= max_chars // 5)
    # The rows come in the order of the table, so the limit on characters acts on the smallest hashes first.
    sized = rows.select("_id", "_y", F.length("_text").alias("_n"), F.xxhash64("_id").alias("_h"))
    spent, last = 0, None
    for row in sorted(sized.collect(), key=lambda r: (r["_h"], r["_id"])):
        spent += row["_n"]
        if spent > max_chars:
            break
        last = row["_h"]
    if last is None:
        return fit([], [])
    sample = rows.where(F.xxhash64("_id") <= F.lit(last)).orderBy("_id", "_y", "_text")
    toxic: list[int] = []

    def texts_of() -> Iterator[list[str]]:
        for row in sample.select("_y", "_text").toLocalIterator():
            toxic.append(row["_y"])
            yield words_of(row["_text"])

    return fit(texts_of(), toxic)


def _score(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, bias = broadcast.value
        scorer = Scorer(Model(values, bias))
        for batch in batches:
            scores = [scorer(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "score": pa.array(scores, pa.float64())})

    return run


def score(df: DataFrame, model: Model, carry: list[str], text_col: str = "text") -> DataFrame:
    """The columns in ``carry`` of each row as the struct ``row``, and ``score`` of its text."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sent = df.sparkSession.sparkContext.broadcast((model.values, model.bias))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_score(sent), schema)
