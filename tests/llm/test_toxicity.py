"""Toxicity: held-out accuracy, misspellings, and that a score depends on the text alone."""

import random
import zlib

import numpy as np
import pytest

from opsmetrics.llm.toxicity import Model, Scorer, fit, held_out, score, train, window_means, words_of

SCHEMA = "doc_id bigint, text string, toxic string, score string"


def corpus(n=900, seed=1):
    pick = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ba", "ko", "lin", "ter", "mu") for b in ("ta", "ron", "vel", "so", "ndi", "gu")]
    out = []
    for i in range(n):
        words = pick.choices(plain, k=pick.choice([5, 30, 300]))
        toxic = int(pick.random() < 0.3)
        for _ in range(3 * toxic):
            words.insert(pick.randrange(len(words)), pick.choice(["worthless", "idiot", "scum"]))
        out.append((i, " ".join(words), toxic))
    return out


@pytest.fixture(scope="module")
def model():
    rows = corpus()
    return fit([words_of(t) for _, t, _ in rows], [y for _, _, y in rows])


def test_held_out_accuracy(model):
    scorer = Scorer(model)
    rows = corpus(400, seed=2)
    assert np.mean([(scorer(t) >= 0.7) == bool(y) for _, t, y in rows]) > 0.97


def test_unseen_misspelling(model):
    scorer = Scorer(model)
    assert scorer("bata worthles koron") > 0.5 > scorer("bata muvel koron")


def test_one_insult_in_a_long_text(model):
    scorer = Scorer(model)
    long = " ".join(["bata koron linso"] * 10_000)
    assert scorer(long) < 0.3 < 0.7 <= scorer(long + " worthless idiot scum " + long)


def test_windows():
    assert window_means(np.array([])).tolist() == [0.0]
    assert window_means(np.array([1.0, 3.0]), 5).tolist() == [2.0]
    values = np.random.default_rng(0).normal(size=50)
    assert np.allclose(window_means(values, 12), [values[i:i + 12].mean() for i in range(39)])


def test_train_and_score(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash", None) for i, t, _ in rows] + [(None, None, None, None), (5000, "", None, None)], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (4, 9)], "doc_id bigint, toxic int")
    out = {r["row"]["doc_id"]: r["score"] for r in score(docs, train(docs, labels), ["doc_id", "toxic"]).collect()}
    assert len(out) == len(rows) + 2
    test = [(out[i] >= 0.7) == bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean(test) > 0.95
    flags = {r["doc_id"]: r["h"] for r in docs.select("doc_id", held_out("doc_id").alias("h")).collect()}
    assert all(flags[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(900)) and flags[None] is False


def test_held_out_labels_do_not_train(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t, None, None) for i, t, _ in rows], SCHEMA)
    one = [(i, y) for i, _, y in rows]
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in one]
    a, b = (train(docs, spark.createDataFrame(x, "doc_id bigint, toxic int")) for x in (one, other))
    assert np.array_equal(a.values, b.values) and a.bias == b.bias


def test_bounds_and_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    empty = train(docs, labels)
    assert isinstance(empty, Model) and score(docs, empty, ["doc_id"]).count() == 0
    assert Scorer(empty)("any") == 0.5
    rows = corpus(200)
    some = spark.createDataFrame([(i, t, None, None) for i, t, _ in rows], SCHEMA)
    ys = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    assert not np.array_equal(train(some, ys, max_chars=5_000).values, train(some, ys).values)
    assert not train(some, ys, max_chars=5).values.any()


def test_labels_of_rows_that_are_not_there_take_no_place(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t, "", "") for i, t, _ in rows], SCHEMA)
    labels = [(i, y) for i, _, y in rows]
    more = [(i, 0) for i in range(10_000, 40_000)]
    a, b = (train(docs, spark.createDataFrame(x, "doc_id bigint, toxic int"), max_rows=300) for x in (labels, labels + more))
    assert a.values.any() and np.array_equal(a.values, b.values)
