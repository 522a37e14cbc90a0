"""Decontamination against comparing all windows."""

import hashlib
import random
import re

import pytest

from opsmetrics.llm.decontaminate import SuffixAutomaton, decontaminate, report, without_spans, words_of

SCHEMA = "doc_id bigint, text string, item_id string, n_words string"


def slow_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(doc, items, window):
    words, hit, owners = slow_words(doc), set(), set()
    for item, text in items:
        iw = slow_words(text)
        k = min(window, len(iw))
        wins = {tuple(iw[i:i + k]) for i in range(len(iw) - k + 1)} if k else set()
        for i in range(len(words) - k + 1 if k else 0):
            if tuple(words[i:i + k]) in wins:
                hit |= set(range(i, i + k))
                owners.add(item or "")
    return len(words), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest()


def data():
    pick = random.Random(5)
    say = lambda n: " ".join(pick.choices(["a", "b", "Cé", "d9"], k=n))
    items = [(str(i), say(pick.choice([0, 2, 3, 7, 15, 40]))) for i in range(25)] + [(None, say(12)), ("3", say(11)), ("x", None), ("same", "A, b!")]
    docs = [say(pick.choice([0, 1, 5, 30, 200])) for _ in range(40)] + [None, "", "---", "zz " * 20_000 + say(50)]
    docs += [f"start {t} end" for _, t in items] + [docs[0]] * 20
    return docs, items


@pytest.mark.parametrize("window,block_words", [(4, 10_000), (10, 10_000), (4, 30)])
def test_report(spark, window, block_words):
    docs, items = data()
    rows = [(None if i == 2 else i, t, "x", None) for i, t in enumerate(docs)]
    items_df = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id string, text string, doc_id string")
    got = report(spark.createDataFrame(rows, SCHEMA).repartition(3), items_df, window=window, block_words=block_words).collect()
    want = sorted(((i, *brute(t, items, window)) for i, t, *_ in rows), key=str)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got), key=str) == want
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)


def test_longest_match():
    automaton = SuffixAutomaton([("1", list("abcdefgh")), ("2", list("xbcdy"))], window=3)
    assert automaton.scan(list("zabcdefz")) == ([(1, 7)], {"1", "2"}, 6)


def test_words_and_cuts():
    for text in ("Aé_b9 [x]`{y}\x7f\x00Z@", "", "ß É"):
        assert [w.decode() for w in words_of(text.encode())] == slow_words(text)
    assert without_spans("One, two. Three four! Five", [(1, 3)]) == "One, four! Five".replace("One, ", "One, ")
    assert without_spans("a b", [(0, 2)]) == ""


def test_decontaminate(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    rows = [(1, "clean text", "x", None), (2, f"{'pad ' * 60}{passage.upper()}, after", "x", None), (3, passage, "x", None), (4, None, None, None)]
    df, items = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("i", passage)], "item_id string, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate(df, items).collect()}
    assert got == {1: "clean text", 2: "pad " * 59 + "pad , after", 4: None}
    strict = decontaminate(df, items, max_coverage=0)
    assert strict.columns == df.columns and sorted(r["doc_id"] for r in strict.collect()) == [1, 4]


def test_empty(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id string, text string")
    assert report(docs, items).count() == 0
    one = report(spark.createDataFrame([(1, "a b", "", "")], SCHEMA), items).first()
    assert (one["n_words"], one["n_hit"], one["contaminated"]) == (2, 0, False)
