"""Ranked search against plain Python, and the sharing of sums."""

import math
import random
import re
from collections import Counter, defaultdict

from opsmetrics.llm.lexical_search import PIECE, search, share, terms_of

DOCS, ITEMS = "doc_id bigint, text string, item string, rank int, score string", "item_id bigint, text string, id int, number string"


def slow_terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def slow(docs, items, top=50):
    counts = [(i, Counter(slow_terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    held = Counter(t for _, c in counts for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(slow_terms(text))
    out = []
    for item, terms in wanted.items():
        rows = []
        for doc, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // total if c else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(rows)[:top])]
    return out


def corpus():
    pick = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "É2", "straße", "x9"]
    say = lambda n: " ".join(pick.choices(vocabulary, k=n))
    docs = [(i, say(pick.choice([1, 5, 30, 200]))) for i in range(150)]
    docs += [(200 + i, "The w1-W2, w1!") for i in range(70)]  # more ties than places
    docs += [(None, "w3"), (None, "w3"), (7, "w3 w4"), (8, None), (9, ""), (10, " -- "), (11, say(400_000))]
    items = [(i, say(pick.choice([2, 8, 20]))) for i in range(12)] + [(3, "w1 zzz"), (50, None), (51, "..."), (None, "w1 W2"), (52, "nowhere")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in docs], DOCS).repartition(5)
    q = spark.createDataFrame([(i, t, 1, "c") for i, t in items], ITEMS)
    want = sorted(slow(docs, items), key=repr)
    for block in (200_000, 30):
        got = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in search(d, q, block=block).collect()]
        assert sorted(got, key=repr) == want


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a", "", 1, "")], DOCS)
    assert search(none, spark.createDataFrame([(1, "a", 1, "")], ITEMS)).count() == 0
    assert search(some, spark.createDataFrame([], ITEMS)).count() == 0


def test_sharing():
    pick = random.Random(2)
    common = list(range(12))
    items = [sorted({*pick.sample(common, 9), *pick.sample(range(12, 60), 4)}) for _ in range(30)]
    size = 1 + max(max(i) for i in items)
    nodes, sums = share(items)
    under = {t: {t} for t in range(size)}
    for k, (a, b) in enumerate(nodes, size):
        assert not under[a] & under[b]
        under[k] = under[a] | under[b]
    assert [sorted(t for n in s for t in under[n]) for s in sums] == items
    plain = sum(len(i) - 1 for i in items)
    assert len(nodes) + sum(len(s) - 1 for s in sums) < plain
    same = [list(range(20))] * 5
    assert len(share(same)[1][0]) == 1 and len(share(same)[0]) == 19
    assert share([]) == ([], [])


def test_pieces():
    text = ("ab " * (PIECE // 2) + "c" * (PIECE + 5) + " D.e").encode()
    assert [w for part in terms_of(text) for w in part] == text.decode().lower().replace(".", " ").encode().split()
    assert list(terms_of(b"")) == []
