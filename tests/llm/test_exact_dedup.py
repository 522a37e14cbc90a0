"""Exact dedup against grouping in a dictionary, with tables small enough to spill."""

import hashlib
import random
import re

import pytest

from opsmetrics.llm.exact_dedup import ContentTable, exact_groups, settle

SCHEMA = "doc_id bigint, text string, rep string, gid string, kept string"


def brute(rows):
    groups = {}
    for i, (doc, text, *_) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc is None, doc or 0, i, doc))
    out = []
    for norm, members in groups.items():
        best = min(members)
        out += [(m[4], best[4], len(members), hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out, key=str), len(groups)


@pytest.mark.parametrize("memory", [1, 500, 1 << 20])
def test_groups(spark, memory):
    pick = random.Random(3)
    texts = ["", None, " ", "a b", "ab", "a\tb\n", "a b", "é" * 40_000, "é " * 40_000] + [f"t{pick.randrange(60)}" for _ in range(300)] + ["hot copy"] * 200
    rows = [(None if i == 7 else i, t, "x", None, "y") for i, t in enumerate(texts)] + [(20, texts[20], "x", None, "y")] * 2
    got = exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(6), memory=memory).collect()
    want, n_groups = brute(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    assert sum(r["kept"] for r in got) == n_groups


def test_settle_compares_contents():
    rows = [(5, f"c{i % 9}".encode(), i) for i in range(100)]  # one hash for all
    first = dict(settle(iter(rows), memory=1))
    assert len(set(first.values())) == 9
    assert all(rows[i][1] == rows[f][1] for i, f in first.items())


def test_table_grows():
    table = ContentTable(1 << 30)
    for i in range(5000):
        table.add(-i, str(i).encode(), i)
    assert all(table.find(-i, str(i).encode()) == i for i in range(5000))
    assert table.find(-1, b"2") is None


def test_empty(spark):
    assert exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0
