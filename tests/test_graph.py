"""Blocking graphs against brute force, cycles and self-edges included."""

import random

import pytest

from opsmetrics.plans import blocking as B


def frame(spark, rows):
    return spark.createDataFrame([(s, b, 10 * s, "LCK_M_X") for s, b in rows], "sid bigint, blk bigint, wait_ms bigint, wait_type string")


def brute_counts(rows):
    up = {s: b for s, b in rows}
    out = {}
    for top in up:
        seen, todo = {top}, [top]
        while todo:
            at = todo.pop()
            for s, b in up.items():
                if b == at and s != b and s not in seen:
                    seen.add(s)
                    todo.append(s)
        out[top] = len(seen) - 1
    return out


def brute_chains(rows):
    up = {s: b for s, b in rows}
    blockers = {b for b in up.values() if b}
    out = {}
    for s in up:
        at, level, seen = s, 0, set()
        while at in up and up[at] not in (0, None) and up[at] != at and at not in seen:
            seen.add(at)
            at, level = up[at], level + 1
        if at in up and up[at] in (0, None) and at in blockers:
            out[s] = (at, level)
    return out


def random_graph(seed, n=60):
    rng = random.Random(seed)
    return [(i, rng.choice([0, 0, rng.randint(1, n), rng.randint(1, n), rng.randint(1, n + 5), i])) for i in range(1, n + 1)]


FIXED = {
    "cycle, self-edge, tail": [(1, 2), (2, 1), (3, 3), (4, 1)],
    "long chain": [(i, i - 1) for i in range(1, 70)],
    "chain into a cycle": [(1, 3), (2, 1), (3, 2)] + [(i, i - 1) for i in range(4, 20)],
    "no blocking": [(1, 0), (2, 0)],
    "blocker without a row": [(1, 99), (2, 1)],
}
GRAPHS = {**FIXED, **{f"random {s}": random_graph(s) for s in range(4)}}


@pytest.mark.parametrize("name", GRAPHS)
def test_blocked_counts(spark, name):
    rows = GRAPHS[name]
    got = {r.sid: r.blocked_session_count for r in B.blocked_counts(frame(spark, rows)).collect()}
    assert got == brute_counts(rows)


@pytest.mark.parametrize("name", GRAPHS)
def test_hierarchy(spark, name):
    rows = GRAPHS[name]
    got = {r.sid: (r.head, r.level) for r in B.blocking_hierarchy(frame(spark, rows)).collect()}
    assert got == brute_chains(rows)


def test_chains_stop_below_parallel_waits(spark):
    df = spark.createDataFrame([(1, 0, 5, None), (2, 1, 5, "CXPACKET"), (3, 2, 5, "LCK_M_S"), (4, 1, 5, "LCK_M_S")],
                               "sid bigint, blk bigint, wait_ms bigint, wait_type string")
    got = {(r.sid, r.level) for r in B.blocking_hierarchy(df).collect()}
    assert got == {(1, 0), (2, 1), (4, 1)}


@pytest.mark.parametrize("seed", range(3))
def test_cut_chains_against_brute_force(spark, seed):
    rng = random.Random(100 + seed)
    rows = random_graph(100 + seed)
    kind = {s: rng.choice(["CXPACKET", "LCK_M_S", "LCK_M_X", None]) for s, _ in rows}
    up = dict(rows)
    blockers = {b for b in up.values() if b}

    def chain(s):
        at, level = s, 0
        while up.get(at) and up[at] != at and level < len(up):
            at, level = up[at], level + 1
            if at in up and kind[at] == "CXPACKET":
                return None
        return (at, level) if at in up and not up[at] and at in blockers else None

    want = {s: chain(s) for s in up if chain(s)}
    df = spark.createDataFrame([(s, b, 1, kind[s]) for s, b in rows], "sid bigint, blk bigint, wait_ms bigint, wait_type string")
    assert {r.sid: (r.head, r.level) for r in B.blocking_hierarchy(df).collect()} == want


def test_captures_do_not_mix(spark):
    df = spark.createDataFrame([("a", 1, 0, 5, "X"), ("a", 2, 1, 5, "X"), ("b", 1, 2, 5, "X"), ("b", 2, 0, 5, "X")],
                               "runtime string, sid bigint, blk bigint, wait_ms bigint, wait_type string")
    got = {(r.runtime, r.head, r.sid) for r in B.blocking_hierarchy(df, "runtime").collect()}
    assert got == {("a", 1, 1), ("a", 1, 2), ("b", 2, 2), ("b", 2, 1)}


def test_tree_layout(spark):
    df = spark.createDataFrame([("10:00", 1, 0, "a\nb"), ("10:00", 2, 1, "x"), ("10:00", 3, 2, "y")], "runtime string, sid bigint, blk bigint, batch_text string")
    lines = [r.blocking_tree for r in B.blocking_tree(df).orderBy("anchor", "sort_path").collect()]
    pad = "10:00" + " " * 17
    assert lines == [pad + "1 a b", pad + "|-- 2 x", pad + "|   |-- 3 y", pad + "2 x", pad + "|-- 3 y"]


def test_tree_numbers(spark):
    """Places in the printed order against a walk, per capture, with cycles and lost chains left out."""
    import random

    from opsmetrics.plans.blocking import tree_numbers

    pick = random.Random(3)
    rows = []
    for run in ("a", "b"):
        rows += [(run, i, 0 if i < 4 else pick.randrange(1, i)) for i in range(1, 120)]
        rows += [(run, 200 + i, 199 + i if i else 0) for i in range(40)] + [(run, 300, 301), (run, 301, 300), (run, 302, 300), (run, 303, 999)]
    want = []
    for run in ("a", "b"):
        below = {}
        for r, sid, blk in rows:
            if r == run:
                below.setdefault(blk, []).append(sid)
        number = 0

        def walk(sid, depth):
            nonlocal number
            number += 1
            own = number
            for child in sorted(below.get(sid, [])):
                walk(child, depth + 1)
            want.append((run, sid, depth, own, number - own + 1))

        for root in sorted(below[0]):
            walk(root, 0)
    got = tree_numbers(spark.createDataFrame(rows, "run string, sid bigint, blk bigint").repartition(5), "run").collect()
    assert sorted((r.run, r.sid, r.depth, r.number, r["size"]) for r in got) == sorted(want)
