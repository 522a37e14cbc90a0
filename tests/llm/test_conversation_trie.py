"""The trie against rebuilt texts."""

import hashlib
import random
import zlib
from collections import defaultdict

from opsmetrics.llm import conversation_trie as CT
from opsmetrics.llm.conversation_trie import compose, element, inverse, prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n int, a string, depth string"


def key(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:30]


def slow(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, key(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c / 5) * 5
        built[c] = own.get(c - base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own_members in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(own_members) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(node))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children[node], leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[n] for n in names) for r in prefix_trie(df).collect()), key=repr)


def talks():
    pick = random.Random(6)
    say = lambda: pick.choice(["hi", "ok", "no", "é" * 3, "", None])
    rows = []
    for c in [*range(120), *range(-7, 0), 10_001, 10_004]:
        rows += [(c, t, pick.choice(["user", "bot"]), say()) for t in range(pick.choice([1, 2, 3, 9, 14]))]
    first = [(200 + i, t, "user", "same") for i in range(60) for t in range(pick.choice([4, 12]))]
    long = [(300, t, "user", say()) for t in range(260)] + [(301, t, "user", say()) for t in range(40)]
    odd = [(400, None, "a", "x"), (400, None, "a", "x"), (400, 1, None, None), (400, 1, "a", "y" * 5000), (None, 1, "a", "b"), (401, 1, "1", "2"), (402, 1, "", "1:12")]
    rows += first + long + odd
    pick.shuffle(rows)
    return rows


def test_against_rebuilt_texts(spark, monkeypatch):
    monkeypatch.setattr(CT, "DEPTHS", 50)
    rows = talks()
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(7)
    assert got(df) == slow(rows)


def test_collisions_start_again(spark, monkeypatch):
    rows = [(c, t, "user", f"{c % 7} {t}") for c in range(40) for t in range(10)]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    plain, seeds = CT.reference, []

    def weak(role, text, seed=0):
        seeds.append(seed)
        return [c % 2 if seed == 0 else c for c in plain(role, text, seed)]

    monkeypatch.setattr(CT, "reference", weak)
    assert got(df) == slow(rows) and seeds == [0, 1]
    plain_nodes, made = CT._nodes, []

    def unlike(*args):
        made.append(1)
        nodes, n = plain_nodes(*args)
        return nodes, n + (len(made) == 1)

    monkeypatch.setattr(CT, "reference", plain)
    monkeypatch.setattr(CT, "_nodes", unlike)
    assert got(df) == slow(rows) and len(made) == 2


def test_unlike_prefixes_are_seen(spark):
    """Groups of one fingerprint that differ in the last turn, the parent or the depth."""
    convs = spark.createDataFrame([], "conv bigint, base bigint, h bigint, hb bigint, n bigint, qa bigint, qb bigint, ba bigint, bb bigint")
    heads = spark.createDataFrame([], "conv bigint, place bigint, a bigint, b bigint, ga bigint, gb bigint, r1 bigint, r2 bigint, size bigint")
    schema = "conv bigint, depth bigint, a bigint, b bigint, ga bigint, gb bigint, r1 bigint, r2 bigint, size bigint, last boolean"
    row = lambda node, depth=1, parent=0, ref=5: (1, depth, node, 0, 1, parent, ref, 6, 7, True)
    like = [row(2), row(2), row(3, depth=2, parent=4)]
    for extra, bad in (([], 0), ([row(2, ref=9)], 1), ([row(3, depth=2, parent=5)], 1), ([row(2, depth=3)], 1)):
        nodes, unlike = CT._nodes(convs, heads, spark.createDataFrame(like + extra, schema))
        assert nodes.count() == 2 and unlike == bad


def test_empty_table(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_products():
    pick = random.Random(1)
    maps = [element(pick.getrandbits(60), pick.getrandbits(60)) for _ in range(3)]
    a, b, c = maps
    assert compose(compose(a, b), c) == compose(a, compose(b, c)) and compose(a, b) != compose(b, a)
    assert compose(a, inverse(a)) == (1, 0) == compose(inverse(a), a)
