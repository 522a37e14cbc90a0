"""SimHash against all pairs."""

import random
import re

import xxhash

from opsmetrics.llm.components import components, union_find
from opsmetrics.llm.simhash import distinct_rows, fingerprint, links, near_duplicates

SCHEMA = "doc_id bigint, text string, fp string, id string"


def slow(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps):
    pairs = [(a, b) for a in fps for b in fps if a <= b and (a ^ b).bit_count() <= 2]
    return union_find(pairs)


def texts():
    pick = random.Random(1)
    vocabulary = [f"w{i}É" for i in range(50)]
    base = [" ".join(pick.choices(vocabulary, k=pick.choice([1, 2, 3, 40, 400]))) for _ in range(60)]
    near = [t + " tail" for t in base] + [t.upper() for t in base]
    return base + near + [None, "", " \n", "A b", "a B", "long\x0bword " * 30_000] + [base[5]] * 50


def test_documents(spark):
    rows = [(None if i == 3 else 1000 - i, t, "x", None) for i, t in enumerate(texts())]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    prints = [(i, slow(t)) for i, t, *_ in rows]
    roots = brute({f for _, f in prints})
    least = {}
    for i, f in prints:
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == sorted(
        ((i, f"{f:016x}", least.get(roots[f])) for i, f in prints), key=str)


def test_links_connect_exactly_the_near(spark):
    pick = random.Random(2)
    fps = {pick.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for _ in range(6):
            for _ in range(pick.choice([1, 2, 3])):
                f ^= 1 << pick.randrange(64)
            fps.add(f)
    signed = lambda x: x - (x >> 63 << 64)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    edges = [(a % 2**64, b % 2**64) for a, b in links(df).collect()]
    assert all((a ^ b).bit_count() <= 60 and a in fps and b in fps for a, b in edges)
    want, got = brute(fps), union_find([*edges, *((f, f) for f in fps)])
    assert {frozenset(f for f in fps if want[f] == r) for r in set(want.values())} == {
        frozenset(f for f in fps if got[f] == r) for r in set(got.values())}


def test_components_of_long_chains(spark):
    pick = random.Random(4)
    ids = pick.sample(range(10_000), 600)
    pairs = [(a, b) for a, b in zip(ids, ids[1:]) if pick.random() < 0.98] + [(ids[0], ids[0])]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint").repartition(20)).collect()}
    want = union_find(pairs)
    assert got == {n: r for n, r in want.items() if n in got}
    assert {n for p in pairs for n in p if p[0] != p[1]} == set(got)


def test_short_and_empty(spark):
    assert fingerprint(None) == 0 and fingerprint("  ") == 0 and fingerprint("a b") == slow("a b")
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_distinct_rows(spark):
    """One whole row of each component of fingerprints stays."""
    rows = [(None if i == 3 else 1000 - i, t, str(i), None) for i, t in enumerate(texts())]
    out = distinct_rows(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert out.columns == ["doc_id", "text", "fp", "id"]
    prints = {i: slow(t) for i, t, *_ in rows}
    roots = brute(set(prints.values()))
    least = {}
    for i in prints:
        if i is not None:
            least[roots[prints[i]]] = min(i, least.get(roots[prints[i]], i))
    whole = {(i, t, n) for i, t, n, _ in rows}
    got = out.collect()
    assert sorted(r["doc_id"] for r in got) == sorted(least.values())
    assert all((r["doc_id"], r["text"], r["fp"]) in whole for r in got)
