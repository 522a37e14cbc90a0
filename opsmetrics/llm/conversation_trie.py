"""The prefix trie of conversations that are rebuilt from a base's head and their own suffix.

1. References. A turn is known by 120 bits of a digest of its role and text, its reference. References are held against
   whole contents: two contents under one reference start the work again with another digest.
2. Fingerprints. A turn is the map x -> a x + b over the numbers modulo 2^61 - 1; a sequence is the product of its
   turns. The maps form a group, so products combine without the turns: with P(j), the product of the first j turns,
   the rebuilt conversation's prefix that ends at own turn j is head of base x inverse of own P(h) x own P(j).
   Only each conversation's first factor is made; no rebuilt turn is written out. Running products come from one range
   sort of all turns; a conversation that spans tasks takes one product from each task before.
3. Nodes. Turns after the head bring their fingerprint, inherited heads (8 turns at most) are counted per base and
   length and then joined to the base's fingerprints. One aggregate makes the nodes. In every group the references of the
   last turns and the fingerprints of the parents must be the same, so by induction all prefixes are equal; a
   group that fails starts the work again with another digest.
4. Sums over subtrees need no rounds: a node belongs to its smallest member, a conversation's nodes are the lower end
   of its path, so a subtree's sum is that of the totals of its members' nodes, less what its own
   conversation has above it.
5. Ends are sorted by node and number over all tasks and cut into chunks; a node's digest is taken over its chunks.

Defined results: rows without a conversation id belong to no conversation; turns of one number stand in order of
their references, and repeated rows are turns of their own; null role and text are empty; a table without
conversations has no nodes; other columns, whatever their names, are not read. Very long texts are digested whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import running
from ..session import materialise

P = (1 << 61) - 1
HEAD = 8  # longest head
CHUNK = 20_000  # numbers in a chunk of ends
#: Depths in one block of a conversation's running sum.
DEPTHS = 4096
Map = tuple[int, int]


def compose(f: Map, g: Map) -> Map:
    """f, then g."""
    return f[0] * g[0] % P, (g[0] * f[1] + g[1]) % P


def inverse(f: Map) -> Map:
    a = pow(f[0], P - 2, P)
    return a, -f[1] * a % P


def element(r1: int, r2: int) -> Map:
    """The map of a turn, from the two halves of its reference (60 bits each)."""
    return r1 + 1, r2


def _arrow(schema: str, rows: Callable[[Iterator[tuple]], Iterator[tuple]], size: int = 20_000):
    """``rows`` from tuples to tuples as a function of Arrow batches; ``schema`` names the columns, all bigint but those with a type."""
    fields = [part.split() for part in schema.split(",")]
    kinds = {"binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    arrow = pa.schema([(f[0], kinds.get(f[-1], pa.int64())) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in rows(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))):
            held.append(row)
            if len(held) == size:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), arrow.types)], schema=arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), arrow.types)], schema=arrow)

    return run


def _mapped(df: DataFrame, schema: str, rows) -> DataFrame:
    return df.mapInArrow(_arrow(schema, rows), ", ".join(p if " " in p.strip() else f"{p} bigint" for p in schema.split(",")))


def _scan(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted turns of a task, with their place and the products up to and before them, all since the conversation's start in this task."""
    now, place, product = None, 0, (1, 0)
    for part, conv, r1, r2, size in rows:
        if conv != now:
            now, place, product = conv, 0, (1, 0)
        before, place = product, place + 1
        product = compose(product, element(r1, r2))
        yield part, conv, place, *product, *before, r1, r2, size


def _carry(rows: Iterator[tuple]) -> Iterator[tuple]:
    """For each part of a conversation, the number and product of the turns in the parts before."""
    now, count, product = None, 0, (1, 0)
    for conv, part, n, a, b in rows:
        if conv != now:
            now, count, product = conv, 0, (1, 0)
        yield conv, part, count, *product
        count, product = count + n, compose(product, (a, b))


def _place(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv, place, a, b, ga, gb, r1, r2, size, count, ca, cb in rows:
        if count:
            place, (a, b), (ga, gb) = place + count, compose((ca, cb), (a, b)), compose((ca, cb), (ga, gb))
        yield conv, place, a, b, ga, gb, r1, r2, size


def _factors(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Each conversation's factor: the base's head, then the inverse of its own first turns."""
    for conv, base, h, hb, n, ca, cb, ba, bb in rows:
        cut, head = (ca, cb) if h and n > h else (1, 0), (ba, bb) if hb else (1, 0)
        yield conv, base, h, hb, n, *compose(head, inverse(cut)), *head


def _suffixes(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv, place, a, b, ga, gb, r1, r2, size, h, hb, n, qa, qb in rows:
        yield conv, hb + place - h, *compose((qa, qb), (a, b)), *compose((qa, qb), (ga, gb)), r1, r2, size, place == n


def _chunks(rows: Iterator[tuple]) -> Iterator[tuple]:
    node, held = None, []
    for a, b, conv in rows:
        if node != (a, b) or len(held) == CHUNK:
            if held:
                yield *node, held[0], ",".join(map(str, held)).encode()
            node, held = (a, b), []
        held.append(conv)
    if held:
        yield *node, held[0], ",".join(map(str, held)).encode()


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    node, digest = None, None
    for a, b, _, data in rows:
        if node == (a, b):
            digest.update(b",")
        else:
            if node:
                yield *node, digest.hexdigest()
            node, digest = (a, b), hashlib.sha256()
        digest.update(data)
    if node:
        yield *node, digest.hexdigest()


def reference(role: Column, text: Column, seed: int = 0) -> list[Column]:
    """The two halves of a turn's reference."""
    digest = F.sha2(F.concat(F.lit("" if seed == 0 else f"{seed}:"), F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint") for at in (1, 16)]


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with their place in the conversation and the products up to and before them."""
    order = ["conv", F.col("turn").asc_nulls_first(), "r1", "r2"]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    scanned = materialise(_mapped(ranged.select(F.spark_partition_id().cast("bigint").alias("part"), "conv", "r1", "r2", "size"),
                                  "part, conv, place, a, b, ga, gb, r1, r2, size", _scan))
    # Only conversations that span tasks are carried on: at most two rows for each task.
    spans = scanned.groupBy("conv").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("conv")
    edges = scanned.join(spans, "conv", "left_semi").groupBy("conv", "part").agg(
        F.max("place").alias("n"), F.max_by(F.struct("a", "b"), "place").alias("p")).select("conv", "part", "n", "p.a", "p.b")
    carried = _mapped(edges.repartition("conv").sortWithinPartitions("conv", "part"), "conv, part, count, ca, cb", _carry)
    both = scanned.join(materialise(carried), ["conv", "part"], "left").select(
        "conv", "place", "a", "b", "ga", "gb", "r1", "r2", "size", "count", "ca", "cb")
    return materialise(_mapped(both, "conv, place, a, b, ga, gb, r1, r2, size", _place))


def _built(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The conversations with their factors, the first turns of all, and the turns after the head as places in the trie."""
    placed = _placed(turns)
    heads = placed.where(F.col("place") <= HEAD)
    sizes = placed.groupBy("conv").agg(F.max("place").alias("n"))
    convs = sizes.select("conv", (F.col("conv") - F.col("conv") % 5).alias("base"), (F.crc32(F.col("conv").cast("string")) % 9).alias("h"), "n")
    product = lambda key, at, x: heads.select(F.col("conv").alias(key), F.col("place").alias(at), F.col("a").alias(f"{x}a"), F.col("b").alias(f"{x}b"))
    convs = convs.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("nb")), "base", "left")
    convs = convs.withColumn("hb", F.least("h", F.coalesce("nb", F.lit(0)))).join(product("conv", "h", "c"), ["conv", "h"], "left")
    convs = convs.join(product("base", "hb", "b"), ["base", "hb"], "left").select("conv", "base", "h", "hb", "n", "ca", "cb", "ba", "bb")
    convs = materialise(_mapped(convs, "conv, base, h, hb, n, qa, qb, ba, bb", _factors))
    own = placed.join(convs.select("conv", "h", "hb", "n", "qa", "qb").where("n > h"), "conv").where("place > h")
    names = ["conv", "place", "a", "b", "ga", "gb", "r1", "r2", "size", "h", "hb", "n", "qa", "qb"]
    path = materialise(_mapped(own.select(*names), "conv, depth, a, b, ga, gb, r1, r2, size, last boolean", _suffixes))
    return convs, heads, path


def _inherited(convs: DataFrame, heads: DataFrame, aggs: list[Column]) -> DataFrame:
    """Aggregates of the conversations that inherit each turn of a base."""
    counted = convs.where("hb > 0").groupBy("base", "hb").agg(*aggs)
    each = counted.withColumn("place", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("hb"))))
    return each.join(heads.withColumnRenamed("conv", "base"), ["base", "place"])


def _nodes(convs: DataFrame, heads: DataFrame, path: DataFrame) -> tuple[DataFrame, int]:
    """The nodes by fingerprint, and how many groups hold unequal prefixes."""
    many, least = F.count(F.lit(1)).alias("n"), F.min("conv").alias("least")
    fields = ["a", "b", "depth", "ga", "gb", "r1", "r2", "size", "n", "least"]
    none = F.lit(None).cast("bigint")
    root = convs.groupBy(F.lit(1).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")).agg(many, least)
    rows = path.select(*fields[:8], F.lit(1).cast("bigint").alias("n"), F.col("conv").alias("least"))
    rows = rows.union(_inherited(convs, heads, [many, least]).withColumn("depth", F.col("place")).select(*fields))
    rows = rows.union(root.select("a", "b", F.lit(0).cast("bigint"), none, none, none, none, F.lit(0).cast("bigint"), "n", "least"))
    same = ["depth", "ga", "gb", "r1", "r2", "size"]
    grouped = rows.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("least").alias("least"), *[F.min(c).alias(c) for c in same],
                                         *[F.max(c).alias(f"_{c}") for c in same])
    nodes = materialise(grouped)
    unlike = " or ".join(f"{c} <> _{c}" for c in same)
    return nodes.drop(*[f"_{c}" for c in same]), nodes.where(unlike).count()


def _ends(convs: DataFrame, path: DataFrame) -> DataFrame:
    ends = path.where("last").select("a", "b", "conv").union(convs.where("n <= h").select("ba", "bb", "conv"))
    order = ["a", "b", "conv"]
    ends = materialise(ends)
    chunks = _mapped(ends.repartitionByRange(*order).sortWithinPartitions(*order), "a, b, first, data binary", _chunks)
    return _mapped(chunks.repartition("a", "b").sortWithinPartitions("a", "b", "first"), "a, b, ends_sha256 string", _digests)


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = df.where(F.col(f"`{conv_col}`").isNotNull())
    seed = 0
    while True:
        r1, r2 = reference(role, text, seed)
        turns = materialise(rows.select(F.col(f"`{conv_col}`").cast("bigint").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
                                        r1.alias("r1"), r2.alias("r2"), F.octet_length(text).cast("bigint").alias("size")))
        contents = rows.select(r1.alias("r1"), r2.alias("r2"), role.alias("role"), text.alias("text")).distinct()
        shared = contents.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if shared.isEmpty():
            convs, heads, path = _built(turns)
            nodes, unlike = _nodes(convs, heads, path)
            if not unlike:
                break
        seed += 1

    up = nodes.where("ga is not null")
    children = up.groupBy("ga", "gb").agg(F.count(F.lit(1)).alias("n_children")).withColumnsRenamed({"ga": "a", "gb": "b"})
    parents = nodes.select(F.col("a").alias("ga"), F.col("b").alias("gb"), F.col("least").alias("parent_conv_id"))
    nodes = nodes.join(children, ["a", "b"], "left").join(parents, ["ga", "gb"], "left").select(
        "a", "b", "depth", F.col("least").alias("conv"), "parent_conv_id", "n", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        ((F.col("n") - 1) * F.col("size")).alias("saved"), F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint").alias("leaf"))
    nodes = materialise(nodes)

    totals = materialise(nodes.groupBy("conv").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf")))
    both = [F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf")]
    # Each conversation's own total on every node of its path.
    worth = convs.join(totals, "conv")
    sums = path.select("conv", "a", "b").join(totals, "conv").select("a", "b", "saved", "leaf")
    sums = sums.union(_inherited(worth, heads, both).select("a", "b", "saved", "leaf"))
    sums = sums.union(totals.select(F.lit(1).cast("bigint"), F.lit(0).cast("bigint"), "saved", "leaf"))
    sums = sums.groupBy("a", "b").agg(F.sum("saved").alias("all_saved"), F.sum("leaf").alias("all_leaf"))
    above = running(nodes.withColumn("block", F.floor(F.col("depth") / DEPTHS)), "conv", "depth", "block",
                    {"above_saved": "saved", "above_leaf": "leaf"}, exclusive=True)
    out = above.join(sums, ["a", "b"]).join(_ends(convs, path), ["a", "b"], "left")
    return out.select(F.col("conv").alias(conv_col), "depth", F.col("parent_conv_id").alias(f"parent_{conv_col}"), F.col("n").alias("n_convs"), "n_children",
                      (F.col("all_leaf") - F.coalesce("above_leaf", F.lit(0))).alias("n_leaves"),
                      (F.col("all_saved") - F.coalesce("above_saved", F.lit(0))).alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
