"""Block windows give what plain windows give, hot keys and ties included."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsmetrics.operators import joins as J
from opsmetrics.operators import ranking as R
from opsmetrics.operators import windows as X


@pytest.fixture(scope="module")
def rows(spark):
    # One key holds two thirds of the rows; order values repeat; a key is null.
    df = spark.range(900).select(
        "id", F.when(F.col("id") % 3 != 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), (F.col("id") % 5).cast("string"))).alias("key"),
        ((F.col("id") * 37) % 90).alias("at"), (F.col("id") % 11).alias("v"))
    return df.withColumn("block", F.floor(F.col("at") / 10)).cache()


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))


def test_running(rows):
    w = W.partitionBy("key").orderBy("at", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    want = rows.select("id", F.sum("v").over(w).alias("s"))
    assert same(want, X.running(rows, "key", ["at", "id"], "block", {"s": "v"}).select("id", "s"))


def test_running_global_over_ranges(rows):
    order = [F.desc("v"), F.asc("id")]
    w = W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    want = rows.select("id", F.sum("v").over(w).alias("s"))
    got = X.running(X.range_blocks(rows, *order), [], order, X.BLOCK, {"s": "v"})
    assert same(want, got.select("id", "s"))


def test_numbered(rows):
    w = W.partitionBy("key").orderBy("at", "id")
    want = rows.select("id", F.row_number().over(w).cast("bigint").alias("n"))
    assert same(want, X.numbered(rows, "key", ["at", "id"], "block", "n"))


@pytest.mark.parametrize("step", ["lag", "lead"])
def test_neighbour(rows, step):
    w = W.partitionBy("key").orderBy("at", "id")
    f = F.lag if step == "lag" else F.lead
    want = rows.select("id", f("id").over(w).alias("near"), f("v").over(w).alias("nv"))
    assert same(want, X.neighbour(rows, "key", ["at", "id"], "block", {"near": "id", "nv": "v"}, step))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("block", [None, "block"])
def test_ranked(rows, descending, block):
    w = W.partitionBy("key").orderBy(F.desc("at") if descending else F.asc("at"))
    want = rows.select("id", F.rank().over(w).cast("bigint").alias("r"), F.dense_rank().over(w).cast("bigint").alias("d"))
    assert same(want, X.ranked(rows, "key", "at", descending, block, "r", "d"))


def test_no_single_task_windows(rows):
    """No window sorts a whole key: every sort inside is by key and block, or over block totals."""
    plan = X.numbered(rows, "key", ["at", "id"], "block", "n")._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "Window [sum(" in line and "_side" in line]
    assert wide and all("block" in line for line in wide)


def test_top_k_prunes_before_the_shuffle(rows):
    plan = R.top_k_per_group(rows, "key", ["at", "id"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_ceiling_join_against_sorted_search(spark):
    dim = spark.createDataFrame([(float(b), f"d{b}") for b in (3, 10, 10.5, 40)], "bound double, name string")
    df = spark.createDataFrame([(i, float(i) / 2) for i in range(100)], "id bigint, x double")
    got = {r.id: r.name for r in J.ceiling_join(df, dim, "x", "bound").collect()}
    bounds = sorted((r.bound, r.name) for r in dim.collect())
    want = {i: next(n for b, n in bounds if b >= i / 2) for i in range(100) if i / 2 <= 40}
    assert got == want


@pytest.mark.parametrize("few", [200, 1])
def test_contains_join(spark, few):
    names = ["ab", "b", "Zab", "a%", "missing", "é"]
    texts = ["xaby", "b", "zaB a%", "né", "", "bb abab"]
    left = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    right = spark.createDataFrame([(n,) for n in names], "name string")
    got = sorted((r.id, r.name) for r in J.contains_join(left, right, "text", "name", few=few).collect())
    assert got == sorted((i, n) for i, t in enumerate(texts) for n in names if n in t)


def test_not_in_with_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    with_null = spark.createDataFrame([(1,), (None,)], "v int")
    plain = spark.createDataFrame([(1,)], "v int")
    empty = spark.createDataFrame([], "v int")
    rows = lambda r: sorted(str(x.k) for x in J.not_in(left, "k", r, "v").collect())
    assert rows(with_null) == [] and rows(plain) == ["2"] and rows(empty) == ["1", "2", "None"]


def test_either_key_join_counts_a_pair_once(spark):
    a = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, None, 2)], "id int, x int, y int")
    b = spark.createDataFrame([(1,), (2,)], "k int")
    got = sorted((r.id, r.k) for r in J.either_key_join(a, b, [("x", "k"), ("y", "k")]).collect())
    assert got == [(1, 1), (2, 1), (2, 2), (3, 2)]


def test_a_hot_key_is_spread(spark, rows):
    """The rows of one key end up in several tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for out in (X.running(rows, "key", ["at", "id"], "block", {"s": "v"}), X.neighbour(rows, "key", ["at", "id"], "block", {"near": "id"})):
            tasks = out.where("key = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
            assert tasks > 2
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_blocks_of_measured_size(spark):
    """One value on nine tenths of the rows: no block holds much more than its share, and sums still follow the order."""
    n = 20_000
    df = spark.range(n).select("id", F.when(F.col("id") % 10 < 9, 7).otherwise(F.col("id") % 50).alias("v"))
    blocks = X.range_blocks(df, "v", rows=1000, split_ties=True)
    sizes = [r["count"] for r in blocks.groupBy(X.BLOCK).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 3000 and sum(sizes) == n
    edges = blocks.groupBy(X.BLOCK).agg(F.min("v").alias("low"), F.max("v").alias("high")).orderBy(X.BLOCK).collect()
    assert all(a["high"] <= b["low"] for a, b in zip(edges, edges[1:]))
    together = X.range_blocks(df, "v", rows=1000)
    assert together.where("v = 7").select(X.BLOCK).distinct().count() == 1
    got = X.numbered(blocks.withColumn("k", F.lit(1)), "k", ["v", "id"], X.BLOCK)
    assert sorted(r.row_num for r in got.select("row_num").collect()) == list(range(1, n + 1))
    assert [r.v for r in got.orderBy("row_num").select("v").collect()] == sorted(r.v for r in df.collect())
    assert X.range_blocks(df.limit(0), "v").count() == 0


def test_ceiling_join_with_a_heavy_value(spark, monkeypatch):
    from opsmetrics.operators import joins as J

    plain = X.range_blocks
    monkeypatch.setattr(X, "range_blocks", lambda df, *order, **kw: plain(df, *order, rows=100, **kw))
    rows = spark.range(2000).select("id", F.when(F.col("id") % 10 < 9, 50).otherwise(F.col("id") % 120).cast("double").alias("v"))
    bounds = spark.createDataFrame([(float(b),) for b in (10, 49, 50, 80)], "b double")
    got = {r.id: r.b for r in J.ceiling_join(rows, bounds, "v", "b").collect()}
    want = {r.id: min((b for b in (10, 49, 50, 80) if b >= r.v), default=None) for r in rows.collect()}
    assert got == {i: b for i, b in want.items() if b is not None}


def test_ceiling_join_of_many_rows_goes_through_them_once(spark):
    rows = spark.range(200_000).select("id", (F.col("id") * 7919 % 200_000).cast("double").alias("v"))
    bounds = spark.range(0, 190_001, 10).select(F.col("id").cast("double").alias("b"))
    got = J.ceiling_join(rows, bounds, "v", "b")
    assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()
    wrong = got.where("b <> ceil(v / 10) * 10").count()
    assert (wrong, got.count()) == (0, 190_001)


def test_deep_pages(spark):
    from opsmetrics.operators.ranking import page

    df = spark.range(5000).select((F.col("id") * 37 % 5000).alias("v"), (F.col("id") % 3).alias("g")).repartition(7)
    rows = sorted(((r.g, -r.v) for r in df.collect()), key=lambda x: (x[0], x[1]))
    for offset in (0, 1, 2499, 4990, 5000, 9000):
        got = page(df, offset, 20, "g", F.desc("v"), near=0, rows=300)
        assert [(r.g, -r.v) for r in got.collect()] == rows[offset:offset + 20]
    plan = page(df, 2500, 20, "g", near=0, rows=300)._jdf.queryExecution().executedPlan().toString()
    assert "In(_block" in plan or "_block IN" in plan or "(_block" in plan


def test_text_chunks(spark):
    from opsmetrics.operators.aggregates import joined_text, text_chunks

    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id", F.floor(F.col("id") / 100).alias("b"), F.col("id").cast("string").alias("t"))
    df = df.withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    chunks = text_chunks(df, "k", "id", "t", "b", separator="-").collect()
    whole = {r.k: r.t for r in joined_text(df, "k", "id", "t", "t", "-").collect()}
    for k, text in whole.items():
        own = sorted((r.chunk_no, r.text) for r in chunks if r.k == k)
        assert [n for n, _ in own] == [1, 2, 3, 4, 5] and "-".join(t for _, t in own) == text
