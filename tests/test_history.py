"""Histories by day and key, SQL table functions, and substring joins by rare grams."""

import random
import uuid
from datetime import datetime, timedelta

from opsmetrics.operators import joins as J
from opsmetrics.sources import history

START = datetime(2024, 5, 1)


def captures(spark, hours, keys=7):
    rows = [(i, START + timedelta(hours=h), i % keys) for i, h in enumerate(hours)]
    return spark.createDataFrame(rows, "id int, at timestamp_ntz, k int")


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def files_of(table):
    return sorted(r[0] for r in table.selectExpr("_metadata.file_path").distinct().collect())


def test_filters_prune_days_and_joins_need_no_shuffle(spark):
    base = history.history_database(spark, f"h_{uuid.uuid4().hex}")
    one = history.append_history(captures(spark, range(240)), f"{base}.one", "at", "k", 4)
    two = history.append_history(captures(spark, range(0, 480, 2)), f"{base}.two", "at", "k", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = history.since(one, "at", START + timedelta(days=8, hours=5))
        joined = new.select("k").join(two.select("k"), "k").groupBy("k").count()
        plan = plan_of(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "PartitionFilters: [isnotnull(capture_day" in plan and "Exchange" not in plan
    assert {r["id"] for r in new.collect()} == set(range(8 * 24 + 6, 240))
    assert len(files_of(new)) <= 2 * 4  # two of ten days, four buckets each


def test_appends_match_names_and_retention_rewrites_one_day(spark):
    table = f"{history.history_database(spark, f'h_{uuid.uuid4().hex}')}.log"
    history.append_history(captures(spark, range(96)), table, "at", "k", 2)
    later = captures(spark, range(96, 120)).select("k", "at", "id").union(spark.createDataFrame([(1, None, -1)], "k int, at timestamp_ntz, id int"))
    log = history.append_history(later, table, "at", "k", 2)
    assert log.count() == 121 and log.columns == ["id", "at", "k", "capture_day"]
    border = START + timedelta(days=1, hours=6)
    untouched = [f for f in files_of(log) if "2024-05-03" in f]
    for _ in range(2):  # a second run changes nothing
        kept = history.retain_history(spark, table, "at", 30, border + timedelta(days=30))
        assert sorted(r["at"] for r in kept.where("at is not null").collect()) == [START + timedelta(hours=h) for h in range(31, 120)]
        assert kept.where("at is null").count() == 1 and [f for f in files_of(kept) if "2024-05-03" in f] == untouched
    # A day without a row that stays goes as a whole.
    kept = history.retain_history(spark, table, "at", 0, START + timedelta(days=1, hours=23))
    assert kept.where("at is not null").count() == 72
    assert "2024-05-02" not in str(spark.sql(f"SHOW PARTITIONS {table}").collect())


def test_table_functions_are_inlined(spark):
    from opsmetrics.catalog import QUERIES

    plan = plan_of(QUERIES["j2_table_function"](spark, "/root/testdata/sf0.001"))
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan
    plan = plan_of(QUERIES["j2_lateral_function"](spark, "/root/testdata/sf0.001"))
    assert "HashJoin" in plan or "SortMergeJoin" in plan


def test_rare_grams_find_what_a_search_finds(spark, monkeypatch):
    pick = random.Random(5)
    word = lambda n: "".join(pick.choices("abcé ", k=n))
    texts = [word(pick.choice([0, 2, 3, 9, 40, 3000])) for _ in range(60)] + ["aaaa" * 30] * 20 + ["İstanbul", "x" * 1023 + "seam" + "y" * 9]
    names = sorted({word(n) for n in (1, 2, 3, 4, 5, 6, 7, 12, 30) for _ in range(4)} | {"aaaaa", "İST", "seam", "nowhere"})
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    known = spark.createDataFrame([(n,) for n in names], "n string")
    got = sorted((r.i, r.n) for r in J.contains_join(df, known, "t", "n", few=1).collect())
    assert got == sorted((i, n) for i, t in enumerate(texts) for n in names if n in t)
    few, many = (sorted((r.i, r.n) for r in J.contains_join(df, known, "t", "n", few=f, ignore_case=True).collect()) for f in (200, 1))
    assert few == many


def test_grams_do_not_grow_with_the_lengths_of_names(spark):
    """Texts give off grams of one length, however many lengths the names have."""
    text = "".join(random.Random(2).choices("abcdefgh", k=5000))
    df = spark.createDataFrame([(1, text)], "_row int, _text string")
    sizes = [len(J.anchored_hits(df, spark.createDataFrame([(text[:n],) for n in lengths], "_key string")).collect())
             for lengths in ((8,), range(8, 90))]
    assert sizes == [1, 82]
    assert df.select(J._grams(J.F.col("_text"), J.GRAM).alias("g")).selectExpr("size(g)").first()[0] <= 5000
