"""Tables that steps write, and the setting that is changed while they are written."""

from concurrent.futures import ThreadPoolExecutor

from opsmetrics.session import SHUFFLES_END, materialise


def test_setting_is_given_back(spark):
    before = spark.conf.get(SHUFFLES_END)
    with ThreadPoolExecutor(4) as pool:
        tables = list(pool.map(lambda n: materialise(spark.range(100 * n).repartition(3, "id")), range(1, 9)))
    assert [t.count() for t in tables] == [100 * n for n in range(1, 9)]
    assert spark.conf.get(SHUFFLES_END) == before


def test_setting_is_given_back_after_a_failure(spark):
    before = spark.conf.get(SHUFFLES_END)
    try:
        materialise(spark.range(5).selectExpr("raise_error('no') AS x"))
    except Exception as error:
        assert "no" in str(error)
    else:
        raise AssertionError("the write should fail")
    assert spark.conf.get(SHUFFLES_END) == before


def test_written_frame_can_be_read_again(spark):
    """The frame that was written is planned anew; its own shuffles are made again."""
    df = spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count()
    first = sorted(df.collect())
    assert sorted(materialise(df).collect()) == first == sorted(df.collect())
