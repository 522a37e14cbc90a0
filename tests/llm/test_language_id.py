"""Language identification: held-out accuracy, and what each kind of evidence does."""

import math
import random

from pyspark.sql import functions as F

from opsmetrics.llm.language_id import identify, sequences, train

SCHEMA = "id bigint, text string, host string, markup boolean, truth string, lang string"
PARTS = {"en": ["the", "ing", "tion", "ou", "wh"], "de": ["sch", "ein", "ung", "der", "ä"], "fr": ["eau", "que", "ent", "é", "oi"]}


def text(pick, lang, n):
    return " ".join("".join(pick.choices(PARTS[lang], k=pick.choice([1, 2, 3]))) for _ in range(n))


def run(spark, rows, langs, table):
    df = spark.createDataFrame(rows, SCHEMA)
    out = identify(df.select(F.struct("id", "truth", "lang").alias("row"), "host", "text", "markup"), langs, table)
    return {r["row"]["id"]: r for r in out.collect()}


def model(spark, pick):
    labelled = [(text(pick, lang, 50), lang, "clash") for lang in PARTS for _ in range(60)] + [(None, "en", ""), ("x", None, "")]
    return train(spark.createDataFrame(labelled, "text string, lang string, bucket string").repartition(3))


def test_fusion(spark):
    pick = random.Random(14)
    langs, table = model(spark, pick)
    assert langs == ["de", "en", "fr"]
    rows = []
    for i in range(200):
        lang = pick.choice(list(PARTS))
        body = text(pick, lang, pick.choice([6, 40]))
        host = f"{pick.choice(['www', 'm'])}.site{pick.randrange(3)}-{lang}.{'fr' if lang == 'fr' else 'com'}"
        rows.append((i, f"<html lang='{lang}-XX'><script>var the = 1</script><p>{body}</p>", host, True, lang, "x"))
    rows += [(300 + i, text(pick, "de", 20), "src", False, "de", None) for i in range(20)]
    rows += [(400, "", "www.site1-fr.fr", False, None, None), (401, "<html lang=fr>", "www.new.com", True, None, None), (402, None, None, False, None, None),
             (403, "", "new.fr", False, None, None), (404, text(pick, "en", 20_000), "src", False, "en", None)]
    got = run(spark, rows + [rows[0]], langs, table)
    right = [got[r[0]]["lang"] == r[4] for r in rows if r[4]]
    assert sum(right) / len(right) > 0.98
    assert got[0]["declared"] == rows[0][4] and got[400]["declared"] is None
    assert got[400]["lang"] == "fr" and got[401]["lang"] == "fr" and got[403]["lang"] == "fr"
    assert got[402]["text_lang"] is None and got[402]["lang"] in langs
    assert all(0 < r["posterior"] <= 1 + 1e-9 for r in got.values())


def test_posterior_by_hand(spark):
    pick = random.Random(15)
    langs, table = model(spark, pick)
    rows = [(i, text(pick, "de" if i < 6 else "en", 30), "h", False, None, None) for i in range(8)]
    got = run(spark, rows, langs, table)
    assert [got[i]["text_lang"] for i in range(8)] == ["de"] * 6 + ["en"] * 2
    counts, m = [6, 2, 0], 5.0
    p = [(c + 1) / 11 for c in counts]
    for _ in range(3):  # suffix, domain and host hold the same rows here
        p = [(c + m * q) / (8 + m) for c, q in zip(counts, p)]
    for i, body, *_ in rows:
        logs = [math.log(q) + 0.2 * float(table[k][sequences(body.encode())].sum()) for k, q in enumerate(p)]
        top = max(logs)
        assert abs(got[i]["posterior"] - 1 / sum(math.exp(x - top) for x in logs)) < 1e-4


def test_empty(spark):
    langs, table = train(spark.createDataFrame([], "text string, lang string"))
    assert langs == [] and run(spark, [], langs, table) == {}
    assert run(spark, [(1, "a b", "h.com", False, None, None)], langs, table)[1]["lang"] is None
    langs, table = model(spark, random.Random(16))
    assert run(spark, [], langs, table) == {}
