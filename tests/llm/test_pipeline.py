"""The pipeline's stages against plain Python on one small corpus."""

import random

from corpus_pipeline import STAGES, run
from opsmetrics.llm.decontaminate import words_of
from opsmetrics.llm.simhash import fingerprint

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    pick = random.Random(8)
    words = [f"{a}{b}" for a in ("ba", "ko", "lin", "ter", "mu", "sel") for b in ("ta", "ron", "vel", "so", "ndi", "gu", "pax")]
    say = lambda n: " ".join(pick.choices(words, k=n))
    items = [(i, say(30)) for i in range(4)]
    docs, labels = [], []
    for i in range(500):
        text, toxic = say(pick.choice([40, 200])), int(i % 5 == 0)
        if toxic:
            text = f"{text} worthless idiot scum worthless idiot scum {say(9)}"
        docs.append(text)
        labels.append((i, 1, toxic))
    clean = [i for i in range(500) if i % 5]
    copies = {500 + k: clean[k] for k in range(20)}
    docs += [docs[of].replace(" ", "\n ") for of in copies.values()]
    leaks = set(range(520, 540))
    docs += [f"{say(60)} {items[i % 4][1].upper()} {say(20)}" for i in leaks]
    rows = [(i, t, "en", "src", len(t)) for i, t in enumerate(docs)] + [(540, None, None, None, None)]
    return rows, labels, items, clean, copies, leaks


def test_stages_and_run(spark, tmp_path):
    rows, labels, items, clean, copies, leaks = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept, text = [], {i: t for i, t, *_ in rows}
    for name, stage in STAGES[:-1]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert kept[-1] <= before
    toxic, exact, near, leak = kept
    assert not toxic & set(range(0, 500, 5)) and len(set(clean) - toxic) <= 4
    assert all((text[c] or "").split() for c in copies) and not any({c, of} <= exact for c, of in copies.items())
    prints = {i: fingerprint(text[i]) for i in exact}
    left = sorted(near)
    assert all((prints[a] ^ prints[b]).bit_count() > 2 for k, a in enumerate(left) for b in left[k + 1:])
    assert all(any((prints[i] ^ prints[j]).bit_count() <= 2 for j in exact if j != i) for i in exact - near)
    assert leak == near - leaks
    assert all(r["text"] == text[r["doc_id"]] for r in docs.collect())
    pieces = run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == leak
    assert words_of(b"A-b") == [b"a", b"b"]


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert run(spark, str(tmp_path)).count() == 0
