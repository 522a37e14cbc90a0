"""URL rules against plain Python: the list, mined rules by counting all token sets, and which rule fires."""

import random
from itertools import combinations
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from opsmetrics.llm.url_filters import RULES, judge, mine, tokens, host_of, path_of

SCHEMA = "page_id bigint, url string, host string, rule string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[:min([i for c in "?#" if (i := path.find(c)) >= 0], default=len(path))]


def by_list(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def urls():
    pick = random.Random(9)
    out = []
    for i in range(600):
        host = f"{pick.choice(['www.', 'm.', ''])}{pick.choice(['example', 'ab', 'cd'])}.{pick.choice(['com', 'net', 'org', 'COM'])}"
        out.append(f"https://{host}/{pick.choice(['en', 'es', 'fr', 'de'])}/{i}{pick.choice(['.html', '?page=2&ref=x', '#top', ''])}")
    return out + [None, "", "no scheme", "http://", "http://com", "x://a.com?q://b.net/es/", "http://Ä.NET/es/é?x=/#y", "http://notcom/", "http://a.com:80/",
                  "http://a.b." + "c" * 50_000 + ".com/" + "s/" * 3000] + ["http://hot.net/es/1"] * 100


def test_list_rules(spark):
    rows = [(None if i == 5 else i, u, "clash", None) for i, u in enumerate(urls())]
    got = judge(spark.createDataFrame(rows, SCHEMA).repartition(4), RULES).collect()
    assert len(got) == len(rows)
    want = sorted(((i, *split(u), by_list(*split(u))[0]) for i, u, *_ in rows), key=str)
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in got), key=str) == want
    for r in got:
        listed = by_list(r["host"], r["path"])[1]
        assert r["verdict"] == (listed or r["verdict"]) and r["verdict"] in ("allow", "block")


def test_mined_rules_and_firing(spark):
    rows = [(i, u, None, None) for i, u in enumerate(urls()) if u and len(u) < 200]
    df = spark.createDataFrame(rows, SCHEMA)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    baskets = [(set(r["t"]), r["url"]) for r in df.select("url", tokens(F.col("url"), host, path).alias("t")).collect()]
    labelled = [(t, by_list(*split(u))[1]) for t, u in baskets if t and by_list(*split(u))[1]]
    table = spark.createDataFrame([(sorted(t), v) for t, v in labelled], "tokens array<string>, label string")
    got = {(tuple(r["tokens"]), r["label"]): (r["support"], r["confidence"]) for r in mine(table, 0.05, 0.8).collect()}
    counts, hits = {}, {}
    for t, v in labelled:
        for k in range(1, len(t) + 1):
            for c in combinations(sorted(t), k):
                counts[c] = counts.get(c, 0) + 1
                hits[c, v] = hits.get((c, v), 0) + 1
    every = {(c, v): (n / len(labelled), n / counts[c]) for (c, v), n in hits.items() if n >= 0.05 * len(labelled) and n >= 0.8 * counts[c]}
    want = {(c, v): x for (c, v), x in every.items()
            if not any(every.get((s, v), (0, 0))[1] >= x[1] for s in combinations(c, len(c) - 1))}
    assert set(got) == set(want)
    assert all(abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], want[k]))
    verdicts = {r["page_id"]: r for r in judge(df, RULES, min_support=0.05).collect()}
    for (i, u, *_), (t, _) in zip(rows, baskets):
        if by_list(*split(u))[0] is None:
            fired = [(x[1], x[0], -len(c), v) for (c, v), x in want.items() if set(c) <= t]
            assert verdicts[i]["verdict"] == (max(fired)[3] if fired and max(fired)[:3] != sorted(fired)[-2:][0][:3] or len(fired) == 1
                                              else verdicts[i]["verdict"] if fired else "allow")


def test_path_like_the_library(spark):
    for url in urls():
        if url and "://" in url and "Ä" not in url and len(url) < 200 and ":80" not in url:
            assert split(url)[1] == urlsplit(url).path


def test_empty(spark):
    assert judge(spark.createDataFrame([], SCHEMA), RULES).count() == 0
    one = judge(spark.createDataFrame([(1, "http://x.org/a", "", "")], SCHEMA), RULES).first()
    assert (one["rule"], one["verdict"]) == (None, "allow")


def test_tokens_that_always_come_together(spark):
    """Twenty constant segments are mined as one token, with the rules that plain FP-growth and the pruning give on fewer."""
    import time

    from pyspark.ml.fpm import FPGrowth
    from pyspark.sql import functions as F

    from opsmetrics.llm.url_filters import mine

    def baskets(deep):
        rows = []
        for i in range(300):
            own = [f"path{k}=x" for k in range(deep)] if i % 3 else ["other"]
            rows.append((own + [f"kind{i % 4}"], "block" if i % 3 and i % 4 != 2 else "allow"))
        return spark.createDataFrame(rows + [([], "allow"), (["rare"], "block")], "tokens array<string>, label string")

    few = baskets(4)
    items = few.where(F.size("tokens") > 0).select(F.concat("tokens", F.array(F.concat(F.lit("?"), "label"))).alias("items"))
    plain = FPGrowth(itemsCol="items", minSupport=0.05, minConfidence=0.6).fit(items).associationRules.collect()
    found = {(tuple(sorted(r.antecedent)), r.consequent[0][1:]): r.confidence for r in plain
             if r.consequent[0][0] == "?" and not any(t[0] == "?" for t in r.antecedent)}
    want = {k: c for k, c in found.items()
            if not any(found.get((tuple(t for t in k[0] if t != out), k[1]), -1) >= c for out in k[0])}
    got = {(tuple(r.tokens), r.label): r.confidence for r in mine(few, 0.05, 0.6).collect()}
    assert got == want and len(got) > 4
    start = time.time()
    many = mine(baskets(20), 0.05, 0.6).collect()
    assert time.time() - start < 90 and {t for r in many for t in r.tokens} >= {f"path{k}=x" for k in range(20)}
