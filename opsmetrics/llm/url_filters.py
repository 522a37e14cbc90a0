"""URL filtering by association rules.

A URL becomes a basket of tokens: its public suffix label, the domain names that end its host, the first label,
path segments with their depth, file ending, query names, fragment. Spark's FP-growth mines the baskets of
labelled URLs, with the label as one more item. Of the rules that predict a label those stay that reach the
support and the confidence and that no shorter rule inside them equals. They are matched by an inverted
index: each rule is posted under its tokens, a URL looks up its tokens, and a rule fires when all its tokens
were found. Of the rules that fire the one with the highest confidence decides, then support, then the shorter.

A list of fixed rules (host and path) goes first; URLs that it decides are the labelled ones.

Defined results: long texts are read whole, and other columns, whatever their names, change nothing;
a null URL or one without ``://`` has an empty host and path and no tokens; a URL that no
rule decides is allowed; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.8
DEFAULT = "allow"
_LABEL = "label="

#: The rule list of the query. Verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fixed rule that fits, as a struct of its text and verdict; null if none does."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(len(h + p)).alias("length"), F.lit(len(h)).alias("host_length"),
                            F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))) for verdict, h, p in rules]
    return F.greatest(*fits, F.lit(None)) if fits else F.lit(None)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL; empty without a host."""
    labels = F.split(host, r"\.")
    depth = F.size(labels)
    ends = F.transform(F.sequence(F.lit(1), depth), lambda k: F.concat(
        F.lit("host="), F.array_join(F.slice(labels, depth - k + 1, k), ".")))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    deep = F.transform(segments, lambda s, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), s))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda q: q != ""),
                        lambda q: F.concat(F.lit("query="), F.regexp_extract(q, r"^([^=]*)", 1)))
    none = F.array().cast("array<string>")
    found = F.concat(ends, F.array(F.concat(F.lit("first="), F.element_at(labels, 1))), deep,
                     F.when(ending != "", F.array(F.concat(F.lit("ending="), F.lower(ending)))).otherwise(none),
                     F.when(query != "", names).otherwise(none),
                     F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(none))
    return F.when(host != "", F.array_distinct(found)).otherwise(none)


def _merged(baskets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Baskets with one token for all that stand in the same baskets, and which tokens it stands for; rare tokens go.

    Tokens that always come together would double the item sets with each of them. Sets of baskets are known by
    their size and two hash sums.
    """
    each = baskets.select("uid", F.explode("tokens").alias("token"))
    same = ["n", "x", "y"]
    sets = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("uid")).alias("x"),
                                     F.bit_xor(F.xxhash64(F.lit(7), "uid")).alias("y")).where(F.col("n") >= least)
    sets = materialise(sets)
    members = materialise(sets.join(sets.groupBy(*same).agg(F.min("token").alias("head")), same).select("head", "token"))
    merged = each.join(members, "token").groupBy("uid").agg(F.collect_set("head").alias("tokens"))
    return merged.join(baskets.select("uid", "label"), "uid"), members


def _spelled_out(rules: DataFrame, members: DataFrame) -> DataFrame:
    """Each rule once for every choice of a token for each of its heads."""
    most = rules.agg(F.max(F.size("tokens"))).first()[0] or 0
    out = rules.withColumn("heads", F.col("tokens")).withColumn("tokens", F.array().cast("array<string>"))
    for k in range(most):
        one = members.select(F.col("head").alias("_head"), F.col("token").alias("_token"))
        out = out.join(one, F.get("heads", F.lit(k)) == F.col("_head"), "left").withColumn(
            "tokens", F.when(F.col("_token").isNull(), F.col("tokens")).otherwise(F.concat("tokens", F.array("_token")))).drop("_head", "_token")
    return out.drop("heads").withColumn("tokens", F.array_sort("tokens"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``rule_id, tokens, label, confidence, support`` from baskets (``tokens``, ``label``)."""
    spark = labelled.sparkSession
    baskets = materialise(labelled.where(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("uid"), "tokens", "label"))
    schema = "rule_id bigint, tokens array<string>, label string, confidence double, support double"
    total = baskets.count()
    if total == 0:
        return spark.createDataFrame([], schema)
    merged, members = _merged(baskets, min_support * total)
    items = F.concat("tokens", F.array(F.concat(F.lit(_LABEL), "label"))).alias("items")
    # Baskets without a frequent token still count for support and confidence.
    rest = baskets.join(merged.select("uid"), "uid", "left_anti").select(F.array(F.concat(F.lit(_LABEL), "label")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(materialise(merged.select(items).union(rest)))
    is_label = F.col("consequent")[0].startswith(_LABEL)
    plain = ~F.exists("antecedent", lambda t: t.startswith(_LABEL))
    rules = materialise(model.associationRules.where(is_label & plain).select(
        F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], len(_LABEL) + 1, 1 << 20).alias("label"),
        "confidence", "support"))
    rules = rules.withColumn("rule_id", F.xxhash64("label", "tokens"))
    # A rule goes if one with a token less says the same with as much confidence.
    shorter = rules.select(F.col("rule_id").alias("long_id"), "label", "confidence", F.explode(F.transform(
        "tokens", lambda t: F.array_except("tokens", F.array(t)))).alias("tokens"))
    beaten = shorter.join(rules.select("label", "tokens", F.col("confidence").alias("other")), ["label", "tokens"]).where(
        F.col("other") >= F.col("confidence")).select(F.col("long_id").alias("rule_id")).distinct()
    kept = materialise(rules.join(beaten, "rule_id", "left_anti"))
    return materialise(_spelled_out(kept, members).withColumn("rule_id", F.xxhash64("label", "tokens"))
                       .select("rule_id", "tokens", "label", "confidence", "support"))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``uid`` and the best rule that fires (``label, confidence, tokens``) for baskets (``uid, tokens``)."""
    posted = rules.select(F.explode("tokens").alias("token"), "rule_id", F.size("tokens").alias("need"))
    looked_up = urls.select("uid", F.explode("tokens").alias("token")).join(posted, "token")
    fired = looked_up.groupBy("uid", "rule_id", "need").agg(F.count(F.lit(1)).alias("found")).where("found = need")
    best = F.struct("confidence", "support", (-F.col("need")).alias("short"), "rule_id", "label", F.col("tokens").alias("mined"))
    return fired.join(rules, "rule_id").groupBy("uid").agg(F.max(best).alias("best")).select("uid", "best.*")


def judge(df: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
          min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per row of ``df``: id, host, path, rule, verdict, and the mined tokens and confidence that decided."""
    url = F.col("url")
    parsed = df.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").alias("id"),
                       F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"))
    parsed = parsed.withColumns({"host": host_of(url), "path": path_of(url)})
    parsed = parsed.withColumns({"list_rule": listed(F.col("host"), F.col("path"), rules),
                                 "tokens": tokens(url, F.col("host"), F.col("path"))}).drop("url")
    rows = materialise(parsed)
    mined = mine(rows.where("list_rule is not null").select("tokens", F.col("list_rule.verdict").alias("label")),
                 min_support, min_confidence)
    found = matched(rows.where("list_rule is null").select("uid", "tokens"), mined)
    return rows.join(found.select("uid", "label", "mined", "confidence"), "uid", "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("list_rule.rule").alias("rule"),
        F.coalesce("list_rule.verdict", "label", F.lit(DEFAULT)).alias("verdict"), "mined", "confidence")
