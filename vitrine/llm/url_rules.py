"""URL filters: host and path rules, and association rules mined by FP-growth.

A host rule fits its host and all subdomains where the URL's path starts with
the rule's path; the longest that fits decides. Its verdicts are also labels:
the tokens of labelled URLs (host labels with their place, path parts, the
first ones with their place, file ending, names of query parameters, fragment) and the verdict form the
transactions from which Spark's FP-growth mines which combinations of tokens
go with ``block`` or ``allow``. Rules below the support or the confidence are
pruned, and so are rules that a shorter one with the same verdict makes
superfluous (its tokens among theirs, its confidence no less).

The mined rules judge the URLs that no host rule fits. They are matched by an
inverted index: each rule is filed under its rarest token, a URL's tokens are
looked up there, and the whole combination is tested on what is found. The
strongest match decides (confidence, then support, then ``block`` before
``allow``, then the tokens in order); without a match a URL is allowed.

DataFrame functions and Spark's FP-growth only. A URL has few tokens, mined
rules number at most what the support allows; everything else stays
distributed, and the aggregate of matches per URL is partial.

Defined cases: a null URL or one without ``://`` has an empty host and path,
no rule and no tokens, and is allowed; with no labels or none of one kind, rules
for that kind do not exist; repeated rows are judged alike, each on its own;
rows keep all their columns (columns named like the output's are replaced);
of two host rules of one text the last counts.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import written

#: Host, path, verdict: fixed by the task.
HOST_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.9
#: Path parts whose tokens have their place, later ones have none; host rules that are written into the plan.
PATH_PARTS = 2
MOST_HOST_RULES = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LABEL = "verdict="


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL, none with a page's number in it."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    back = F.reverse(labels)
    from_end = F.transform(back, lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit("="), x))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    # a part of digits stands for any number, with or without a file ending
    shapes = F.transform(parts, lambda x, i: F.concat(
        F.lit("path"), F.when(i < PATH_PARTS, i.cast("string")).otherwise(F.lit("")), F.lit("="), F.regexp_replace(x, "[0-9]+", "0")))
    # of the path's last part, unless the path ends with a slash
    ending = F.translate(F.regexp_extract(path, r"[^/]\.([A-Za-z0-9]+)$", 1), _UPPER, _LOWER)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.substring_index(x, "=", 1)))
    fragment = F.regexp_extract(url, r"(?s)#(.*)$", 1)
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    all_ = F.concat(F.array(F.concat(F.lit("scheme="), scheme)), from_end, shapes, names,
                    F.when(ending != "", F.array(F.concat(F.lit("ending="), ending))).otherwise(F.array().cast("array<string>")),
                    F.when(fragment != "", F.array(F.concat(F.lit("fragment="), fragment))).otherwise(F.array().cast("array<string>")))
    return F.when(url.contains("://"), F.array_distinct(all_)).otherwise(F.array().cast("array<string>"))


def host_verdict(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls."""
    if len(rules) > MOST_HOST_RULES:
        raise ValueError(f"more than {MOST_HOST_RULES} host rules")
    last = {h.translate(str.maketrans(_UPPER, _LOWER)) + p: (h.translate(str.maketrans(_UPPER, _LOWER)), p, v) for h, p, v in rules}
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, (h, p, v) in sorted(last.items(), key=lambda r: (len(r[0]), r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(text)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``labelled(tokens array<string>, label string)`` -> rules ``(tokens, label, confidence, support)``."""
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "tokens array<string>, label string, confidence double, support double")
    baskets = labelled.where("label IS NOT NULL").select(
        F.concat("tokens", F.array(F.concat(F.lit(_LABEL), F.col("label")))).alias("items"))
    if not baskets.take(1):
        return empty
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where(F.col("consequent")[0].startswith(_LABEL)).select(
        F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], len(_LABEL) + 1, 1_000_000).alias("label"),
        "confidence", "support")
    found = found.where(~F.exists("tokens", lambda x: x.startswith(_LABEL)))
    found = written(found, "url-rules")
    # a rule's shorter rivals share one of its tokens: look them up by token, then test
    shorter = found.select(F.col("tokens").alias("few"), "label", F.col("confidence").alias("sure"), F.explode("tokens").alias("token"))
    beaten = (found.select("*", F.explode("tokens").alias("token")).join(shorter, ["token", "label"])
              .where((F.size("few") < F.size("tokens")) & (F.size(F.array_except("few", "tokens")) == 0) & (F.col("sure") >= F.col("confidence")))
              .select("tokens", "label").distinct())
    return found.join(beaten, ["tokens", "label"], "left_anti").select("tokens", "label", "confidence", "support")


def judge(urls: DataFrame, rules: DataFrame, key_cols: list[str], tokens_col: str = "tokens") -> DataFrame:
    """``(key_cols, verdict)`` of the rows that a mined rule matches; rows come with their tokens."""
    counts = urls.select(F.explode(tokens_col).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    filed = (rules.withColumn("rule", F.struct("tokens", "label")).select("*", F.explode("tokens").alias("token"))
             .join(counts, "token", "left")
             .groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token").alias("token")))["token"].alias("token"),
                                  F.first("confidence").alias("confidence"), F.first("support").alias("support")))
    # of several matches the least of this order decides
    order = F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), (F.col("rule.label") != "block").alias("b"),
                     F.col("rule.tokens").alias("t"), F.col("rule.label").alias("label"))
    return (urls.select(*key_cols, F.col(tokens_col).alias("__tokens"), F.explode(tokens_col).alias("token"))
            .join(filed, "token").where(F.size(F.array_except("rule.tokens", "__tokens")) == 0)
            .groupBy(*key_cols).agg(F.min(order)["label"].alias("verdict")))


def filter_urls(pages: DataFrame, url_col: str = "url", host_rules: list[tuple[str, str, str]] = HOST_RULES,
                min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``pages`` with host, path, rule (null: no host rule fits) and verdict (allow or block)."""
    out = ["host", "path", "rule", "verdict"]
    kept = [c for c in pages.columns if c not in out]
    url = F.col(url_col)
    rule, verdict = host_verdict(F.col("host"), F.col("path"), host_rules)
    # every URL is judged once, however often it occurs
    distinct = pages.select(url.alias("url")).where("url IS NOT NULL").distinct()
    facts = written(distinct.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
                    .withColumn("rule", rule).withColumn("label", verdict).withColumn("tokens", tokens_of(F.col("url"))), "urls")
    rules = written(mine(facts.select("tokens", "label"), min_support, min_confidence), "url-rules")
    mined = written(judge(facts.where("rule IS NULL"), rules, ["url"]), "url-verdicts")
    named = facts.select("url", "rule", "label").join(mined, "url", "left").select(
        F.col("url").alias("__url"), F.col("rule").alias("__rule"), F.coalesce("label", "verdict", F.lit("allow")).alias("__verdict"))
    return (pages.join(named, pages[url_col] == F.col("__url"), "left")
            .select(*[pages[c] for c in kept], host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"),
                    F.col("__rule").alias("rule"), F.coalesce("__verdict", F.lit("allow")).alias("verdict")))
