"""URL filters by association rules; DataFrame functions and Spark's FP-growth only.

Frequent token combinations of labelled urls are mined together with their label; a combination becomes a blocking rule
if it is frequent, short and mostly bad.  Rules are indexed under their rarest token, so a url meets only rules that are
filed under one of its own tokens.  A list of host and path rules comes first.
"""

from __future__ import annotations

import math
import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, small

#: The item that stands for a bad label among the tokens of a url.
BAD = "!bad"
#: (host, path, verdict) of the contract's list.
LISTED = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Frequent tokens of a basket up to which FP-growth takes it whole.
WIDE = 12
#: Mined rules that may be broadcast.
RULES = 20_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null and for a url without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(url, pattern, 2)


def listed_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def tokens(url: Column) -> Column:
    """Distinct tokens: words of the host, parts of the path, names in the query; numbers are one token."""
    host, path = host_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda q: F.concat(F.lit("q:"), F.regexp_extract(q, "^([^=]*)", 1)))
    parts = F.transform(F.split(F.lower(path), "[/.]"), lambda p: F.concat(F.lit("p:"), F.regexp_replace(p, "[0-9]+", "0")))
    words = F.transform(F.split(host, "[.-]"), lambda w: F.concat(F.lit("h:"), w))
    return F.array_distinct(F.filter(F.concat(words, parts, names), lambda t: F.length(t) > 2))


def group_sets(groups: Column, most: int) -> Column:
    """All subsets of 1 to ``most`` members of a sorted array of distinct integers, each sorted."""
    level = every = F.transform(groups, lambda g: F.array(g))
    for _ in range(most - 1):
        level = F.flatten(F.transform(level, lambda s: F.transform(F.filter(groups, lambda g: g > F.element_at(s, -1)), lambda g: F.array_append(s, g))))
        every = F.concat(every, level)
    return every


def short_baskets(baskets: DataFrame, max_tokens: int) -> tuple[DataFrame, int]:
    """(baskets (tag, items, bad) of few items, number of groups) that keep the support of every combination of at most ``max_tokens`` tokens.

    FP-growth knows no greatest length, so a url of many frequent tokens would yield all its subsets.  When some basket has
    more than ``WIDE``, tokens fall into as many groups as that basket has tokens, and each basket is replaced by one
    for every set of at most ``max_tokens`` groups it has tokens in, holding those tokens.  A combination is counted
    where the set is that of its own groups, once for each basket that holds it.  Otherwise there is one group.
    """
    longest = baskets.agg(F.coalesce(F.max(F.size("items")), F.lit(0))).first()[0]
    count = longest if longest > WIDE else 1
    put = F.transform("items", lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(count)).cast("int").alias("g"), t.alias("t")))
    put = baskets.select(put.alias("put"), "bad").withColumn("groups", F.array_sort(F.array_distinct("put.g")))
    each = put.select("put", "bad", F.explode(group_sets(F.col("groups"), max_tokens if count > 1 else 1)).alias("set"))
    held = F.transform(F.filter("put", lambda e: F.array_contains("set", e["g"])), lambda e: e["t"])
    return each.select(F.array_join("set", ".").alias("tag"), held.alias("items"), "bad"), count


def mine_rules(labelled: DataFrame, min_support: float, min_count: int, min_confidence: float, max_tokens: int) -> DataFrame:
    """(items, anchor, n, confidence) from (url, bad); items: the tokens of a combination that is mostly bad.

    Only tokens that are often enough in bad urls can be part of a rule; the others leave before mining.  The work grows
    with the number of combinations of up to ``max_tokens`` tokens, not with all subsets of a url's tokens.
    """
    spark = labelled.sparkSession
    schema = "items array<string>, anchor string, n long, confidence double"
    baskets = cut(labelled.select(tokens(F.col("url")).alias("items"), F.coalesce("bad", F.lit(False)).alias("bad")).filter(F.size("items") > 0))
    n = baskets.count()
    least = max(min_count, math.ceil(min_support * n))
    often = baskets.filter("bad").select(F.explode("items").alias("t")).groupBy("t").count().filter(F.col("count") >= least).select("t")
    seated = baskets.withColumn("_b", F.monotonically_increasing_id()).select("_b", "bad", F.explode("items").alias("t"))
    baskets = cut(seated.join(small(often), "t").groupBy("_b").agg(F.collect_list("t").alias("items"), F.first("bad").alias("bad")))
    short, count = short_baskets(baskets, max_tokens)
    named = F.transform("items", lambda t: F.concat("tag", F.lit("|"), t))
    short = cut(short.select(F.when(F.col("bad"), F.array_append(named, F.concat("tag", F.lit("|" + BAD)))).otherwise(named).alias("items")))
    total = short.count()
    if total < least:
        return spark.createDataFrame([], schema)
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total).fit(short).freqItemsets.filter(F.size("items") <= max_tokens + 1)
    found = found.select(F.substring_index(F.col("items")[0], "|", 1).alias("tag"), F.sort_array(F.transform("items", lambda t: F.regexp_replace(t, r"(?s)^[0-9.]+\|", ""))).alias("items"), "freq")
    plain = F.filter("items", lambda t: t != BAD)
    own = F.array_join(F.array_sort(F.array_distinct(F.transform(plain, lambda t: F.pmod(F.xxhash64(t), F.lit(count)).cast("int")))), ".")
    found = cut(found.filter((F.size(plain) > 0) & (own == F.col("tag"))).select(plain.alias("items"), F.array_contains("items", BAD).alias("bad"), "freq"))
    whole = found.filter("NOT bad").select("items", "freq")
    alone = whole.filter(F.size("items") == 1).select(F.col("items")[0].alias("t"), F.col("freq").alias("f"))
    bad = found.filter("bad").select("items", F.col("freq").alias("n")).filter(F.size("items") <= max_tokens)
    rules = bad.join(whole, "items").withColumn("confidence", F.col("n") / F.col("freq")).filter(F.col("confidence") >= min_confidence)
    rarest = rules.select("*", F.explode("items").alias("t")).join(alone, "t").groupBy("items", "n", "confidence").agg(F.min_by("t", F.struct("f", "t")).alias("anchor"))
    return rarest.select("items", "anchor", "n", "confidence")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, n_rules, confidence): the distinct urls that hold all tokens of a rule, found by the rules' rarest tokens."""
    held = urls.select("url").distinct().withColumn("tokens", tokens(F.col("url"))).select("url", "tokens", F.explode("tokens").alias("anchor"))
    hits = held.join(small(rules, RULES), "anchor").filter(F.size(F.array_intersect("items", "tokens")) == F.size("items"))
    return hits.groupBy("url").agg(F.count(F.lit(1)).alias("n_rules"), F.max("confidence").alias("confidence"))


def filter_urls(pages: DataFrame, labels: DataFrame, listed=LISTED, min_support: float = 0.001, min_count: int = 10, min_confidence: float = 0.7, max_tokens: int = 3) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_rules) per row of ``pages``; labels: (page_id, bad).

    verdict is that of the longest listed rule that fits, else ``block`` if a mined rule matches, else ``allow``.  A null
    url, or one without ``://``, has empty host and path, no tokens and the verdict allow.  A null page_id is returned as
    null and has no label; labels that are null count as good; a page labelled several times is bad if one label is.
    Repeated rows are returned as often as they come; other columns are not read; empty tables are allowed.
    """
    pages = pages.select("page_id", "url")
    labels = labels.groupBy(F.col("page_id").alias("_id")).agg(F.max(F.coalesce("bad", F.lit(False))).alias("bad"))
    rules = cut(mine_rules(pages.join(labels, F.col("page_id") == F.col("_id")).select("url", "bad"), min_support, min_count, min_confidence, max_tokens))
    hits = match_rules(pages, rules).select(F.col("url").alias("_url"), "n_rules")
    host, path = host_path(F.col("url"))
    judged = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    judged = judged.withColumn("rule", rule).withColumn("verdict", verdict)
    return judged.join(hits, F.col("url") == F.col("_url"), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("n_rules") > 0, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("n_rules", F.lit(0)).alias("n_rules"),
    )
