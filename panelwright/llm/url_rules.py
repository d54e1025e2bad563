"""URL verdicts: fixed rules on host and path, else rules mined from labelled URLs."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.skew import broadcast_if_small
from panelwright.sources.writers import settle

#: A mined rule needs so many bad labelled URLs, whatever their number in all, and this share of bad ones among those it fits.
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.0, 20, 0.6
#: That share, lowered by so many standard errors (Wilson's bound), must still reach the share of bad ones among all URLs.
BOUND = 5.0

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, group), F.lit(""))


def host_of(url: Column) -> Column:
    """Host with A-Z lower-cased; empty for NULL and for text without ``://``."""
    return F.translate(_part(url, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return _part(url, 2)


def url_tokens(url: Column) -> Column:
    """Distinct parts of a URL: labels of the host, segments of the path, names in the query, the fragment.

    Digits stand as one ``#``, so that numbered pages share a token. A URL without a host has no tokens.
    """
    split = lambda text, by: F.array_remove(F.split(text, by), "")
    tail = _part(url, 3)
    tagged = lambda tag, parts: F.transform(parts, lambda x: F.concat(F.lit(tag), F.regexp_replace(x, "[0-9]+", "#")))
    query = split(F.regexp_extract(tail, r"(?s)^\?([^#]*)", 1), "&")
    names = F.transform(query, lambda x: F.regexp_extract(x, "(?s)^([^=]*)", 1))
    mark = F.when(tail.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    found = F.array_distinct(F.concat(tagged("host:", split(host_of(url), r"\.")), tagged("path:", split(path_of(url), "/")),
                                      tagged("query:", names), mark))
    return F.when(host_of(url) == "", F.array().cast("array<string>")).otherwise(found)


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; NULL if none does.

    A rule is (verdict, ``host/path``); it fits its host and all subdomains where the path starts with the rule's path. Of
    two rules of one length the one that comes first in the list wins.
    """
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        rule_host, slash, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + rule_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def mine_rules(labelled: DataFrame, url_col: str = "url", bad_col: str = "bad", min_support: float = MIN_SUPPORT,
               min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, bound: float = 0.0) -> DataFrame:
    """(tokens, confidence, n): sets of URL tokens that make a URL bad.

    FP-growth mines the bad URLs, and the sets it finds are then counted in all of them. A rule's tokens occur in
    ``min_count`` bad rows (n) and in ``min_support`` of all rows at least; ``min_confidence`` of the rows with these tokens are bad, and
    Wilson's lower bound of that share, at ``bound`` standard errors, is not below the share of all rows. The bar is a count, so a
    host that is caught among few labels is caught among many. A NULL label is not bad. No labels give no rules.
    """
    bad = F.coalesce(F.col(bad_col), F.lit(False))
    baskets = settle(labelled.select(url_tokens(F.col(url_col)).alias("items"), bad.alias("bad")), "baskets")
    size = baskets.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad")).first()
    need = max(min_count, ceil(min_support * size["n"]), 1)
    if size["bad"] < need:
        return baskets.sparkSession.createDataFrame([], "tokens array<string>, confidence double, n bigint")
    sets = FPGrowth(minSupport=(need - 0.5) / size["bad"], minConfidence=1.0).fit(baskets.where("bad")).freqItemsets
    sets = settle(sets.select(F.sort_array("items").alias("tokens"), F.col("freq").alias("n")), "sets")
    has = baskets.select(F.col("items").alias("has"), F.explode("items").alias("t"))
    met = has.join(_filed(sets), "t").where(F.size(F.array_except("tokens", "has")) == 0)
    counted = met.groupBy("tokens", "n").agg(F.count(F.lit(1)).alias("_all"))
    share, m = F.col("n") / F.col("_all"), F.col("_all")
    spread = F.sqrt(share * (1 - share) / m + bound ** 2 / (4 * m * m))
    lower = (share + bound ** 2 / (2 * m) - bound * spread) / (1 + bound ** 2 / m)
    chosen = counted.where((share >= min_confidence) & (lower >= size["bad"] / size["n"]))
    return settle(chosen.select("tokens", share.alias("confidence"), "n"), "rules")


def _filed(sets: DataFrame) -> DataFrame:
    """Inverted index of token sets: each filed under that of its tokens which the fewest sets have."""
    rest = [c for c in sets.columns if c != "tokens"]
    spread = sets.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("k"))
    filed = sets.select("tokens", *rest, F.explode("tokens").alias("t")).join(spread, "t")
    filed = filed.groupBy("tokens", *rest).agg(F.min(F.struct("k", "t"))["t"].alias("t"))
    return broadcast_if_small(settle(filed.select("t", "tokens", *rest), "index"))


def matched_rules(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """(``url_col``, n_rules, confidence): number of mined rules that fit, and the best confidence, for each distinct URL
    that any fits.

    Inverted index: every rule is filed under its rarest token, so a URL meets only rules that share that token, and the
    rest of the rule is compared there.
    """
    index = _filed(rules.select("tokens", "confidence"))
    mine = urls.select(F.col(url_col).alias("u")).where("u IS NOT NULL").distinct().select("u", url_tokens(F.col("u")).alias("has"))
    met = mine.select("u", "has", F.explode("has").alias("t")).join(index, "t").where(F.size(F.array_except("tokens", "has")) == 0)
    return met.groupBy(F.col("u").alias(url_col)).agg(F.count(F.lit(1)).alias("n_rules"), F.max("confidence").alias("confidence"))


def judge_urls(pages: DataFrame, mined: DataFrame, rules: Sequence[tuple[str, str]], url_col: str = "url",
               keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """(``keep``, host, path, rule, verdict, n_rules, confidence) of every row, repeated rows included.

    The longest fixed rule decides; without one, a URL that fits a mined rule is blocked and any other is allowed. A NULL
    URL, or one without ``://``, has an empty host and path and is allowed.
    """
    url = F.col(url_col)
    host, path = host_of(url), path_of(url)
    rule, verdict = fixed_rule(host, path, rules)
    base = pages.select(*keep, url.alias("_url"), host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("_fixed"))
    found = matched_rules(pages, mined, url_col).select(F.col(url_col).alias("_u"), "n_rules", "confidence")
    out = base.join(found, F.col("_url") == F.col("_u"), "left").withColumn("n_rules", F.coalesce("n_rules", F.lit(0)).cast("long"))
    out = out.withColumn("verdict", F.coalesce("_fixed", F.when(F.col("n_rules") > 0, "block").otherwise("allow")))
    return out.select(*keep, "host", "path", "rule", "verdict", "n_rules", "confidence")
