"""URL filters mined as association rules.

Labelled URLs become transactions of tokens (host labels, path words, query keys), with one more item if the label is
bad. Spark's FP-growth finds the frequent token combinations; a combination is a rule if it occurs with bad labels
often enough (support) and so much more often than URLs in general that chance does not explain it (confidence), and no
subset of it is already a rule. Confidence is taken against the share of bad labels: a rule closes at least
``MIN_GAIN`` of the gap between that share and 1, and by Chernoff's bound it is less likely than ``ALPHA`` that labels
without a bearing on URLs would make any of the combinations of so many frequent tokens a rule. A URL is blocked if it holds all tokens of a rule. Matching goes by an inverted index: each rule
is filed under its rarest token.

Tokens that are rules by themselves are taken out before combinations are mined, and of tokens that always occur
together one (the first in alphabetical order) stands for all; so URLs that are alike in many tokens don't multiply
combinations, and no token is left out for being one of many.

Curated rules (host, path prefix, verdict) come first: one fits its host and all subdomains if the path starts with
its path; the longest wins. The host is what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the
end, with A-Z in lower case; the path runs on to ``?``, ``#`` or the end. A null URL, or one without ``://``, has an
empty host and path and no tokens, and is allowed unless a rule says otherwise. Without labels, or where all are alike,
nothing is mined.
Repeated rows are judged alike, and ties between curated rules of equal length go to the last in alphabetical order.
Very long URLs count whole; an empty table stays empty. Other columns are ignored, whatever their names. Only DataFrame functions (and Spark ML's FP-growth) are
used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pcgspark.llm.common import materialise

MIN_SUPPORT = 0.005  # of labelled URLs, with the bad item
MIN_GAIN, ALPHA = 0.5, 0.01
MIN_ROWS = 5
BROADCAST_RULES = 50_000
BAD = "label=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str) -> Column:
    found = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: str) -> Column:
    """Distinct tokens of a URL; digits are folded, so that page numbers do not count as words."""
    low = F.lower(F.coalesce(F.col(url), F.lit("")))
    rest = F.regexp_extract(low, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    query = F.regexp_extract(rest, r"(?s)^[^?#]*\?([^#]*)", 1)
    tag = lambda prefix, words: F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(prefix), F.regexp_replace(w, r"\d+", "0")))
    parts = F.concat(
        tag("h:", F.split(host(url), r"[.\-:@_]")),
        tag("p:", F.split(F.lower(path(url)), r"[/.\-_]")),
        tag("q:", F.transform(F.split(query, "[&;]"), lambda x: F.substring_index(x, "=", 1))),
    )
    return F.array_distinct(parts)


def holds(with_bad: Column, count: Column, size: Column, base: float, candidates: int, min_gain: float = MIN_GAIN, alpha: float = ALPHA) -> Column:
    """Whether ``with_bad`` of ``count`` bad labels make a rule of ``size`` tokens where ``base`` of all labels are bad."""
    p = with_bad / count
    miss = F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - base))).otherwise(0.0)
    surprise = count * (p * F.log(p / base) + miss)  # no likelier than exp(-surprise) by chance
    return (p > base) & (p >= base + min_gain * (1 - base)) & (surprise >= size * math.log(max(candidates, 1)) - math.log(alpha))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_gain: float = MIN_GAIN) -> DataFrame:
    """(rule_id, items, support, confidence) from rows with ``tokens`` and a boolean ``bad``."""
    from pyspark.ml.fpm import FPGrowth

    empty = labelled.sparkSession.createDataFrame([], "rule_id bigint, items array<string>, support double, confidence double")
    rows = materialise(labelled.select(F.monotonically_increasing_id().alias("id"), F.array_distinct("tokens").alias("tokens"), F.coalesce("bad", F.lit(False)).alias("bad")))
    total, n_bad = rows.agg(F.count(F.lit(1)), F.sum(F.col("bad").cast("bigint"))).first()
    if not total or not n_bad or n_bad == total:
        return empty
    base, least = n_bad / total, max(min_support * total, min(MIN_ROWS, total))
    flat = rows.select("id", "bad", F.explode("tokens").alias("t"))
    counts = flat.groupBy("t").agg(F.count(F.lit(1)).alias("f"), F.sum(F.col("bad").cast("bigint")).alias("with_bad"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("where"))
    often = materialise(counts.filter(F.col("with_bad") >= least))
    candidates = often.count()
    rule = lambda count, size: holds(F.col("with_bad"), F.col(count), size, base, candidates, min_gain)
    often = often.withColumn("rule", rule("f", F.lit(1)))
    single = often.filter("rule").select(F.array("t").alias("items"), "with_bad", F.col("f").alias("freq"))
    rest = often.filter("not rule").groupBy("f", "with_bad", "where").agg(F.min("t").alias("t")).select("t")
    kept = flat.join(rest, "t").groupBy("id", "bad").agg(F.collect_list("t").alias("x"))
    items = materialise(kept.select(F.when(F.col("bad"), F.concat("x", F.array(F.lit(BAD)))).otherwise(F.col("x")).alias("items")))
    rules = single
    if not items.isEmpty():
        # supports of antecedents alone are needed too; they are at least those with the bad item
        found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / items.count(), minConfidence=1.0).fit(items).freqItemsets
        found = found.select(F.array_sort("items").alias("items"), "freq")
        bad = found.filter(F.array_contains("items", BAD) & (F.size("items") > 2)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("with_bad"))
        rules = rules.unionByName(bad.join(found, "items").filter(rule("freq", F.size("items"))).select("items", "with_bad", "freq"))
    rules = materialise(rules.select("items", (F.col("with_bad") / total).alias("support"), (F.col("with_bad") / F.col("freq")).alias("confidence")))
    # a rule that holds another says no more: rules of fewer items are looked up by each of their items
    wider, less = rules.select("items", F.explode("items").alias("t")), rules.select(F.col("items").alias("sub"), F.element_at("items", 1).alias("t"))
    more = wider.join(less, "t").filter((F.size("sub") < F.size("items")) & (F.size(F.array_except("sub", "items")) == 0)).select("items").distinct()
    return materialise(rules.join(more, "items", "left_anti").select(F.xxhash64("items").alias("rule_id"), "items", "support", "confidence"))


def matches(urls: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, n_rules): the mined rules that fit the row's ``tokens``."""
    items = rules.select("rule_id", F.explode("items").alias("t"))
    often = items.join(urls.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("f")), "t", "left")
    filed = often.groupBy("rule_id").agg(F.min(F.struct(F.coalesce("f", F.lit(0)), "t")).alias("x")).select("rule_id", F.col("x.t").alias("t"))
    index = materialise(filed.join(rules.select("rule_id", "items"), "rule_id"))
    index = F.broadcast(index) if index.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else index
    met = urls.select(key, "tokens", F.explode("tokens").alias("t")).join(index, "t").filter(F.size(F.array_except("items", "tokens")) == 0)
    return met.groupBy(key).agg(F.count(F.lit(1)).alias("n_rules"))


def curated_rule(rules: list[tuple[str, str, str]], host_column: Column, path_column: Column) -> tuple[Column, Column]:
    """The longest fitting rule (host and path as one string) and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host_column == h) | host_column.endswith("." + h)) & path_column.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, labels: DataFrame, curated: list[tuple[str, str, str]]) -> DataFrame:
    """The digest: page_id, host, path, rule, verdict, n_rules. A page's label is that of the document with its id; a
    label is bad if its quality is 0 or it is toxic."""
    marked = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    known = pages.select("page_id", "url").join(marked, "page_id").select(tokens("url").alias("tokens"), "bad")
    rules = mine(known)
    urls = pages.select("url").distinct().select("url", tokens("url").alias("tokens"))
    met = matches(urls, rules, "url")
    h, p = host("url"), path("url")
    rule, verdict = curated_rule(curated, F.col("host"), F.col("path"))
    out = pages.select("page_id", "url", h.alias("host"), p.alias("path")).join(met, "url", "left")
    mined = F.when(F.col("n_rules") > 0, "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), F.coalesce("n_rules", F.lit(0)).cast("bigint").alias("n_rules"))
