"""Association rules over URL tokens.

Curated rules (a host, a path prefix, allow or block) judge the URLs that they fit; the longest rule
wins, a host's rule fits its subdomains. The URLs so labelled are transactions of their host's and
path's tokens together with their verdict, which Spark's FP-growth mines. Tokens that stand in the same
labelled URLs are one item, named by the least of them: together they would only multiply every itemset. An itemset
counts from the share ``support`` of the labelled URLs on, and from ``least`` of them, so that a small table does not make
every subset of every URL frequent. Of the rules whose consequent is a verdict, those below the confidence are dropped, and those that a shorter rule subsumes: one whose
tokens are a proper subset, of the same verdict and at least its confidence. A URL that no curated rule
fits gets the verdict of its best mined rule (confidence, then support, then fewer tokens, then block),
found through an inverted index: each mined rule is filed under its rarest token, URLs look up their
tokens there, and the other tokens are verified. Without any match the default verdict holds.

Null URLs and those without ``://`` have an empty host and path, no tokens and the default verdict; rows
that repeat are judged each; equal rules are told apart by their tokens' names; a very long URL is one row in one task; other columns are not touched. Where
fewer than ``least`` URLs are labelled, as in an empty table, nothing is mined. Numbers in paths and values of query
arguments are not tokens.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = "=>"
#: Mined rules up to which their index (about 200 bytes a rule) is broadcast; beyond it, it is joined by key.
BROADCAST_RULES = 20_000


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and the rest of a URL."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path, F.regexp_extract(after, r"(?s)^[^?#]*(.*)$", 1)


def curated(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest curated rule (host, path, verdict) that fits, or nulls."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


#: A host's name has so many labels at most; of what is no name the suffixes go no further.
LABELS = 127


def tokens(host: Column, path: Column, rest: Column) -> Column:
    """Distinct tokens: the host's labels and their parts, its suffixes, the path's segments by place, its ending and the query's names."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    suffixes = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.least(n, F.lit(LABELS))), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, n - i + 1, i), ".")))).otherwise(F.array().cast("array<string>"))
    words = F.transform(F.filter(F.split(host, r"[.\-]"), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    segments = F.filter(F.split(path, "/"), lambda x: (x != "") & ~F.regexp_like(x, F.lit(r"[0-9]")))
    placed = F.transform(segments, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), x))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    names = F.transform(F.filter(F.split(F.regexp_extract(rest, r"^\?([^#]*)", 1), "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.split(x, "=")[0]))
    return F.array_distinct(F.concat(suffixes, words, placed, F.when(ending != "", F.array(F.concat(F.lit("e:"), ending))).otherwise(F.array().cast("array<string>")), names))


def merged(labelled: DataFrame) -> DataFrame:
    """(token, item) of all tokens: the item is the least token that stands in the same rows."""
    placed = labelled.withColumn("_row", F.monotonically_increasing_id()).select("_row", F.explode("tokens").alias("token"))
    where = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("_row")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "_row")).alias("y")]
    rows = cut(placed.groupBy("token").agg(*where))
    return rows.join(rows.groupBy("n", "x", "y").agg(F.min("token").alias("item")), ["n", "x", "y"]).select("token", "item", "n")


def mine(labelled: DataFrame, *, support: float, confidence: float, least: int = 10) -> DataFrame:
    """(antecedent, verdict, confidence, support) of the pruned rules, from (tokens, verdict)."""
    labelled = cut(labelled)
    total = labelled.count()
    needed = max(least, math.ceil(support * total))
    if total < needed:
        return labelled.select(F.col("tokens").alias("antecedent"), "verdict", F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support")).where(F.lit(False))
    # only items that can be frequent reach the baskets; one that stands in all of them tells nothing
    items = merged(labelled).where((F.col("n") >= needed) & (F.col("n") < total) & (F.col("token") == F.col("item"))).select("token", "item")
    few = F.broadcast(items) if items.count() <= BROADCAST_RULES else items
    numbered = labelled.withColumn("_row", F.monotonically_increasing_id())
    baskets = numbered.select("_row", "verdict", F.explode("tokens").alias("token")).join(few, "token").groupBy("_row", "verdict").agg(F.collect_set("item").alias("items"))
    baskets = baskets.select(F.array_append("items", F.concat(F.lit(LABEL), "verdict")).alias("items"))
    baskets = cut(baskets)  # FP-growth reads them twice
    # rows without a frequent token make no basket, but count
    share = (needed - 0.5) / max(baskets.count(), 1)
    model = FPGrowth(itemsCol="items", minSupport=min(share, 1.0), minConfidence=confidence).fit(baskets)
    found = model.associationRules.where(F.col("consequent")[0].startswith(LABEL) & ~F.exists("antecedent", lambda x: x.startswith(LABEL)))
    of_all = F.col("support") * F.lit(baskets.count() / total)
    found = cut(found.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], len(LABEL) + 1, 1000).alias("verdict"), "confidence", of_all.alias("support")))
    # a subsuming rule shares its first token with the rule, so candidates meet by equality
    short = found.select(F.col("antecedent").alias("a"), "verdict", F.col("confidence").alias("c"), F.col("antecedent")[0].alias("t"))
    long = found.select("*", F.explode("antecedent").alias("t"))
    subsumed = long.join(short, ["t", "verdict"]).where((F.size("a") < F.size("antecedent")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("a", "antecedent")) == 0))
    return found.join(subsumed.select("antecedent", "verdict").distinct(), ["antecedent", "verdict"], "left_anti")


def judge(df: DataFrame, rules: Sequence[tuple[str, str, str]], *, key: str = "page_id", url: str = "url", support: float = 0.002, confidence: float = 0.8, least: int = 10, default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict, mined) of each row; mined: the mined rule's tokens where one decided.

    support, least: least share and number of the labelled URLs that hold a rule's tokens and verdict.
    """
    host, path, rest = parts(F.col(url))
    rows = df.select(key, host.alias("host"), path.alias("path"), rest.alias("_rest"))
    rule, verdict = curated(F.col("host"), F.col("path"), rules)
    rows = rows.select(F.monotonically_increasing_id().alias("_row"), key, "host", "path", rule.alias("rule"), verdict.alias("_curated"), tokens(F.col("host"), F.col("path"), F.col("_rest")).alias("tokens"))
    rows = cut(rows)  # three readers, and one numbering of the rows for all of them
    labelled = rows.where(F.col("_curated").isNotNull() & (F.size("tokens") > 0)).select("tokens", F.col("_curated").alias("verdict"))
    found = cut(mine(labelled, support=support, confidence=confidence, least=least))
    use = found.select("antecedent", "verdict", "confidence", "support")
    rarity = labelled.select(F.explode("tokens").alias("t")).groupBy("t").count()
    filed = use.select("*", F.explode("antecedent").alias("t")).join(rarity, "t").groupBy("antecedent", "verdict", "confidence", "support").agg(F.min_by("t", F.struct("count", "t")).alias("t"))
    index = F.broadcast(filed) if found.count() <= BROADCAST_RULES else filed
    rank = F.struct("confidence", "support", -F.size("antecedent"), (F.col("verdict") != default).alias("other"), F.array_join("antecedent", " ").alias("name"))
    open_rows = rows.where(F.col("_curated").isNull())
    hits = open_rows.select("_row", "tokens", F.explode("tokens").alias("t")).join(index, "t").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = hits.groupBy("_row").agg(F.max_by("verdict", rank).alias("_mined"), F.max_by(F.array_join("antecedent", " "), rank).alias("mined"))
    return rows.join(best, "_row", "left").select(key, "host", "path", "rule", F.coalesce("_curated", "_mined", F.lit(default)).alias("verdict"), "mined")
