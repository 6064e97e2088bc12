"""Quality by hierarchical empirical Bayes over sites.

A document's own evidence is a tempered naive-Bayes log-likelihood ratio over the bins of its statistics,
estimated from labelled rows. A site's quality is a proportion: of labels where there are any, of the
documents' own posteriors elsewhere. Hosts shrink towards the corpus, the host's paths towards the host,
each level by the weight that its spread beyond chance calls for (method of moments). A document's score
combines its evidence with the posterior of its path without itself.

Everything is DataFrame expressions and grouped sums. The tables of ratios have a fixed size. Null texts
count as empty; null hosts or paths are sites of their own; labels that repeat count once, a row without a key is
never labelled; rows that repeat are scored each; a very long text is counted whole, in one task; of labels that
contradict each other the good one counts; other columns are not touched. Without labels the
evidence is 0 and the prior even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .quality_rules import BROADCAST_GROUPS, P, features, statistics

#: Bins to one unit of a feature, and bins either side of zero; values beyond fall into the last.
FINE, EDGE = 3, 30
TEMPER = 0.6


def _bin(i: int) -> Column:
    return (F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), F.floor(F.col(f"_x{i}") * FINE))) + EDGE).cast("int")


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _joined(x: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    return x.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, key)


def shrunk(sums: DataFrame, n: str, s: str, centre: Column) -> float:
    """Documents' worth of evidence of the level above: from the spread of the groups' proportions beyond that of chance."""
    p = F.col(s) / F.col(n)
    r = sums.where(F.col(n) > 1).agg(F.sum(F.col(n) * (p - centre) ** 2).alias("between"), F.sum(centre * (1 - centre)).alias("chance"), F.sum(n).alias("n"), F.sum(F.col(n) * centre * (1 - centre)).alias("v")).first()
    if not r["n"] or not r["v"]:
        return 10.0
    spread = max((r["between"] - r["chance"]) / r["n"], 0.0)
    within = r["v"] / r["n"]
    return min(max(within / spread - 1 if spread > 0 else 1e4, 1.0), 1e4)


def score(df: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality") -> DataFrame:
    """(key, evidence, site, score) of each row; site: the posterior of its path without itself."""
    x = features(statistics(df.select(F.col(key), F.col(text), F.col(host).alias("_host"), F.col(path).alias("_path")), text).drop(text), lang="_path", source="_host")
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_y"))
    x = cut(x.join(known, key, "left").select(key, F.coalesce(F.concat(F.lit("="), F.col("_host").cast("string")), F.lit("")).alias("_h"), "_g", "_y", *(_bin(i).alias(f"_b{i}") for i in range(P))))
    bins = x.where(F.col("_y").isNotNull()).select("_y", F.posexplode(F.array(*(F.col(f"_b{i}") for i in range(P)))).alias("i", "b"))
    rows = bins.groupBy("i", "b").agg(F.sum("_y").alias("good"), F.sum(1 - F.col("_y")).alias("bad")).collect()  # P * (2 * EDGE + 1) rows at most
    evidence = F.lit(0.0)
    for i in range(P):
        own = {r["b"]: (r["good"], r["bad"]) for r in rows if r["i"] == i}
        good, bad = (sum(v[k] for v in own.values()) for k in (0, 1))
        width = 2 * EDGE + 1
        ratio = [((g + 0.5) / (good + 0.5 * width)) / ((b + 0.5) / (bad + 0.5 * width)) for g, b in (own.get(k, (0, 0)) for k in range(width))] if good and bad else [1.0] * width
        evidence = evidence + F.element_at(F.array(*(F.log(F.lit(v)) for v in ratio)), F.col(f"_b{i}") + 1)
    total = x.agg(F.avg("_y")).first()[0]
    base = 0.5 if total is None else float(total)
    x = x.select(key, "_h", "_g", "_y", (TEMPER * evidence).alias("evidence"))
    x = cut(x.withColumn("_p", F.coalesce(F.col("_y").cast("double"), 1 / (1 + F.exp(-F.col("evidence") - _logit(F.lit(base)))))))
    paths = cut(x.groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("n"), F.sum("_p").alias("s")))
    hosts = cut(paths.groupBy("_h").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = whole["s"] / whole["n"] if whole["n"] else 0.5
    weight = shrunk(hosts, "n", "s", F.lit(mean))
    hosts = hosts.select("_h", ((F.col("s") + weight * mean) / (F.col("n") + weight)).alias("_host_mean"))
    paths = cut(paths.join(hosts, "_h"))
    weight = shrunk(paths, "n", "s", F.col("_host_mean"))
    site = (F.col("s") - F.col("_p") + weight * F.col("_host_mean")) / (F.col("n") - 1 + weight)
    near = _joined(x, paths.drop("_h"), "_g").withColumn("site", site)
    return near.select(key, "evidence", "site", (1 / (1 + F.exp(-F.col("evidence") - _logit(F.col("site"))))).alias("score"))
