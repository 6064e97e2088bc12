"""Ligature dictionary: building it from damaged words and dissolving placeholders that stand for one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import DAMAGE, SPACE
from ..shared import written

PAIR = f"([A-Za-z]++){DAMAGE}(-?[A-Za-z]++)"
#: Letters, tags, a placeholder, tags, letters; white space may follow a tag.
_TAGS = rf"((?:</?style[^>]*+>{SPACE}*+)*+)"
WEDGE = rf"([A-Za-z]++){_TAGS}(\{{v\d++\}}){_TAGS}(-?[A-Za-z]++)"


def pairs(df: DataFrame, text: str = "text") -> DataFrame:
    """(l, r) of all words with a damage mark."""
    c = F.col(text)
    both = F.arrays_zip(F.regexp_extract_all(c, F.lit(PAIR), 1).alias("l"), F.regexp_extract_all(c, F.lit(PAIR), 2).alias("r"))
    return df.where(c.contains(DAMAGE)).select(F.inline(both)).distinct()


def _affixes(halves: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Those halves (g1, g5) of which a known pair's left half ends with the first and its right half begins with the second.

    The pairs are filed under the ends of their left halves that have a length which occurs, and what meets a wedge there
    under the beginnings of the right halves, so that both meet by equality: a pair makes no more rows than its
    halves have lengths. Lengths go through the driver, no more than the longest half has letters.
    """
    lengths = lambda c: F.array(*(F.lit(r[0]) for r in sorted(halves.select(F.length(c)).distinct().collect()))).cast("array<int>")
    fitting = lambda c, of: F.explode(F.filter(lengths(of), lambda n: n <= F.length(c)))
    ends = dictionary.select("l", "r").distinct().select("r", F.col("l"), fitting("l", "g1").alias("n")).select("r", F.expr("right(l, n)").alias("g1")).distinct()
    met = ends.join(halves.select("g1").distinct(), "g1", "left_semi")
    begins = met.select("g1", "r", fitting("r", "g5").alias("n")).select("g1", F.expr("left(r, n)").alias("g5")).distinct()
    return halves.join(begins, ["g1", "g5"], "left_semi").select("g1", "g5")


def dissolve(df: DataFrame, dictionary: DataFrame, *, key: str = "id", text: str = "text") -> DataFrame:
    """(key, text, removed): placeholders between halves of a known pair become ff; tags stay.

    A wedge hits exactly, or, with two letters on each side, where its halves end and begin a known pair's.
    """
    c = F.col("_text")
    # a text is known by two hashes of it, so that no wedge carries its text along, and rows may share keys
    rows = df.select(key, F.col(text).alias("_text")).withColumns({"_h": F.xxhash64("_text"), "_i": F.xxhash64(F.lit(1), F.reverse("_text"))})
    group = lambda i: F.regexp_extract_all(c, F.lit(WEDGE), F.lit(i))
    wedges = rows.select("_h", "_i", F.posexplode(F.arrays_zip(group(1).alias("g1"), group(5).alias("g5"))).alias("k", "w")).select("_h", "_i", "k", "w.g1", "w.g5")
    dictionary = written(dictionary.select("l", "r"), "dictionary")
    halves = written(wedges.select("g1", "g5").distinct(), "halves")
    exact = halves.join(dictionary.select(F.col("l").alias("g1"), F.col("r").alias("g5")), ["g1", "g5"], "left_semi").select("g1", "g5")
    affix = _affixes(halves.where((F.length("g1") >= 2) & (F.length(F.regexp_replace("g5", "^-", "")) >= 2)), dictionary)
    hits = written(exact.unionByName(affix).distinct(), "hits")
    # equal texts have equal hits
    by_text = wedges.join(hits, ["g1", "g5"], "left_semi").groupBy("_h", "_i").agg(F.collect_set("k").alias("_k"))
    joined = rows.join(by_text, ["_h", "_i"], "left")
    parts = F.arrays_zip(*(group(i).alias(f"g{i}") for i in range(1, 6)))
    pieces = F.transform(parts, lambda w, k: F.concat(w["g1"], w["g2"], F.when(F.array_contains("_k", k), F.lit("ff")).otherwise(w["g3"]), w["g4"], w["g5"]))
    woven = F.array_join(F.flatten(F.zip_with(F.split(c, WEDGE, -1), pieces, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return joined.select(key, F.when(F.col("_k").isNotNull(), woven).otherwise(c).alias(text), F.when(F.col("_k").isNotNull(), F.size("_k")).otherwise(0).cast("long").alias("removed"))
