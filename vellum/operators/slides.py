"""Slide decks as tables of units (slide, path, para, text, kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import text as X
from . import order


def wanted() -> Column:
    """Units with a letter."""
    return F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"\p{L}"))


#: Signs of an order value that hold a place inside a part.
PLACE = 31


def _order(parts: DataFrame) -> Column:
    """(pos, i) as one number where the positions' range allows it, which a hash table's row can hold; else as a pair, for which Spark sorts all rows."""
    if isinstance(parts.schema["pos"].dataType, T.IntegralType):
        low, high = parts.agg(F.min(F.col("pos").cast("long")), F.max(F.col("pos").cast("long"))).first()
        if low is None or high - low < (1 << PLACE) - 1:
            # a null position comes first
            at = F.coalesce(F.col("pos").cast("long") - F.lit(low or 0).cast("long") + 1, F.lit(0).cast("long"))
            return F.shiftleft(at, PLACE) + F.col("i")
    return F.struct("pos", "i")


def unreachable(parts: DataFrame) -> DataFrame:
    """(deck, n, text): distinct texts with a letter in chart and diagram XML (deck, pos, xml), by first occurrence."""
    found = parts.select("deck", "pos", F.posexplode(F.regexp_extract_all("xml", F.lit(r"<(?:a:t|c:v)>([^<]*+)</(?:a:t|c:v)>"), 1)).alias("i", "text"))
    first = found.groupBy("deck", "text").agg(F.min(_order(parts)).alias("_at"))
    # a text is searched for a letter once, not at each occurrence: a condition on the text alone would be moved before the count
    first = first.where(F.when(wanted(), F.col("_at")).isNotNull())
    return order.numbered(first, ["deck"], ["_at"]).select("deck", "n", "text")


def fits(text: Column, width: Column, height: Column, size: Column, kind: Column) -> Column:
    """Whether a text is estimated to fit its box (points); tables, notes and boxes of unknown size always do."""
    wide = X.count_of(text, "[가-힣]")
    em = wide + 0.5 * (F.length(text) - wide)
    pt = F.coalesce(size, F.lit(18.0))
    lines = em / F.greatest(F.lit(1.0), width / pt)
    open_ended = kind.isin("table", "notes") | width.isNull() | height.isNull() | (width <= 0) | (height <= 0)
    return open_ended | (lines * pt * 1.25 <= height * 1.05)


def shrunk(size: Column) -> Column:
    """One step smaller, not under 8; inherited sizes stay unknown."""
    return F.when(size.isNotNull(), F.greatest(F.lit(8.0), size * 0.85))


def applied(runs: DataFrame, translations: DataFrame) -> DataFrame:
    """Runs (slide, path, para, i, text) with a paragraph's translation in its longest run, the first on ties, and the others empty."""
    key = ["slide", "path", "para"]
    longest = F.max_by("i", F.struct(F.length("text"), -F.col("i"))).over(W.partitionBy(*key))
    joined = runs.withColumn("_main", longest).join(translations.select(*key, F.col("text").alias("_new")), key, "left")
    new = F.when(F.col("_new").isNull() | (F.col("_new") == ""), F.col("text")).when(F.col("i") == F.col("_main"), F.col("_new")).otherwise("")
    return joined.select(*key, "i", new.alias("text"))


def verdict(reply: Column) -> Column:
    """keep: Korean enough, or nothing to translate; else echoed."""
    letters = X.count_of(reply, r"\p{L}")
    return F.when(letters == 0, "keep").when(X.hangul_ratio(reply) >= 0.3, "keep").otherwise("echoed")


def progress(done: Column, units: Column, unreachable_units: Column) -> Column:
    return F.floor(done * 100 / F.greatest(units + unreachable_units, F.lit(1))).cast("long")
