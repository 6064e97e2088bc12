"""Validation of source and target pairs: one reason column, the first failing check wins."""

from __future__ import annotations

import hashlib
import inspect
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import ligature

#: Most that a target may be wider than its source.
WIDTH_MAX = 1.35


def marks(c: Column) -> Column:
    return F.array_sort(F.regexp_extract_all(c, F.lit(X.PLACEHOLDER), 0))


def style_dropped(src: Column, tgt: Column) -> Column:
    """A warning only: formatting tags differ in number."""
    return X.count_of(src, X.STYLE_TAG) != X.count_of(tgt, X.STYLE_TAG)


def reason(src: Column, tgt: Column, width_max: float = WIDTH_MAX) -> Column:
    """Why a target is refused, or the empty string.

    The checks are one value made of both texts: a check is not run behind one that fails, and a width is taken once.
    """
    return X.once(F.struct(src.alias("src"), tgt.alias("tgt")), lambda x: _reason(x["src"], x["tgt"], width_max))


def too_wide(src: Column, tgt: Column, width_max: float) -> Column:
    """Whether a source of some width has a target that is much wider."""
    return X.once(X.width(src), lambda sw: (sw >= 10) & (F.try_divide(X.width(tgt), sw) > width_max))


def _reason(src: Column, tgt: Column, width_max: float) -> Column:
    tags = lambda c: c.contains("<") | F.regexp_like(c, F.lit("[〈＜﹤]"))
    checks = [
        (X.is_blank(tgt), "empty output"),
        (marks(src) != marks(tgt), "placeholder"),
        (tags(tgt) & (X.count_of(tgt, X.STYLE_NEAR) > X.count_of(tgt, X.STYLE_TAG)), "malformed style tag"),
        (X.polite(F.btrim(tgt)), "polite ending"),
        (X.has_ascii_letters(src, 12) & (X.hangul_ratio(tgt) < 0.15), "echo"),
        (X.leftover_english(tgt).isNotNull(), "leftover English"),
        (X.has_ascii_letters(src, 12) & too_wide(src, tgt, width_max), "width"),
    ]
    out = F.lit("")
    for failed, name in reversed(checks):
        out = F.when(failed, F.lit(name)).otherwise(out)
    return out


def check(items: DataFrame, outputs: DataFrame) -> DataFrame:
    """(batch, ok, reason) of each batch, from items (batch, pos, id, input) and outputs (batch, pos, id, output).

    Ids compare as text, the last of equal ones counts; a batch without outputs is no JSON, one of another length fails as such.
    """
    last = outputs.groupBy("batch", F.col("id").cast("string").alias("id")).agg(F.max_by("output", "pos").alias("output"), F.lit(True).alias("_there"))
    sizes = outputs.groupBy("batch").agg(F.count(F.lit(1)).alias("_n"), F.bool_or(F.col("id").isNull()).alias("_no_id"))
    joined = items.withColumn("id", F.col("id").cast("string")).join(last, ["batch", "id"], "left")
    joined = joined.withColumn("_r", reason(F.col("input"), F.col("output")))
    own = F.when(F.col("_there").isNull(), F.concat(F.lit("id "), F.col("id"), F.lit(" missing"))).otherwise(F.nullif(F.concat_ws("", F.when(F.col("_r") != "", F.concat(F.lit("id "), F.col("id"), F.lit(" "), F.col("_r")))), F.lit("")))
    one = joined.withColumn("_why", own).groupBy("batch").agg(F.min_by("_why", F.when(F.col("_why").isNotNull(), F.col("pos"))).alias("_why"), F.count(F.lit(1)).alias("_want"))
    both = one.join(sizes, "batch", "left")
    why = (
        F.when(F.col("_n").isNull(), F.lit("not JSON"))
        .when(F.col("_n") != F.col("_want"), F.concat(F.lit("length "), F.col("_n").cast("string"), F.lit(" != "), F.col("_want").cast("string")))
        .when(F.col("_no_id"), F.lit("item missing id"))
        .otherwise(F.coalesce("_why", F.lit("")))
    )
    return both.select("batch", (why == "").alias("ok"), why.alias("reason"))


def mark_differences(pairs: DataFrame, *, key: str = "id", src: str = "src", tgt: str = "tgt") -> DataFrame:
    """(key, missing, extra): placeholders that a target lacks or has over, by count, each listed once."""
    # both sides are counted in one table, which needs no join of all marks
    side = lambda c, own: F.transform(F.coalesce(F.regexp_extract_all(F.col(c), F.lit(X.PLACEHOLDER), 0), F.array().cast("array<string>")), lambda m: F.struct(m.alias("m"), F.lit(own).alias("own")))
    found = pairs.select(key, F.explode(F.concat(side(src, True), side(tgt, False))).alias("x")).select(key, "x.m", "x.own")
    both = found.groupBy(key, "m").agg(F.count_if("own").alias("a"), F.count_if(~F.col("own")).alias("b"))
    lists = both.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("a") > F.col("b"), F.col("m")))), ", ").alias("missing"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("b") > F.col("a"), F.col("m")))), ", ").alias("extra"))
    return pairs.select(key).join(lists, key, "left").na.fill("", ["missing", "extra"])


def usable(src: Column, tgt: Column) -> Column:
    """Whether a fragment's target may take the fragment's place."""
    return F.coalesce(
        (F.btrim(tgt) != "") & ~F.regexp_like(tgt, F.lit(X.KEEP)) & ~(X.has_ascii_letters(src, 8) & (X.hangul_ratio(tgt) < 0.15)) & X.leftover_english(tgt).isNull(),
        F.lit(False),
    )


def rebuilt(src: Column, tgt: Column, replaced: Column, width_max: float = WIDTH_MAX) -> Column:
    """Whether a paragraph put together again from fragments is accepted."""
    told = X.once(F.struct(src.alias("src"), tgt.alias("tgt")), lambda x: ~(X.has_ascii_letters(x["src"], 8) & (X.hangul_ratio(x["tgt"]) < 0.15)) & ~too_wide(x["src"], x["tgt"], width_max))
    return (replaced >= 1) & told


def ladder(attempts: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, output, provenance): the first accepted attempt, else an accepted fragment version, else the source.

    attempts: (id, attempt, output, fragment boolean, ok boolean); sources: (id, input).
    """
    good = attempts.where("ok").groupBy("id").agg(F.min_by("output", F.when(~F.col("fragment"), F.col("attempt"))).alias("whole"), F.min_by("output", F.when(F.col("fragment"), F.col("attempt"))).alias("part"))
    joined = sources.join(good, "id", "left")
    made = F.when(F.col("whole").isNotNull(), "whole").when(F.col("part").isNotNull(), "fragment").otherwise("source")
    return joined.select("id", F.coalesce("whole", "part", "input").alias("output"), made.alias("provenance"))


def pending(attempts: DataFrame, sources: DataFrame, attempt: int) -> DataFrame:
    """Sources that no attempt up to a number has satisfied."""
    return sources.join(attempts.where((F.col("attempt") <= attempt) & F.col("ok")).select("id").distinct(), "id", "left_anti")


def cache_key(model: Column, mode: Column, epoch: Column, rules: Column, source: Column) -> Column:
    """Content address of an item: its id is no part of it. A null part counts as empty, in its own place."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce(c.cast("string"), F.lit("")) for c in (model, mode, epoch, rules, source))), 256)


def sources_digest() -> str:
    """Digest of this package's rules as they are written down."""
    return hashlib.sha256("\0".join(inspect.getsource(m) for m in (X, ligature, sys.modules[__name__])).encode()).hexdigest()


def rules_fingerprint(dictionary: DataFrame, rules: str = "", heavy: int = 20) -> DataFrame:
    """(fingerprint): changes with this package's rules (its sources and limits), the ligature pairs (l, r) and the user's rules.

    The distinct pairs come in as their number, a sum and an exclusive or of 60 bits of their digests each: sums of parts
    make the sum of the whole in any order, so a dictionary of any size is three numbers before it meets.
    """
    digest = F.sha2(F.concat_ws("\0", "l", "r"), 256)
    bits = lambda at: F.conv(F.substring("d", at, 15), 16, 10).cast("long")
    each = dictionary.select("l", "r").distinct().select(digest.alias("d")).select(bits(1).alias("a"), bits(16).alias("b"))
    whole = each.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("a").cast("decimal(38,0)")), F.lit(0)).alias("a"), F.coalesce(F.bit_xor("b"), F.lit(0)).alias("b"))
    parts = (F.lit(sources_digest()), F.lit(f"{heavy} {WIDTH_MAX}"), F.lit(rules), *(F.col(c).cast("string") for c in ("n", "a", "b")))
    return whole.select(F.left(F.sha2(F.concat_ws("\0", *parts), 256), F.lit(12)).alias("fingerprint"))


def faults(pairs: DataFrame, *, key: str = "id", src: str = "src", tgt: str = "tgt", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, ``keep`` columns, kind, detail): what is wrong with an item, by gravity: no reply, too long, English left, placeholders, or nothing that can be named."""
    ratio = X.width(F.col(tgt)) / F.when(X.width(F.col(src)) >= 10, X.width(F.col(src)))
    told = pairs.select(key, *keep, F.col(tgt).isNull().alias("_none"), F.when(ratio > WIDTH_MAX, ratio).alias("_wide"), X.leftover_english(F.col(tgt)).alias("_left"))
    marks = mark_differences(pairs, key=key, src=src, tgt=tgt)
    lost = F.concat_ws("; ", F.when(F.col("missing") != "", F.concat(F.lit("missing "), "missing")), F.when(F.col("extra") != "", F.concat(F.lit("invented "), "extra")))
    kind = F.when(F.col("_none"), "reply").when(F.col("_wide").isNotNull(), "length").when(F.col("_left").isNotNull(), "english").when(lost != "", "placeholders").otherwise("again")
    detail = F.when(kind == "length", F.concat(F.format_number("_wide", 1), F.lit(" times as long"))).when(kind == "english", F.left("_left", F.lit(80))).when(kind == "placeholders", lost).otherwise("")
    return told.join(marks.dropDuplicates([key]), key).select(key, *keep, kind.alias("kind"), detail.alias("detail"))


def hint(pairs: DataFrame, *, key: str = "id", src: str = "src", tgt: str = "tgt") -> DataFrame:
    """(key, kind, detail): what a retry of an item alone is told."""
    return faults(pairs, key=key, src=src, tgt=tgt)


#: Kinds by gravity: the gravest of any item is what a retry of the batch is about.
GRAVITY = ["length", "english", "placeholders", "again"]


def batch_hint(pairs: DataFrame, *, key: str = "id", src: str = "src", tgt: str = "tgt") -> DataFrame:
    """(batch, kind, items, details) for pairs (batch, key, src, tgt): one hint a batch, of the gravest kind that any item has.

    details: the items of that kind and what is wrong with them, a line each in the order of keys. A batch without any reply is
    told to reply; in others an item without reply has lost its placeholders, if it had any. A batch is one prompt, so its lines are few.
    """
    answered = pairs.groupBy("batch").agg(F.max(F.col(tgt).isNotNull()).alias("_some"))
    own = pairs.select("batch", F.struct("batch", F.col(key).alias("key")).alias("_k"), F.col(key).alias("_key"), src, F.coalesce(tgt, F.lit("")).alias(tgt))
    each = faults(own, key="_k", src=src, tgt=tgt, keep=("batch", "_key"))
    rank = F.array_position(F.array(*map(F.lit, GRAVITY)), F.col("kind"))
    each = each.withColumn("rank", rank)
    gravest = each.groupBy("batch").agg(F.min("rank").alias("rank"))
    named = each.join(gravest, ["batch", "rank"]).where("kind <> 'again'")
    lines = named.groupBy("batch").agg(F.count(F.lit(1)).alias("items"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_key").alias("k"), "detail"))), lambda x: F.concat(F.lit("id "), x["k"].cast("string"), F.lit(": "), x["detail"])), "\n").alias("details"))
    both = answered.join(gravest, "batch").join(lines, "batch", "left")
    kind = F.when(~F.col("_some"), "reply").otherwise(F.element_at(F.array(*map(F.lit, GRAVITY)), F.col("rank").cast("int")))
    count = F.when(F.col("_some"), F.coalesce("items", F.lit(0))).otherwise(0)
    return both.select("batch", kind.alias("kind"), count.cast("long").alias("items"), F.when(F.col("_some"), F.coalesce("details", F.lit(""))).otherwise("").alias("details"))


#: Characters of a source that a cache keeps.
LONGEST = 8000


def upsert(rows: DataFrame, longest: int = LONGEST, within: Sequence[str] = ()) -> DataFrame:
    """One row of (k, model, src, tgt, attempts, ts) for each key: the latest, then that of most attempts, then the least target.

    Old and new rows come together as one table. A key's rows are reduced before they are shuffled; not at all if they are
    dealt by columns ``within``, which follow from the key.
    """
    cut = rows.withColumn("src", F.left("src", F.lit(longest)))
    none = lambda c: F.col(c).isNull()
    first = F.struct(none("ts").alias("a"), (-F.col("ts")).alias("b"), none("attempts").alias("c"), (-F.col("attempts")).alias("d"), F.col("tgt").alias("e"), F.col("model").alias("f"), F.col("src").alias("g"))
    best = cut.groupBy(*within, "k").agg(F.min(F.struct(*(first[x].alias(x) for x in "abcdefg"), "ts", "attempts")).alias("m"))
    return best.select(*within, "k", F.col("m.f").alias("model"), F.col("m.g").alias("src"), F.col("m.e").alias("tgt"), "m.attempts", "m.ts")


def lookup(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Items (k, ...) with the cached target, null where there is none."""
    return items.join(cache.select("k", "tgt"), "k", "left")


def cacheable(src: Column, tgt: Column, provenance: Column) -> Column:
    """Successes only; not what equals its source, not rescues."""
    return provenance.isin("whole", "fragment") & (F.btrim(src) != F.btrim(tgt))
