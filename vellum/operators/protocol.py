"""JSON replies of an external model: tolerant parsing into arrays of (id, output), all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import SPACE, once

ITEMS = "array<struct<id:string,output:string>>"
FENCE = "```"
# What is tried, in this order, to close a reply that was cut off.
TAILS = ["]", "}]", '"}]']


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}++|{SPACE}++\z", "")


def unfenced(raw: Column) -> Column:
    """Without white space around it, and without a code fence: its mark and language before, its mark behind."""
    t = _trimmed(raw)
    inside = _trimmed(F.regexp_replace(t, f"^{FENCE}[A-Za-z]*+", ""))
    return F.when(t.startswith(FENCE), _trimmed(F.regexp_replace(inside, rf"{FENCE}\z", ""))).otherwise(t)


def _kind(value: Column, path: str) -> Column:
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(value, path, "variant")), "^[A-Z]+", 0)


def objects(value: Column) -> Column:
    """Whether a parsed value is a list whose first element is an object."""
    return F.coalesce((_kind(value, "$") == "ARRAY") & (_kind(value, "$[0]") == "OBJECT"), F.lit(False))


def items(value: Column) -> Column:
    """The (id, output) of a parsed list's objects: ids as text, outputs that are not texts as null."""
    each = F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda o: _kind(o, "$") == "OBJECT")
    text = lambda o: F.when(_kind(o, "$.output") == "STRING", F.try_variant_get(o, "$.output", "string"))
    return F.transform(each, lambda o: F.struct(F.try_variant_get(o, "$.id", "string").alias("id"), text(o).alias("output")))


def slices(replies: DataFrame, *, key: str = "id", text: str = "text") -> DataFrame:
    """(key, begin, stop) of every bracketed slice of the texts; keys are unique.

    Brackets are paired from the right: a closing one opens a level, the opening one that brings it back ends the slice,
    and an opening one without a level does nothing. The levels are sums along a text, less their least so far where that is
    under zero; on a level closing and opening ones take turns, so each meets the next.
    """
    gaps = F.transform(F.split(text, r"[\[\]]", -1), lambda g: F.length(g))
    marks = F.arrays_zip(F.regexp_extract_all(text, F.lit(r"[\[\]]"), F.lit(0)).alias("mark"), gaps.alias("gap"))
    each = replies.select(key, F.posexplode(marks).alias("i", "x")).where("x.mark is not null").select(key, "i", "x.mark", "x.gap")
    right = W.partitionBy(key).orderBy(F.desc("i"))
    so_far = right.rowsBetween(W.unboundedPreceding, 0)
    placed = each.withColumn("at", F.sum("gap").over(W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, 0)) + F.col("i"))
    summed = placed.withColumn("s", F.sum(F.when(F.col("mark") == "]", 1).otherwise(-1)).over(so_far))
    least = summed.withColumn("m", F.least(F.lit(0), F.min("s").over(so_far))).withColumn("before", F.lag("m", 1, 0).over(right))
    level = F.col("s") - F.col("m") + F.when(F.col("mark") == "[", 1).otherwise(0)
    paired = least.where((F.col("mark") == "]") | (F.col("m") == F.col("before"))).withColumn("level", level)
    met = paired.withColumn("begin", F.lead("at").over(W.partitionBy(key, "level").orderBy(F.desc("i"))))
    return met.where("mark = ']' and begin is not null").select(key, F.col("begin").cast("int").alias("begin"), (F.col("at") + 1).cast("int").alias("stop"))


def last_arrays(replies: DataFrame, *, key: str = "id", text: str = "text") -> DataFrame:
    """(key, begin, stop, value) of each text's last bracketed slice that is a list beginning with an object; none for texts without."""
    rows = replies.select(key, F.col(text).alias("_text"))
    found = slices(rows, key=key, text="_text").join(rows, key)
    piece = F.substring("_text", F.col("begin") + 1, F.col("stop") - F.col("begin"))
    # a list that begins with an object shows it; what does not is no candidate and is not parsed
    likely = found.where(F.regexp_like(F.substring("_text", F.col("begin") + 1, F.col("stop") - F.col("begin")), F.lit(r"^\[[ \t\r\n]*+\{")))
    good = likely.select(key, "begin", "stop", piece.alias("json")).where(objects(F.try_parse_json("json")))
    last = good.groupBy(key).agg(F.max_by(F.struct("begin", "stop", "json"), "stop").alias("l"))
    return last.select(key, "l.begin", "l.stop", F.try_parse_json("l.json").alias("value"))


def array_places(replies: DataFrame, *, key: str = "id", text: str = "raw") -> DataFrame:
    """(key, begin, stop) of every text's last such array; -1 where there is none."""
    found = last_arrays(replies, key=key, text=text).select(key, "begin", "stop")
    return replies.select(key).join(found, key, "left").select(key, F.coalesce("begin", F.lit(-1)).alias("begin"), F.coalesce("stop", F.lit(-1)).alias("stop"))


def parsed(replies: DataFrame, *, key: str = "id", raw: str = "raw") -> DataFrame:
    """(key, items, repaired): the list that a reply holds, and whether closing signs had to be added; content is never made up.

    A list as it stands, else the last array in it, else what one of ``TAILS`` closes; null where there is nothing.
    """
    rows = replies.select(key, unfenced(F.col(raw)).alias("_text"))
    whole = rows.withColumn("_v", F.try_parse_json("_text"))
    listed = whole.where(F.coalesce(_kind(F.col("_v"), "$") == "ARRAY", F.lit(False)))
    rest = whole.where(~F.coalesce(_kind(F.col("_v"), "$") == "ARRAY", F.lit(False))).select(key, "_text")
    inner = last_arrays(rest, key=key, text="_text").select(key, "value")
    met = rest.join(inner, key, "left")
    closed = F.coalesce(*(F.when(objects(v := F.try_parse_json(F.concat("_text", F.lit(tail)))), v) for tail in TAILS))
    met = met.withColumn("_c", F.when(F.col("value").isNull(), closed))
    found = F.coalesce("value", "_c")
    out = met.select(key, F.when(found.isNotNull(), items(found)).alias("items"), F.col("_c").isNotNull().alias("repaired"))
    return listed.select(key, items(F.col("_v")).alias("items"), F.lit(False).alias("repaired")).unionByName(out)


def swapped(text: Column, begin: Column, stop: Column, items: Column) -> Column:
    """The text with the JSON of other items in place of the array at (begin, stop)."""
    return F.concat(F.substring(text, F.lit(1), begin), F.to_json(items), F.substring(text, stop + 1, F.length(text)))


def client_reply(raw: Column) -> Column:
    """Map of integer id to text; entries without either are dropped, the last of equal ids counts, failures give an empty map."""
    parsed = F.filter(F.coalesce(F.from_json(raw, ITEMS), F.array().cast(ITEMS)), lambda o: o["id"].try_cast("int").isNotNull() & o["output"].isNotNull())
    pairs = F.transform(parsed, lambda o, i: F.struct(o["id"].try_cast("int").alias("key"), i.alias("i"), o["output"].alias("value")))
    # sorted by key and place, the last of each key stands before another one
    last = lambda s: F.filter(s, lambda p, i: F.coalesce(F.get(s, i + 1)["key"] != p["key"], F.lit(True)))
    return once(F.array_sort(pairs), lambda s: F.map_from_entries(F.transform(last(s), lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")))))


def envelope(content: Column, model: Column, created: Column) -> Column:
    """A chat completion's response as JSON."""
    message = F.struct(F.lit("assistant").alias("role"), content.alias("content"))
    choice = F.struct(F.lit(0).alias("index"), message.alias("message"), F.lit("stop").alias("finish_reason"))
    return F.to_json(F.struct(F.lit("chat.completion").alias("object"), created.alias("created"), model.alias("model"), F.array(choice).alias("choices")))
