"""The retry ladder: items are asked for until their reply passes, in turns that send only what has failed so far.

A turn asks for the pending items, judges the replies and writes one table: of what passes its output, of the rest its
input, which the next turn reads, so that a turn's plan never holds the turns before. The ladder ends when nothing is
pending or its turns are used up. What is then left is asked for in fragments, and what fails there too stays as its source.

Replies that bring their item's input along are judged in their own row; no text is shuffled for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..shared import written
from . import validate

#: Asks a model for items (id, input, why) at a turn, from 1 on: replies (id, output), and a ``pos`` if an id may occur more than once;
#: or (id, input, output) with one row for every item, its output null if there is no reply.
Ask = Callable[[DataFrame, int], DataFrame]
#: Asks for items (id, input) in fragments: (id, output, replaced), replaced being how many fragments were taken; or these with ``input``, one row for every item.
Rescue = Callable[[DataFrame], DataFrame]
TURNS, HEAVY = 3, 15


def met(pending: DataFrame, replies: DataFrame, *more: str) -> DataFrame:
    """(id, input, output, ``more``): each pending item with its reply, null where none; the last of equal ids counts."""
    if "input" in replies.columns:
        return replies.select("id", "input", "output", *more)
    order = F.col("pos") if "pos" in replies.columns else F.lit(0)
    last = replies.groupBy("id").agg(*(F.max_by(c, order).alias(c) for c in ("output", *more)))
    return pending.select("id", "input").join(last, "id", "left")


def judged(pending: DataFrame, replies: DataFrame) -> DataFrame:
    """(id, input, output, why): each pending item with its reply and why that is refused, empty if it passes; the last of equal ids counts."""
    return met(pending, replies).withColumn("why", validate.reason(F.col("input"), F.col("output")))


def _rescued(items: DataFrame, rescue: Rescue) -> DataFrame:
    good = F.coalesce(validate.rebuilt(F.col("input"), F.col("output"), F.col("replaced")), F.lit(False))
    return met(items, rescue(items), "replaced").withColumn("why", F.when(good, "").otherwise("fragments"))


def _rung(told: DataFrame, provenance: str, turn: int) -> DataFrame:
    """(id, input, why, output, provenance, turn, cacheable) of judged items, written: an output where it passes, an input where it does not."""
    passed, keep = F.col("why") == "", validate.cacheable(F.col("input"), F.col("output"), F.lit(provenance))
    kept = told.select("id", F.when(~passed, F.col("input")).alias("input"), "why", F.when(passed, F.col("output")).alias("output"), F.when(passed, keep).alias("cacheable"))
    return written(kept, "rung", packed=True).withColumns({"provenance": F.lit(provenance), "turn": F.lit(turn)})


def climb(items: DataFrame, ask: Ask, rescue: Rescue | None = None, *, turns: int = TURNS, heavy: int = HEAVY) -> DataFrame:
    """(id, output, provenance, turn, cacheable) of items (id, input): whole, fragment, rescue or source, and the turn that it came from.

    Items of over ``heavy`` placeholders go in fragments first (turn 0). Ids are unique; items without an id are left out.
    """
    dense = F.lit(False) if rescue is None else F.coalesce(X.count_of(F.col("input"), X.PLACEHOLDER) > heavy, F.lit(False))
    items = written(items.where("id is not null").select("id", "input", dense.alias("_dense")), "items", packed=True)
    rungs = []
    pending = items.where("not _dense").select("id", "input", F.lit("").alias("why"))
    if rescue is not None:
        rungs.append(_rung(_rescued(items.where("_dense").select("id", "input"), rescue), "fragment", 0))
        pending = pending.unionByName(rungs[-1].where("why <> ''").select("id", "input", F.lit("").alias("why")))
    for turn in range(1, turns + 1):
        if pending.isEmpty():
            break
        rungs.append(_rung(judged(pending, ask(pending, turn)), "whole", turn))
        pending = rungs[-1].where("why <> ''").select("id", "input", "why")
    if rescue is not None and not pending.isEmpty():
        rungs.append(_rung(_rescued(pending.select("id", "input"), rescue), "rescue", turns + 1))
        pending = rungs[-1].where("why <> ''")
    out = pending.select("id", F.col("input").alias("output"), F.lit("source").alias("provenance"), F.lit(turns + 2).alias("turn"), F.lit(False).alias("cacheable"))
    for rung in rungs:
        out = out.unionByName(rung.where("why = ''").select(out.columns))
    return out
