"""Numbers in an order, without a window over all rows of a key: sums of parts first, then places inside the parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..shared import written

#: Page numbers of one block: a window holds no more pages of a document than that.
BLOCK = 4096


def _same(a: str, b: str, keys: Sequence[str]) -> Column:
    found = F.lit(True)
    for k in keys:
        found = found & F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`"))
    return found


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "n") -> DataFrame:
    """``df`` with each row's number, from 1, among the rows of its keys in the order; equal rows in any order.

    The rows are sorted over the whole cluster and written once with their places. A key of any number of rows lies in
    consecutive places of consecutive parts, so that one sum for each key and part makes all numbers.
    """
    of = [F.col(f"`{k}`") for k in keys]
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    rows = df.repartitionByRange(*of, *by).sortWithinPartitions(*of, *by)
    rows = written(rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place")), "numbered")
    parts = rows.groupBy(*of, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_from"))
    before = F.sum("_n").over(W.partitionBy(*of).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    # written, so that its size is known: rows are not shuffled to meet a small table
    parts = written(parts.select(*of, "_part", "_from", F.coalesce(before, F.lit(0)).alias("_before")), "parts")
    both = rows.alias("r").join(parts.alias("p"), _same("r", "p", [*keys, "_part"]))
    number = F.col("r._place") - F.col("p._from") + F.col("p._before") + 1
    return both.select(*(F.col(f"r.`{c}`") for c in df.columns), number.cast("long").alias(name))


def starts(pages: DataFrame, *, doc: str = "doc") -> DataFrame:
    """(row, start, next) of pages (doc, page, row, n, head) with n > 0: things on all earlier pages, and the next page's head.

    Pages are numbers; rows of one page come in the order of ``row``, which is unique. Two levels: sums of blocks of page
    numbers along a document, then sums of pages along a block.
    """
    light = pages.where("n > 0").select(doc, "page", "row", "n", "head", F.floor(F.col("page") / BLOCK).alias("_block"))
    blocks = light.groupBy(doc, "_block").agg(F.sum("n").alias("n"), F.min_by("head", F.struct("page", "row")).alias("head"))
    along = W.partitionBy(doc).orderBy("_block")
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col(doc).alias("_doc"), F.col("_block").alias("_b"), earlier(along).alias("_before"), F.lead("head").over(along).alias("_next"))
    inside = W.partitionBy(doc, "_block").orderBy("page", "row")
    light = light.select(doc, "_block", "row", earlier(inside).alias("_start"), F.lead("head").over(inside).alias("_after"))
    met = light.join(blocks, F.col(doc).eqNullSafe(F.col("_doc")) & F.col("_block").eqNullSafe(F.col("_b")))
    return met.select("row", (F.col("_start") + F.col("_before")).cast("long").alias("start"), F.coalesce("_after", "_next").alias("next"))


def batch_map(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str, *, keys: Sequence[str] = ("doc", "batch")) -> DataFrame:
    """``fn`` of each batch's rows, each batch once; the outcome carries the batches' keys, so their order is that of the keys.

    Batches are dealt in their order and in parallel; within a task one follows the other, as a stream. Whatever a
    batch returns stands under its keys, in the order that ``fn`` gave: ``i``. The outcome is written, so that no reader
    of it, as a sort that looks at it first, makes ``fn`` be asked again.
    """
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    made = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = T.StructType([*(df.schema[k] for k in keys), T.StructField("i", T.LongType()), *made.fields])
    names = [f.name for f in made.fields]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(rows: pd.DataFrame) -> pd.DataFrame:
            got = fn(rows.reset_index(drop=True))[names].reset_index(drop=True)
            for at, k in enumerate(keys):
                got.insert(at, k, [rows[k].iloc[0]] * len(got))
            got.insert(len(keys), "i", range(len(got)))
            return got

        held = None
        for part in parts:
            if not len(part):
                continue
            part = part if held is None else pd.concat([held, part], ignore_index=True)
            groups = [g for _, g in part.groupby(list(keys), sort=False, dropna=False)]
            held = groups.pop()  # the last batch may go on in the next part
            yield from map(done, groups)
        if held is not None:
            yield done(held)

    return written(rows.mapInPandas(run, out), "mapped")
