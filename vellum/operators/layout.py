"""Layout damage from word boxes (doc, page, pos, x0, y0, x1, y1, txt)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Fewest words of a judged page, tolerance around the text block, successors that a word is held against.
LEAST_WORDS, PAD, AHEAD = 15, 6.0, 59
LIMITS = {"overlap": 0.02, "outside": 0.03, "collision": 0.04}
SEVERE = {"overlap": 0.15, "outside": 0.10, "collision": 0.10}
SELF_MARK = "[vellum]"


def proper(words: DataFrame, bottom: DataFrame | None = None, mark: str = SELF_MARK) -> DataFrame:
    """Words with text and area; from a page's own mark on, nothing of the last 40 points.

    bottom: (doc, page, bottom).
    """
    out = words.where((F.btrim("txt") != "") & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    if bottom is None:
        return out
    seen = F.max(F.col("txt").startswith(mark).cast("int")).over(W.partitionBy("doc", "page").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    out = out.join(bottom, ["doc", "page"]).withColumn("_seen", seen)
    return out.where(~((F.col("_seen") == 1) & (F.col("y0") > F.col("bottom") - 40))).drop("_seen", "bottom")


def block(words: DataFrame) -> DataFrame:
    """(doc, page, bx0, by0, bx1, by1)."""
    return words.groupBy("doc", "page").agg(F.min("x0").alias("bx0"), F.min("y0").alias("by0"), F.max("x1").alias("bx1"), F.max("y1").alias("by1"))


def _hits(words: DataFrame, name: str) -> DataFrame:
    return words.groupBy("doc", "page").agg(F.count_if(name).alias("hits"))


def _covered(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, page: np.ndarray, judged: int) -> np.ndarray:
    """Which of the first ``judged`` words, in reading order, are much covered by one of the next words of their page.

    One step for each distance; the sweep ends when no word of that distance begins above a word's end any more. As tops
    ascend along a page, a word that is out of reach stays so, and with all out of reach no later step can hit.
    """
    hit = np.zeros(judged, bool)
    area = (x1 - x0) * (y1 - y0)
    near = np.arange(judged)
    for step in range(1, AHEAD + 1):
        near = near[near + step < len(x0)]
        b = near + step
        reach = (page[b] == page[near]) & (y0[b] <= y1[near])
        near, b = near[reach], b[reach]
        if not len(near):
            break
        ox = np.minimum(x1[near], x1[b]) - np.maximum(x0[near], x0[b])
        oy = np.minimum(y1[near], y1[b]) - np.maximum(y0[near], y0[b])
        found = (ox > 0.5) & (oy > 0.5) & (ox * oy > 0.30 * area[near])
        hit[near[found]] = True
        near = near[~found]
    return hit


def _swept(words: DataFrame) -> DataFrame:
    """(doc, page, hits) in parts: words sorted by page and top stream past a window of ``AHEAD`` successors.

    A task holds a batch and the words that still wait for successors, whatever the size of a page.
    """
    keys = [F.col("doc"), F.col("page")]
    spread = words.repartition(*keys).sortWithinPartitions(*keys, "y0", "x0", "pos").select("doc", "page", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    kinds = spread.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def counts(part: pa.Table, judged: int) -> pa.RecordBatch:
            part = part.combine_chunks()
            # pages are told apart by where they begin; the rows are sorted
            change = np.zeros(len(part), bool)
            for c in ("doc", "page"):
                code = part[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                change[1:] |= code[1:] != code[:-1]
            page = np.cumsum(change)
            hit = _covered(*(part[c].to_numpy() for c in ("x0", "y0", "x1", "y1")), page, judged)
            own = page[:judged]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            hits = np.add.reduceat(hit.astype(np.int64), first) if judged else np.zeros(0, np.int64)
            return pa.record_batch([part[c].combine_chunks().take(pa.array(first)) for c in ("doc", "page")] + [pa.array(hits)], names=["doc", "page", "hits"])

        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            if len(held) > 8 * AHEAD:
                yield counts(held, len(held) - AHEAD)
                held = held.slice(len(held) - AHEAD)
        if held is not None and len(held):
            yield counts(held, len(held))

    return spread.mapInArrow(run, T.StructType([kinds["doc"], kinds["page"], T.StructField("hits", T.LongType())]))


def _colliding(words: DataFrame) -> DataFrame:
    band = F.expr("cast((y0 + y1) / 2 / 4 as int)")  # truncates towards zero
    line = W.partitionBy("doc", "page", "_band").orderBy("x0", "x1", "pos")
    w = words.withColumn("_band", band).withColumn("_end", F.lag("x1").over(line))
    return w.withColumn("collision", F.col("x0") < F.col("_end") - 0.5).drop("_band", "_end")


def _straying(words: DataFrame, original: DataFrame) -> DataFrame:
    edge = lambda c: F.coalesce(c, F.lit(0.0))
    w = words.join(block(original), ["doc", "page"], "left")
    inside = (F.col("x0") >= edge("bx0") - PAD) & (F.col("y0") >= edge("by0") - PAD) & (F.col("x1") <= edge("bx1") + PAD) & (F.col("y1") <= edge("by1") + PAD)
    return w.withColumn("outside", ~inside).drop("bx0", "by0", "bx1", "by1")


def overlap(words: DataFrame) -> DataFrame:
    """(doc, page, hits): words much covered by one of their next words in reading order."""
    return _swept(words).groupBy("doc", "page").agg(F.sum("hits").alias("hits"))


def collision(words: DataFrame) -> DataFrame:
    """(doc, page, hits): words that begin before their left neighbour of the line has ended."""
    return _hits(_colliding(words), "collision")


def outside(words: DataFrame, original: DataFrame) -> DataFrame:
    """(doc, page, hits): words beyond the block of the original's page."""
    return _hits(_straying(words, original), "outside")


def measures(words: DataFrame, original: DataFrame) -> DataFrame:
    """(doc, page, words, overlap, outside, collision); zero where there are too few words to tell.

    All flags hang on the page: the words are dealt by it once, for the sweep and for the other two.
    """
    dealt = words.select("doc", "page", "pos", "x0", "y0", "x1", "y1").repartition("doc", "page")
    told = _straying(_colliding(dealt), original)
    n = told.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("words"), *(F.count_if(c).alias(c) for c in ("outside", "collision")))
    covered = overlap(dealt).select(F.col("doc").alias("_d"), F.col("page").alias("_p"), F.col("hits").alias("overlap"))
    n = n.join(covered, F.col("doc").eqNullSafe(F.col("_d")) & F.col("page").eqNullSafe(F.col("_p")))
    share = lambda c: F.when(F.col("words") < LEAST_WORDS, 0.0).otherwise(F.col(c) / F.col("words"))
    return n.select("doc", "page", "words", *(share(c).alias(c) for c in LIMITS))


def _page_counts(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, pos: np.ndarray, page: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    """Hits (overlap, outside, collision) of each of ``n`` pages, from words in the order of ``page`` and the blocks (4 x n) that they should keep to."""

    def sorted_by(*keys: np.ndarray) -> slice | np.ndarray:
        """An order of the words by page, then keys; only pages that are out of order are sorted."""
        before, tied = np.zeros(max(len(page) - 1, 0), bool), page[1:] == page[:-1]
        for k in keys:
            before |= tied & (k[1:] < k[:-1])
            tied = tied & (k[1:] == k[:-1])
        if not before.any():
            return slice(None)
        out = np.arange(len(page))
        mixed = np.flatnonzero(np.isin(page, np.unique(page[1:][before])))
        out[mixed] = mixed[np.lexsort([k[mixed] for k in reversed((page, *keys))])]
        return out

    hits = lambda flags, of: np.bincount(of[flags], minlength=n)
    o = sorted_by(y0, x0, pos)
    over = hits(_covered(x0[o], y0[o], x1[o], y1[o], page, len(page)), page)
    out = (x0 < block[0][page] - PAD) | (y0 < block[1][page] - PAD) | (x1 > block[2][page] + PAD) | (y1 > block[3][page] + PAD)
    band = np.trunc((y0 + y1) / 2 / 4)
    o = sorted_by(band, x0, x1, pos)
    begin, end, line = x0[o], x1[o], band[o]
    into = np.zeros(len(page), bool)
    into[1:] = (page[1:] == page[:-1]) & (line[1:] == line[:-1]) & (begin[1:] < end[:-1] - 0.5)
    return np.stack([over, hits(out, page), hits(into, page)])


def _side(column: pa.ListArray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Coordinates and places of the proper words of a column of arrays, the page of each, and how many each page has."""
    words = column.flatten()
    x0, y0, x1, y1, pos = (words.field(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1", "pos"))
    page = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    good = (x1 > x0) & (y1 > y0)
    if not good.all():
        x0, y0, x1, y1, pos, page = (v[good] for v in (x0, y0, x1, y1, pos, page))
    return [x0, y0, x1, y1, pos], page, np.bincount(page, minlength=len(column))


#: Words that are measured at a time, about; a page is measured whole.
AT_ONCE = 1 << 18


def inspect_pages(pages: DataFrame) -> DataFrame:
    """``inspect`` of pages (doc, page, translated, original) that stand beside their originals, words as arrays of (pos, x0, y0, x1, y1).

    Words without extent do not count, as in ``proper``. A page is judged in the row that it comes in, so no word is shuffled;
    pages too long for a row go through ``inspect``. Rows are pages: no two of one number.
    """
    kinds = [pages.schema["doc"], pages.schema["page"]]
    names = [f"{side}{c}" for side in ("_t", "_o") for c in ("words", *LIMITS)]

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        (t, tp, tn), (o, op, on) = _side(batch["translated"]), _side(batch["original"])
        n = batch.num_rows
        block = np.zeros((4, n))
        first = np.flatnonzero(np.diff(op, prepend=-1))
        if len(first):
            for row, least, v in zip(block, (True, True, False, False), o):
                row[op[first]] = (np.minimum if least else np.maximum).reduceat(v, first)
        counts = np.vstack([tn, _page_counts(*t, tp, block, n), on, _page_counts(*o, op, block, n)])
        return pa.record_batch([batch["doc"], batch["page"], *map(pa.array, counts)], names=["doc", "page", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = sum(batch[c].value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for c in ("translated", "original"))
            part = np.cumsum(size) // AT_ONCE
            ends = [*(np.flatnonzero(np.diff(part)) + 1), len(size)] if len(size) else []
            for a, b in zip([0, *ends], ends):
                yield measured(batch.slice(a, b - a))

    made = pages.select("doc", "page", "translated", "original").mapInArrow(run, T.StructType([*kinds, *(T.StructField(c, T.LongType()) for c in names)]))
    made = made.where("_twords > 0 and _owords > 0 and doc is not null and page is not null")
    share = lambda side, c: F.when(F.col(f"{side}words") < LEAST_WORDS, 0.0).otherwise(F.col(f"{side}{c}") / F.col(f"{side}words"))
    return _judged(made.select("doc", "page", F.col("_twords").alias("words"), *(share("_t", c).alias(c) for c in LIMITS), *(share("_o", c).alias(f"_{c}") for c in LIMITS)))


def _judged(both: DataFrame) -> DataFrame:
    both = both.select("doc", "page", "words", *(F.greatest(F.lit(0.0), F.col(c) - F.col(f"_{c}")).alias(c) for c in LIMITS))
    why = F.array_compact(F.array(*(F.when((F.col("words") >= LEAST_WORDS) & (F.col(c) > least), F.lit(c)) for c, least in LIMITS.items())))
    return both.withColumn("reasons", why)


def inspect(translated: DataFrame, original: DataFrame, offset: int = 0) -> DataFrame:
    """(doc, page, words, overlap, outside, collision, reasons): what the translation has made worse.

    Page p of the translation stands against page p + offset of the original; pages past its end are not judged.
    """
    base = original.withColumn("page", F.col("page") - offset)
    t, o = measures(translated, base), measures(base, base)
    return _judged(t.join(o.select("doc", "page", *(F.col(c).alias(f"_{c}") for c in LIMITS)), ["doc", "page"]))


def severe() -> Column:
    return (F.col("overlap") > SEVERE["overlap"]) | (F.col("outside") > SEVERE["outside"]) | (F.col("collision") > SEVERE["collision"])


def mixed_blocks(lines: DataFrame) -> DataFrame:
    """(doc, page, mixed): small text blocks with both purely Korean and purely English lines, from lines (doc, page, block, txt)."""
    ko = F.regexp_count("txt", F.lit("[가-힣]"))
    en = F.regexp_count("txt", F.lit("[A-Za-z]"))
    per = lines.groupBy("doc", "page", "block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("txt")).alias("chars"), F.count_if((ko >= 2) & (en == 0)).alias("ko"), F.count_if((en >= 3) & (ko == 0)).alias("en"))
    hit = F.col("n").between(2, 8) & (F.col("chars") <= 160) & (F.col("ko") > 0) & (F.col("en") > 0)
    return per.groupBy("doc", "page").agg(F.count_if(hit).alias("mixed"))


def told_reasons() -> Column:
    """The reasons with how far each measure rose, as whole percentages, ready for people to read."""
    rose = lambda c: F.concat(F.lit(f"{c} +"), F.format_number(F.col(c) * 100, 0), F.lit("%"))
    return F.transform(F.col("reasons"), lambda r: F.coalesce(*(F.when(r == c, rose(c)) for c in LIMITS), r))
