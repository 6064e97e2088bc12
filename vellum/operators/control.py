"""Page ranges, chunks, resuming and merge checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE


def page_range(spec: Column, total: Column) -> Column:
    """struct(first, last, error) of a page specification: blank, ``a`` or ``a-b``; ends are clamped to the document."""
    s = F.regexp_replace(F.coalesce(spec, F.lit("")), rf"^{SPACE}+|{SPACE}+\z", "")
    both = rf"^(\d+){SPACE}*-{SPACE}*(\d+)\z"
    one, two = F.regexp_extract(s, r"^(\d+)\z", 1), F.regexp_extract(s, both, 1)
    end = F.regexp_extract(s, both, 2)
    first = F.when(s == "", 1).when(one != "", F.try_to_number(one, F.lit("999999999")).cast("int")).when(two != "", F.greatest(F.lit(1), F.try_to_number(two, F.lit("999999999")).cast("int")))
    last = F.when(s == "", total).when(one != "", first).when(two != "", F.least(total, F.try_to_number(end, F.lit("999999999")).cast("int")))
    first = F.when((one != "") & (first < 1), F.lit(None)).otherwise(first)
    error = F.when(first.isNull() | last.isNull(), "not a page range").when(first > last, "empty range").when(first > total, "past the end")
    good = error.isNull()
    return F.struct(F.when(good, first).alias("first"), F.when(good, F.least(last, total)).alias("last"), error.alias("error"))


def chunks(ranges: DataFrame, size: int) -> DataFrame:
    """(doc, first, last) of contiguous chunks of the ranges (doc, first, last)."""
    if size < 1:
        raise ValueError("a chunk holds at least one page")
    each = ranges.select("doc", F.col("last").alias("_end"), F.explode(F.sequence("first", "last", F.lit(size))).alias("first"))
    return each.select("doc", "first", F.least(F.col("first") + size - 1, F.col("_end")).alias("last"))


def to_do(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks that no marker says are done."""
    return planned.join(done, ["doc", "first", "last"], "left_anti")


def newest(artifacts: DataFrame) -> DataFrame:
    """The latest artefact (doc, first, path, mtime, ...) of each chunk."""
    rest = [c for c in artifacts.columns if c not in ("doc", "first")]
    return artifacts.groupBy("doc", "first").agg(F.max_by(F.struct(*rest), F.struct("mtime", "path")).alias("_a")).select("doc", "first", "_a.*")


def merge_errors(planned: DataFrame, artifacts: DataFrame, least_chars: int = 20) -> DataFrame:
    """(doc, first, error) of chunks that must not be merged: missing, short, or with no text on any page."""
    j = planned.join(newest(artifacts), ["doc", "first"], "left")
    error = F.when(F.col("path").isNull(), "missing").when(F.col("page_count") != F.col("last") - F.col("first") + 1, "short").when(~F.exists("text_len", lambda n: n >= least_chars), "no text")
    return j.select("doc", "first", error.alias("error")).where(F.col("error").isNotNull())


def succeeded(exit_code: Column, fresh: Column, judged: Column, empty: Column) -> Column:
    """Whether a chunk's run counts: it ended well, left something new, and not all judged pages are empty."""
    return (exit_code == 0) & fresh & ~((judged > 0) & (judged == empty))
