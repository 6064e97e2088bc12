"""Language coverage, recovery decisions and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from . import layout


def without_margins(blocks: DataFrame, share: float = 0.08) -> DataFrame:
    """(doc, page, text) of the blocks (doc, page, pos, y0, y1, text, height) that are not wholly in a margin, in order."""
    kept = blocks.where(~((F.col("y1") < share * F.col("height")) | (F.col("y0") > (1 - share) * F.col("height"))))
    return kept.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))


def coverage(pages: DataFrame, least_letters: int = 50) -> DataFrame:
    """(doc, judged, empty): pages with enough letters, and the numbers of those hardly translated."""
    letters = X.count_of(F.col("text"), r"\p{L}")
    judged = pages.where(letters >= least_letters).withColumn("_empty", X.hangul_ratio(F.col("text")) < 0.15)
    return judged.groupBy("doc").agg(F.count(F.lit(1)).alias("judged"), F.array_sort(F.collect_list(F.when(F.col("_empty"), F.col("page")))).alias("empty"))


def is_korean(text: Column) -> Column:
    words = F.size(F.filter(F.split(text, X.SPACE + "+"), lambda w: w != ""))
    return (words >= 15) & (X.hangul_ratio(text) >= 0.3)


def leftover_pages(pages: DataFrame) -> DataFrame:
    """(doc, page, run) of the pages that still hold English prose."""
    return pages.select("doc", "page", X.leftover_english(F.col("text")).alias("run")).where(F.col("run").isNotNull())


def repaired(severe: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc, page, action, note) of severely damaged pages; candidates: (doc, page, text, fits, overlap, outside, collision) after a retry.

    A retry that is no Korean, does not fit or is still severe is reverted; the last keeps the first one's note.
    """
    joined = severe.select("doc", "page").join(candidates.withColumn("_there", F.lit(True)), ["doc", "page"], "left")
    ok = is_korean(F.col("text"))
    action = F.when(F.col("_there").isNull(), "reverted").when(~ok, "reverted").when(~F.col("fits"), "reverted").when(layout.severe(), "reverted").otherwise("retranslated")
    note = F.when(F.col("_there").isNull(), "retry failed").when(~ok, "not Korean").when(~F.col("fits"), "page size differs").when(layout.severe(), "not Korean").otherwise("")
    return joined.select("doc", "page", action.alias("action"), note.alias("note"))


def untranslated(leftover: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc, page, action, note): a retry is taken only if it is Korean, without leftovers and damage, else the page is kept, never reverted."""
    joined = leftover.select("doc", "page").join(candidates.withColumn("_there", F.lit(True)), ["doc", "page"], "left")
    korean = F.coalesce(F.col("_there") & is_korean(F.col("text")), F.lit(False))
    note = F.when(~korean, "no Korean came back").when(X.leftover_english(F.col("text")).isNotNull(), "still English").when(layout.severe(), "layout broken").otherwise("")
    return joined.select("doc", "page", F.when(note == "", "retranslated").otherwise("kept").alias("action"), note.alias("note"))


def replaced(pages: DataFrame, new: DataFrame) -> DataFrame:
    """Pages with those of ``new`` in their place; pages that ``pages`` does not have are skipped."""
    return pages.join(new.select("doc", "page"), ["doc", "page"], "left_anti").unionByName(new.join(pages.select("doc", "page"), ["doc", "page"], "left_semi"))


def splice_errors(new: DataFrame, old: DataFrame) -> DataFrame:
    """(doc, page, error) of replacements (doc, page, pages, width, height) that are not one page of the old one's size."""
    joined = new.join(old.select("doc", "page", F.col("width").alias("_w"), F.col("height").alias("_h")), ["doc", "page"], "left")
    size = (F.abs(F.col("width") - F.col("_w")) > 1) | (F.abs(F.col("height") - F.col("_h")) > 1)
    error = F.when(F.col("pages") != 1, "not one page").when(F.col("_w").isNull(), "no such page").when(size, "page size differs")
    return joined.select("doc", "page", error.alias("error")).where(F.col("error").isNotNull())


def report_table(verdicts: DataFrame, recoveries: DataFrame) -> DataFrame:
    """Broken pages (doc, page, reasons) with the last recovery (doc, page, seq, action, note) of each."""
    last = recoveries.groupBy("doc", "page").agg(F.max_by(F.struct("action", "note"), "seq").alias("r"))
    label = F.when(F.col("r.action") == "retranslated", "retranslated").when(F.col("r.action") == "reverted", "original restored").when(F.col("r.action") == "kept", "kept").otherwise("none")
    joined = verdicts.where(F.size("reasons") > 0).join(last, ["doc", "page"], "left")
    return joined.select("doc", "page", F.array_join("reasons", ", ").alias("reasons"), F.when(F.coalesce(F.col("r.note"), F.lit("")) != "", F.col("r.note")).otherwise(label).alias("action"))


def header(verdicts: DataFrame, recoveries: DataFrame, leftover: DataFrame) -> DataFrame:
    """(doc, pages, broken, reverted, leftover) counts."""
    v = verdicts.groupBy("doc").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.size("reasons") > 0).alias("broken"))
    r = recoveries.groupBy("doc").agg(F.count_if(F.col("action") == "reverted").alias("reverted"))
    x = leftover.groupBy("doc").agg(F.count(F.lit(1)).alias("leftover"))
    return v.join(r, "doc", "left").join(x, "doc", "left").na.fill(0, ["reverted", "leftover"])


def leftover_section(leftover: DataFrame, first: int = 12, cut: int = 60) -> DataFrame:
    """(doc, n, page, run, more): the first pages of the section, and how many more there are; a limit of the report's."""
    every = leftover.groupBy("doc").agg(F.count(F.lit(1)).alias("_all"))
    # the limit goes below the shuffle: no task gets more than a part's first pages of a document
    top = leftover.withColumn("n", F.row_number().over(W.partitionBy("doc").orderBy("page")).cast("long")).where(F.col("n") <= first)
    more = F.greatest(F.col("_all") - first, F.lit(0)).alias("more")
    return top.join(every, "doc").select("doc", "n", "page", F.replace(F.left("run", F.lit(cut)), F.lit("|"), F.lit("/")).alias("run"), more)


def report_lines(head: DataFrame, table: DataFrame, leftover: DataFrame, failures: DataFrame | None = None, fragments: DataFrame | None = None) -> DataFrame:
    """(doc, part, n, line) of a Markdown report, in the order of part and n: counts, broken pages, failed repairs, leftovers, rescued fragments.

    head: ``header``; table: ``report_table``; leftover: (doc, page, run); failures: recoveries with notes; fragments: (doc, pos, why, src).
    A part's heading stands at n = 0, and only where the part has lines.
    """
    line = lambda df, part, n, text: df.select("doc", F.lit(part).alias("part"), n.cast("long").alias("n"), text.alias("line"))
    zero = F.lit(0)
    title = lambda df, part, text: line(df.select("doc").distinct(), part, zero, F.lit(text))
    out = line(head, 1, zero, F.lit("# Report")).unionByName(line(head, 1, F.lit(1), F.format_string("%d pages, %d broken, %d restored, %d with leftovers", "pages", "broken", "reverted", "leftover")))
    out = out.unionByName(title(table, 2, "## Broken pages")).unionByName(line(table, 2, F.col("page") + 1, F.format_string("| %d | %s | %s |", "page", "reasons", "action")))
    if failures is not None:
        each = failures.groupBy("doc", "page").agg(F.max_by("note", "seq").alias("note"))
        out = out.unionByName(title(each, 3, "## Failed repairs")).unionByName(line(each, 3, F.col("page") + 1, F.format_string("- %d: %s", "page", "note")))
    top = leftover_section(leftover)
    out = out.unionByName(title(top, 4, "## English left")).unionByName(line(top, 4, F.col("n"), F.format_string("- %d: %s", "page", "run")))
    out = out.unionByName(line(top.where("n = 1 and more > 0"), 4, F.lit(1 << 40), F.format_string("- and %d more", "more")))
    if fragments is not None:
        few = fragment_section(fragments)
        out = out.unionByName(line(few.where("n = 1"), 5, zero, F.format_string("## Rescued in fragments: %d", "total"))).unionByName(line(few, 5, F.col("n"), F.concat(F.lit("- "), "src")))
        out = out.unionByName(line(few.where("n = 1 and total > 5"), 5, F.lit(1 << 40), F.format_string("- and %d more", F.col("total") - 5)))
    return out


def write_report(lines: DataFrame, path: str) -> None:
    """One text file for each document under ``path``/doc=.., its lines in the order of part and n; line breaks within a line become blanks.

    Documents are dealt whole over the tasks by range, and a task writes its documents one after another as a stream.
    """
    flat = lines.withColumn("line", F.regexp_replace("line", r"[\r\n]+", " "))
    flat.repartitionByRange("doc").sortWithinPartitions("doc", "part", "n").select("doc", "line").write.mode("overwrite").partitionBy("doc").text(path)


def failed(recoveries: DataFrame) -> DataFrame:
    """Recoveries that left a note."""
    return recoveries.where(F.coalesce("note", F.lit("")) != "")


def fragment_section(fragments: DataFrame, first: int = 5, cut: int = 90) -> DataFrame:
    """(doc, n, why, src, total): the first rescued fragments (doc, pos, why, src) and how many there are; a limit of the report's."""
    every = fragments.groupBy("doc").agg(F.count(F.lit(1)).alias("total"))
    short = fragments.select("doc", "pos", "why", F.left("src", F.lit(cut)).alias("src"))  # no whole text is sorted
    top = short.withColumn("n", F.row_number().over(W.partitionBy("doc").orderBy("pos")).cast("long")).where(F.col("n") <= first)
    return top.join(every, "doc").select("doc", "n", "why", "src", "total")


def summary(recoveries: DataFrame) -> DataFrame:
    """(doc, retranslated, reverted, rest) over the last recovery of each page."""
    last = recoveries.groupBy("doc", "page").agg(F.max_by("action", "seq").alias("action"))
    count = lambda a: F.count_if(F.col("action") == a).alias(a)
    return last.groupBy("doc").agg(count("retranslated"), count("reverted"), F.count_if(~F.col("action").isin("retranslated", "reverted")).alias("rest"))
