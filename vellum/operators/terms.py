"""Terminology mining and filtering.

Everything is done per document key, so many documents are mined in one plan. Orders that matter are
explicit columns; ties are broken by the place of first occurrence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..shared import written
from . import order

# Words of closed classes, which no term can begin or end with.
STOP_WORDS = """
the a an and or but if then than that this these those of in on at to for with from by as
is are was were be been being am it its they them their we us our you your he him his she her
not no nor can could may might will would shall should must do does did done have has had
there here when where which who whom whose what how why all any both each either neither
few more most other others some such only own same so too very about above below under
over between into onto through during before after since until while although though because
however therefore hence thus also again yet than upon within without across among per via
another every
""".split()
# Fixed value: signs that edges of tokens lose.
EDGE = " \t\r\n.,;:!?()[]{}\"'“”‘’"


def clean(raw: Column, composed: bool = False) -> Column:
    """Lower-case letters and hyphens of a token, closed up."""
    letters = F.lower(F.regexp_replace(X.repair(raw, composed), r"[^A-Za-z\- ]+", " "))
    mended = F.replace(letters, F.lit(" "), F.lit(""))
    if composed:
        return mended
    # without a damage mark repair only makes blanks of what is dropped here anyway
    return F.when(raw.contains(X.DAMAGE), mended).otherwise(F.lower(F.regexp_replace(raw, r"[^A-Za-z\-]++", "")))


def paged(pages: DataFrame, *, doc: str = "doc", page: str = "page", text: str = "text", composed: bool = False, surfaces: bool = True) -> DataFrame:
    """(doc, page, row, n, head, last, words): each page's tokens (raw, w) with something left after cleaning, as one array.

    Written once, since vocabulary, counts and positions all read it; ``row`` tells rows of one page apart. Pages are
    numbers; rows of no document are left out. Without ``surfaces`` tokens are (w) alone, which is half the table.
    """
    pages = pages.where(F.col(doc).isNotNull())
    bare = F.transform(F.split(text, X.SPACE + "+"), lambda t: F.btrim(t, F.lit(EDGE)))
    raw = F.filter(bare, lambda t: t != "")
    token = lambda t, w: F.struct(*[t.alias("raw")] * surfaces, w.alias("w"))
    words = F.filter(F.transform(raw, lambda t: token(t, clean(t))), lambda x: x["w"] != "")
    if composed:  # composition is a function of a column, not of an array's element
        lone = pages.withColumn("_row", F.monotonically_increasing_id()).select(doc, page, "_row", F.posexplode_outer(raw).alias("i", "raw"))
        lone = lone.withColumn("w", clean(F.col("raw"), True))
        listed = F.array_sort(F.collect_list(F.when(F.col("w") != "", F.struct("i", "raw", "w"))))
        made = lone.groupBy(doc, F.col(page).alias("page"), F.col("_row").alias("row")).agg(F.transform(listed, lambda x: token(x["raw"], x["w"])).alias("words"))
    else:
        made = pages.select(doc, F.col(page).alias("page"), F.monotonically_increasing_id().alias("row"), F.coalesce(words, F.array().cast(f"array<struct<{'raw:string,' * surfaces}w:string>>")).alias("words"))
    return written(made.select(doc, "page", "row", F.size("words").alias("n"), F.get("words", F.lit(0)).alias("head"), F.get("words", F.size("words") - 1).alias("last"), "words"), "words", packed=True)


def tokens(pages: DataFrame, *, doc: str = "doc") -> DataFrame:
    """(doc, pos, raw, w) of ``paged`` pages: tokens, numbered through the document; raw if the pages have surfaces."""
    met = pages.where("n > 0").join(order.starts(pages, doc=doc).drop("next"), "row")
    each = met.select(doc, "start", F.posexplode("words").alias("i", "x"))
    return each.select(doc, (F.col("start") + F.col("i") + 1).cast("long").alias("pos"), "x.*")


def vocabulary(pages: DataFrame, *, doc: str = "doc", which: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc, w): distinct words of ``paged`` pages, of all or of those that ``which`` holds for."""
    words = pages.select(doc, F.explode("words.w").alias("w"))
    return (words.where(which(F.col("w"))) if which else words).distinct()


def norms(words: DataFrame, *, doc: str = "doc") -> DataFrame:
    """(doc, w, norm): plurals folded where the singular stands in the same document.

    Resolved on distinct words by joining the vocabulary to itself, then joined back by whoever needs it.
    """
    vocab = words.select(doc, "w").distinct()
    base = lambda name, cut: vocab.select(F.col(doc).alias("_d"), F.col("w").alias(name))  # noqa: E731, ARG005
    y = F.concat(F.expr("left(w, length(w) - 3)"), F.lit("y"))
    s = F.expr("left(w, length(w) - 1)")
    long = vocab.withColumn("_wy", F.when(F.col("w").endswith("ies") & (F.length("w") > 4), y))
    long = long.withColumn("_ws", F.when(F.col("w").endswith("s") & ~F.col("w").endswith("ss") & (F.length("w") > 3), s))
    by = base("_y", 0).withColumnRenamed("_d", "_dy")
    bs = base("_s", 0).withColumnRenamed("_d", "_ds")
    joined = long.join(by, (F.col(doc) == F.col("_dy")) & (F.col("_wy") == F.col("_y")), "left").join(bs, (F.col(doc) == F.col("_ds")) & (F.col("_ws") == F.col("_s")), "left")
    norm = (
        F.when(F.col("_y").isNotNull(), F.col("_y"))
        .when(F.col("w").endswith("sses") | F.col("w").endswith("shes"), F.expr("left(w, length(w) - 2)"))
        .when(F.col("_s").isNotNull(), F.col("_s"))
        .otherwise(F.col("w"))
    )
    return joined.select(doc, "w", norm.alias("norm"))


def _ok(c: Column) -> Column:
    return (F.length(c) > 2) & ~c.isin(STOP_WORDS)


def _surfaced(pages: DataFrame) -> bool:
    return "raw" in pages.schema["words"].dataType.elementType.names


def _occurrences(pages: DataFrame, *, doc: str = "doc") -> DataFrame:
    """(doc, pos, tier, w, w2) of each bigram (1), hyphen word (2) and single word (3) of ``paged`` pages, and its surface if they have them.

    Pairs are taken within page arrays, those across pages from their ends.
    """
    begin = written(order.starts(pages, doc=doc), "starts")
    next_ = F.slice("words", F.lit(2), F.greatest(F.col("n") - 1, F.lit(0)))
    pairs = F.zip_with("words", next_, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    # positions come first: the least of a number is kept in a hash table, that of a struct would need all rows sorted
    inside = pages.where("n > 0").join(begin.select("row", "start"), "row").select(doc, "start", F.posexplode(pairs).alias("i", "x")).select(doc, (F.col("start") + F.col("i") + 1).alias("pos"), "x.a", "x.b")
    ends = pages.where("n > 0").select(doc, "row", "n", F.col("last").alias("a")).join(begin.where("next is not null").select("row", "start", F.col("next").alias("b")), "row")
    alpha = lambda c: F.regexp_like(c, F.lit("^[a-z]+$"))
    w, w2, surfaced = F.col("a.w"), F.col("b.w"), _surfaced(pages)
    one = lambda tier, second, *of: F.struct(F.lit(tier).alias("tier"), w.alias("w"), second.alias("w2"), *[F.concat_ws(" ", *of).alias("surface")] * surfaced)
    pair = F.when(_ok(w) & _ok(w2) & alpha(w) & alpha(w2), one(1, w2, "a.raw", "b.raw"))
    none = F.lit(None).cast("string")
    hyphened = F.when(w.contains("-") & (F.length(w) > 6) & (F.length(w) < 30) & alpha(F.replace(w, F.lit("-"), F.lit(""))), one(2, none, "a.raw"))
    single = F.when((F.length(w) > 4) & ~w.isin(STOP_WORDS) & alpha(w), one(3, none, "a.raw"))
    told = lambda df, *kinds: df.select(doc, "pos", F.inline(F.array_compact(F.array(*kinds))))
    return told(inside, pair, hyphened, single).unionByName(told(ends.select(doc, (F.col("start") + F.col("n")).alias("pos"), "a", "b"), pair))


def counted(pages: DataFrame, *, doc: str = "doc") -> DataFrame:
    """(doc, tier, term, cnt, first_pos, surfaces) of ``paged`` pages: bigrams (1), hyphen words (2) and single words (3).

    What is counted meets its norms after counting, once for distinct words. Pages without surfaces give none.
    """
    n = norms(vocabulary(pages, doc=doc), doc=doc)
    raw, surfaced = _occurrences(pages, doc=doc), _surfaced(pages)
    if surfaced:
        raw = raw.groupBy(doc, "tier", "w", "w2", "surface").agg(F.count(F.lit(1)).alias("cnt"), F.min("pos").alias("pos"))
        raw = raw.groupBy(doc, "tier", "w", "w2").agg(F.sum("cnt").alias("cnt"), F.min("pos").alias("pos"), F.collect_list("surface").alias("surfaces"))
    else:
        raw = raw.groupBy(doc, "tier", "w", "w2").agg(F.count(F.lit(1)).alias("cnt"), F.min("pos").alias("pos"))
    of = lambda a, b: n.select(F.col(doc).alias(f"_d{b}"), F.col("w").alias(f"_w{b}"), F.col("norm").alias(f"n{b}"))  # noqa: E731, ARG005
    met = raw.join(of(n, 1), F.col(doc).eqNullSafe(F.col("_d1")) & (F.col("w") == F.col("_w1"))).join(of(n, 2), F.col(doc).eqNullSafe(F.col("_d2")) & (F.col("w2") == F.col("_w2")), "left")
    term = F.when(F.col("tier") == 1, F.concat_ws(" ", "n1", "n2")).otherwise(F.col("n1")).alias("term")
    surfaces = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("surfaces")))).alias("surfaces")] if surfaced else []
    merged = met.groupBy(doc, "tier", term).agg(F.sum("cnt").alias("cnt"), F.min("pos").alias("pos"), *surfaces)
    return merged.select(doc, "tier", "term", "cnt", F.col("pos").cast("long").alias("first_pos"), *["surfaces"] * surfaced)


def _unsettled(w: Column) -> Column:
    """Whether the spelling alone leaves open which words share a norm: Xies goes with Xy or Xie, Xshs and Xshes need not go together."""
    found = F.lit(False)
    for end in ("y", "ys", "ie", "ies", "sh", "shs", "shes"):
        found = found | w.endswith(end)
    return found


def _class(w: Column) -> Column:
    """Words of one class share their norm, whatever the vocabulary; only unsettled classes can share it with others, which are unsettled as well."""
    cut = lambda n: F.left(w, F.length(w) - n)
    plural = w.endswith("s") & ~w.endswith("ss") & (F.length(w) > 3)
    return F.when(plural & ~_unsettled(w), F.when(w.endswith("sses"), cut(2)).otherwise(cut(1))).otherwise(w)


def _spellings(norm: Column) -> Column:
    """All words that can have a norm."""
    more = (F.concat(norm, F.lit("s")), F.concat(norm, F.lit("es")), F.when(norm.endswith("y"), F.concat(F.left(norm, F.length(norm) - 1), F.lit("ies"))))
    return F.array_compact(F.array(norm, *more))


def _with_bases(words: Column) -> Column:
    """Words and all that ``norms`` looks for to fold them."""
    bases = lambda w: F.array(w, F.when(w.endswith("ies"), F.concat(F.left(w, F.length(w) - 3), F.lit("y"))), F.when(w.endswith("s"), F.left(w, F.length(w) - 1)))
    return F.array_compact(F.flatten(F.transform(words, bases)))


def _ranks(pages: DataFrame, min_count: int, *, doc: str = "doc") -> DataFrame:
    """(doc, tier, k, k2, cnt, first_pos) of terms that occur ``min_count`` times or more, by the classes of their words: a settled class or a norm.

    Occurrences are counted by class, so that most terms are whole after one count and what is rare is left there; only
    unsettled classes meet the norms of their words and are counted again.
    """
    each = _occurrences(pages, doc=doc).select(doc, "tier", _class(F.col("w")).alias("k"), _class(F.col("w2")).alias("k2"), "pos")
    count = each.groupBy(doc, "tier", "k", "k2").agg(F.count(F.lit(1)).alias("cnt"), F.min("pos").alias("first_pos"))
    open_ = F.coalesce(_unsettled(F.col("k")), F.lit(False)) | F.coalesce(_unsettled(F.col("k2")), F.lit(False))
    count = count.withColumn("_open", open_).where(F.col("_open") | (F.col("cnt") >= min_count))
    count = written(count, "counted", packed=True)
    n = norms(vocabulary(pages, doc=doc, which=_unsettled), doc=doc)
    n = written(n.where("w <> norm"), "norms", packed=True)
    of = lambda b: n.select(F.col(doc).alias(f"_d{b}"), F.col("w").alias(f"_w{b}"), F.col("norm").alias(f"_n{b}"))
    # a term of one word looks for that word twice: without a second one all would meet in one task
    met = count.where("_open").withColumn("_k", F.coalesce("k2", "k"))
    met = met.join(of(1), (F.col(doc) == F.col("_d1")) & (F.col("k") == F.col("_w1")), "left").join(of(2), (F.col(doc) == F.col("_d2")) & (F.col("_k") == F.col("_w2")), "left")
    met = met.select(doc, "tier", F.coalesce("_n1", "k").alias("k"), F.when(F.col("k2").isNotNull(), F.coalesce("_n2", "k2")).alias("k2"), "cnt", "first_pos")
    again = met.groupBy(doc, "tier", "k", "k2").agg(F.sum("cnt").alias("cnt"), F.min("first_pos").alias("first_pos")).where(F.col("cnt") >= min_count)
    return count.where("not _open").drop("_open").unionByName(again)


def tiered(pages: DataFrame, italic: DataFrame, *, doc: str = "doc", min_count: int = 5, top: int = 60) -> DataFrame:
    """(doc, rank, term, cnt) of ``paged`` pages: phrases before single words; italic: (doc, w) words set in italics, any number of times.

    Terms are ranked by their words' classes; the few that remain get their norms from those words of the pages that these hang on.
    """
    ranked = _ranks(pages, min_count, doc=doc).withColumn("_r", F.row_number().over(W.partitionBy(doc, "tier").orderBy(F.desc("cnt"), "first_pos")))
    limit = F.when(F.col("tier") == 1, 2 * top).when(F.col("tier") == 2, top).otherwise(4 * top)
    # a common bound first: a limit on the number itself is pushed below the window
    ranked = written(ranked.where(F.col("_r") <= 4 * top).where(F.col("_r") <= limit), "ranked")
    keys = ranked.select(doc, F.explode(F.array_compact(F.array("k", "k2"))).alias("k")).distinct()
    asked = written(keys.select(doc, F.explode(_with_bases(_spellings(F.col("k")))).alias("w")).distinct(), "asked")
    # these tables are some hundred words a document, so that pages are read for them and not shuffled
    there = written(pages.select(doc, F.explode("words.w").alias("w")).join(asked, [doc, "w"], "left_semi").distinct(), "there")
    n = norms(there, doc=doc)
    # a settled class is named by its singular if that occurs or need not occur; norms are there already
    known = there.select(doc, F.col("w").alias("k"), F.lit(True).alias("_there"))
    settled = ~_unsettled(F.col("k")) & ~F.col("k").endswith("ss") & F.col("_there").isNull()
    names = written(keys.join(known, [doc, "k"], "left").select(doc, "k", F.when(settled, F.concat("k", F.lit("s"))).otherwise(F.col("k")).alias("name")), "names")
    name = lambda b: names.select(F.col(doc).alias(f"_d{b}"), F.col("k").alias(f"_k{b}"), F.col("name").alias(f"_n{b}"))
    named = ranked.join(name(1), (F.col(doc) == F.col("_d1")) & (F.col("k") == F.col("_k1"))).join(name(2), (F.col(doc) == F.col("_d2")) & (F.col("k2") == F.col("_k2")), "left")
    ranked = written(named.select(doc, "tier", F.concat_ws(" ", "_n1", "_n2").alias("term"), "cnt", "first_pos", "_r"), "ranked")
    strong, weak = ranked.where("tier < 3"), ranked.where("tier = 3")
    inside = strong.select(doc, F.explode(F.split(F.replace(F.col("term"), F.lit("-"), F.lit(" ")), " +")).alias("term")).distinct()
    weak = written(weak.join(inside, [doc, "term"], "left_anti"), "weak")
    # a norm is its own norm; a word of italics that the pages lack is one as it stands
    spelt = written(weak.select(doc, F.explode(_spellings(F.col("term"))).alias("w")).distinct(), "spelt")
    slanted = italic.select(doc, "w").join(spelt, [doc, "w"], "left_semi").distinct().join(n, [doc, "w"], "left").select(doc, F.coalesce("norm", "w").alias("term")).distinct()
    weak = weak.join(slanted, [doc, "term"], "left_semi").select(*strong.columns)
    stripped = F.btrim(F.btrim(F.btrim("term"), F.lit("-")))
    both = strong.unionByName(weak).withColumn("_term", stripped).where(F.length("_term") >= 3)
    rank = [(F.col("tier") == 3), F.desc("cnt"), F.col("tier"), F.col("_r")]
    once = both.withColumn("_k", F.row_number().over(W.partitionBy(doc, "_term").orderBy(*rank))).where("_k = 1")
    out = once.withColumn("rank", F.row_number().over(W.partitionBy(doc).orderBy(*rank)).cast("long")).where(F.col("rank") <= top)
    return out.select(doc, "rank", F.col("_term").alias("term"), "cnt")


def batches(df: DataFrame, by: list[Column], size: int) -> DataFrame:
    """Adds the number of the batch of ``size`` rows in order, within the key ``doc``."""
    return order.numbered(df, ["doc"], by, "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


# Verdicts that reject.
REJECTS = ["false", "False", "no", "No", "0"]


def keep_terms(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidates (doc, batch, term) whose verdict (doc, batch, term, keep as text) is no rejection.

    A candidate without verdict stays; a batch of which nothing would stay, stays whole.
    """
    said = verdicts.select("doc", "batch", F.lower(F.trim("term")).alias("_t"), F.col("keep").isin(REJECTS).alias("_no")).groupBy("doc", "batch", "_t").agg(F.min(F.coalesce("_no", F.lit(False))).alias("_no"))
    joined = candidates.withColumn("_t", F.lower(F.trim("term"))).join(said, ["doc", "batch", "_t"], "left")
    joined = joined.select(*candidates.columns, (~F.coalesce("_no", F.lit(False))).alias("_ok"))
    whole = F.max("_ok").over(W.partitionBy("doc", "batch"))
    return joined.withColumn("_any", whole).where("_ok or not _any").drop("_ok", "_any")


def decided(term: Column, target: Column) -> Column:
    """Whether a target term can stand in a glossary."""
    t = F.trim(target)
    return (
        F.regexp_like(t, F.lit("[가-힣]"))
        & (X.hangul_ratio(t) >= 0.5)
        & ~F.regexp_like(t, F.lit(X.KEEP))
        & ~F.regexp_like(t, F.lit(r"[|\n\r]"))
        & (F.length(t) <= F.greatest(F.lit(24), F.length(term)))
        & ~F.regexp_like(t, F.lit(r"다\.?$"))
    )


def italic_words(spans: DataFrame, *, doc: str = "doc", text: str = "text", font: str = "font", composed: bool = False) -> DataFrame:
    """(doc, w): distinct words of spans in an italic text font; a mathematical font's are variables."""
    slanted = spans.where((F.col(font).contains("TI") | F.col(font).contains("Italic")) & ~F.col(font).contains("CMMI"))
    mended = X.repair(F.col(text), composed)
    if not composed:  # repair without a damage mark only makes blanks of what becomes one here anyway
        mended = F.when(F.col(text).contains(X.DAMAGE), mended).otherwise(F.col(text))
    letters = F.lower(F.regexp_replace(mended, r"[^A-Za-z\- ]+", " "))
    return slanted.select(doc, F.explode(F.split(letters, " +")).alias("w")).where("w <> ''").distinct()


def translated(items: DataFrame, replies: DataFrame) -> DataFrame:
    """(idx, term, target) of items (idx, term) from replies (pos, term, target): met by lower-case term, or by the item as it stands; null where none.

    Of replies to one term the last by ``pos`` counts.
    """
    known = replies.where(F.col("target").isNotNull()).groupBy(F.lower(F.trim("term")).alias("_t")).agg(F.max_by("target", "pos").alias("target"))
    return items.withColumn("_t", F.lower(F.trim("term"))).join(known, "_t", "left").select("idx", "term", "target")
