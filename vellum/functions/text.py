"""Text repair and text measures as Column expressions.

All but Unicode composition are built-in functions, so they stay inside code generation. Patterns are
Java's; those over unbounded input have possessive inner repeats, since a looped group recurses.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns and glyphs that results hang on.
PLACEHOLDER = r"\{v\d+\}"
KEEP = r"\{v\d+\}|</?style[^>]*>"
STYLE_TAG = r"</style>|<style\s+id=['\"][^'\"]*['\"]\s*>"
STYLE_NEAR = r"(?i)[<〈＜﹤]\s*/?\s*style"
MATH_GLYPHS = "⇡⇤✓⇢⌧⇥⌘⇠⇣⇧⌦◆"
DAMAGE = "↵"
POLITE_END = r"(?:습니다|합니다|입니다|됩니다|십시오|하세요|이에요|예요|드립니다|주세요)\s*[.!?)\]]?\s*$"
CONTROL = r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]"
#: Every character that Python's str.split() takes for white space.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
#: Signs at the end of a text that are searched for an ending first.
TAIL = 64


def ligature(c: Column) -> Column:
    """The damage mark after a Latin letter is the ligature ff, elsewhere alpha."""
    return F.replace(F.regexp_replace(c, f"(?<=[A-Za-z]){DAMAGE}", "ff"), F.lit(DAMAGE), F.lit("α"))


def scrub(c: Column) -> Column:
    """Control characters become blanks, runs of blanks one blank."""
    return F.regexp_replace(F.regexp_replace(c, CONTROL, " "), r"[ \t]{2,}", " ")


@F.pandas_udf(T.ArrayType(T.StringType()))
def compose(parts: pd.Series) -> pd.Series:
    """Unicode composition of each part; Spark has no built-in for it."""
    return parts.map(lambda p: None if p is None else [None if x is None else unicodedata.normalize("NFC", x) for x in p])


def runs(c: Column) -> Column:
    """The n + 1 runs of text around n kept marks."""
    return F.split(c, KEEP, -1)


def kept(c: Column) -> Column:
    """The n marks that must survive as they are."""
    return F.regexp_extract_all(c, F.lit(KEEP), 0)


def woven(parts: Column, marks: Column) -> Column:
    """Runs and marks in turn, as one text."""
    return F.array_join(F.flatten(F.zip_with(parts, marks, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def repair(c: Column, composed: bool = True) -> Column:
    """Damaged text mended outside of placeholders and style tags; null and empty stay."""
    parts = F.transform(runs(c), ligature)
    # only texts beyond ASCII leave the JVM; composition changes no others
    parts = F.coalesce(compose(F.when(F.regexp_like(c, F.lit(r"[^\x00-\x7f]")), parts)), parts) if composed else parts
    return woven(F.transform(parts, scrub), kept(c))


def math_leaks(c: Column) -> Column:
    """Sorted distinct mathematical glyphs; none for null."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"[{MATH_GLYPHS}]"), 0)))


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def chars_of(c: Column, kind: str) -> Column:
    """How many characters are of a class; unlike ``count_of``, no array of them is made."""
    return F.length(c) - F.length(F.regexp_replace(c, f"{kind}++", ""))


def hangul_ratio(c: Column) -> Column:
    """Hangul syllables to letters: 0 for null and empty, 1 where there are no letters."""
    # among letters alone the syllables stand in few long runs, so that the second pass is nearly free
    ratio = once(F.regexp_replace(c, r"\P{L}++", ""), lambda x: F.when(x == "", 1.0).otherwise(chars_of(x, "[가-힣]") / F.length(x)))
    return F.when(c.isNull() | (c == ""), 0.0).otherwise(ratio)


def looks_damaged(c: Column, threshold: int = 20) -> Column:
    return chars_of(c, f"[{DAMAGE}{MATH_GLYPHS}]") >= threshold


def language_tag(c: Column) -> Column:
    """The Korean locale's tag spelt out for people."""
    return F.regexp_replace(c, r"(?i)\bko[-_]KR\b", "Korean (한국어)")


def without_glossary(c: Column) -> Column:
    """A glossary section becomes one line break, up to the next heading or the end."""
    return F.regexp_replace(c, rf"(?is)\n#+{SPACE}*Glossary.*?(?=\n#+{SPACE}|\z)", "\n")


def width(c: Column) -> Column:
    """Estimated set width in em: white space first, then Hangul and wide signs, then the rest."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), STYLE_TAG, ""), PLACEHOLDER, "")

    def of(n: Column, rest: Column) -> Column:
        # without white space the wide signs stand in few long runs
        return once(n - F.length(rest), lambda space: once(chars_of(rest, r"[가-힣\x{3001}-\x{9fff}]"), lambda wide: 0.33 * space + 1.0 * wide + 0.5 * (n - space - wide)))

    both = once(s, lambda x: F.struct(F.length(x).alias("n"), F.regexp_replace(x, f"{SPACE}++", "").alias("rest")))
    return once(both, lambda x: of(x["n"], x["rest"]))


def ascii_letters(c: Column) -> Column:
    return chars_of(c, "[A-Za-z]")


def has_ascii_letters(c: Column, least: int) -> Column:
    """Whether ``ascii_letters`` is ``least`` or more; the search ends with that letter."""
    return F.regexp_like(c, F.lit(rf"(?:[A-Za-z][^A-Za-z]*+){{{least}}}"))


def is_blank(c: Column) -> Column:
    """Null, or white space alone."""
    return c.isNull() | ~F.regexp_like(c, F.lit(NOT_SPACE))


def polite(c: Column) -> Column:
    """A polite ending; only the last signs are searched, unless they are all white space and marks."""
    tail = F.right(c, F.lit(TAIL))
    # what stands before the tail can belong to an ending only if nothing but white space and a mark follows its first syllables
    long = (F.length(c) > TAIL) & F.regexp_like(tail, F.lit(r"^(?s).{0,5}\s*+[.!?)\]]?\s*+$"))
    return F.regexp_like(tail, F.lit(POLITE_END)) | (long & F.regexp_like(c, F.lit(POLITE_END)))


def translatable(c: Column) -> Column:
    """Three letters at least."""
    return chars_of(c, r"\p{L}") >= 3


# A run of six English words or more, and a year.
ENGLISH_RUN = rf"[A-Za-z][A-Za-z'’\-]*+(?:{SPACE}++[A-Za-z][A-Za-z'’\-]*+){{5,}}+"
YEAR_NEAR = r"(?:^|[^\p{L}\p{N}_])(?:1[89]|20)\d\d[a-z]?(?:$|[^\p{L}\p{N}_])"


def leftover_english(c: Column) -> Column:
    """The first run of English prose that a translated text still holds, or null.

    A run does not count if it has few long words, is all capitals, is names or titles, or stands within
    60 characters of a year; and nothing counts in a text that is hardly translated at all.
    """
    masked = F.regexp_replace(c, KEEP, " ")
    searched = once(masked, lambda body: F.struct(body.alias("body"), F.regexp_extract_all(body, F.lit(ENGLISH_RUN), 0).alias("found")))
    cut = lambda x: F.struct(x["body"].alias("body"), F.split(x["body"], ENGLISH_RUN, -1).alias("gaps"), x["found"].alias("found"))
    # most texts have no run at all: they are not measured
    return once(searched, lambda x: F.when(F.size(x["found"]) > 0, F.when(~(hangul_ratio(x["body"]) < 0.15), once(cut(x), _first_run))))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _first_run(x: Column) -> Column:
    body, gaps, found = x["body"], x["gaps"], x["found"]

    def with_start(run: Column, k: Column) -> Column:
        before = F.aggregate(F.slice(gaps, 1, k + 1), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice(found, 1, k), F.lit(0), lambda s, x: s + F.length(x))
        return F.struct(run.alias("run"), before.alias("at"))

    def stands(x: Column) -> Column:
        run, at = x["run"], x["at"]
        words = F.split(run, f"{SPACE}+")
        start = F.greatest(at - 60, F.lit(0))
        near = F.substring(body, start + 1, at + F.length(run) + 60 - start)
        return (
            (F.size(F.filter(words, lambda w: F.length(w) >= 3)) >= 4)
            & (F.upper(run) != run)
            & (F.size(F.filter(words, lambda w: F.regexp_like(w, F.lit("^[A-Z]")))) < F.size(words) - 1)
            & ~F.regexp_like(near, F.lit(YEAR_NEAR))
        )

    return F.get(F.filter(F.transform(found, with_start), stands), F.lit(0))["run"]
