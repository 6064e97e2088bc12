"""Spelling variants: words one edit apart, found by automata over the halves of the words.

A word of L code points is cut into its first L // 2 and the rest. Of two words one insertion, deletion or replacement
apart, one keeps a half of the other whole, at its beginning or at its end. Aho-Corasick automata hold the halves in shards,
dealt by the half's hash. A word is scanned by the shards that can hold a half of a near word: those of its
beginnings and ends of the fitting lengths. A hit counts if it stands at the half's own end of the word and the lengths
differ by one at most; then what is left of both is compared. A pair with both halves found counts at the first.

No pair leaves a task: a word comes out of a shard with the number of its near words and the best of them. Words that share a half and a
length are compared one by one up to ``FEW``; more are looked up by what is left without one sign, so the work
of a frequent half does not grow with the square of its words. A half with over ``MOST`` words is dealt over several
shards, and its scanned words go to all of those.

Null texts have no words. Words of one sign have no halves and are near to nothing. A word without near words has none to form. Equal rows count each. Ties: the code-point order of
words. Very long words are compared one by one. Empty tables give no rows, extra columns are not touched.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Halves of a shard, about; words of one half in a shard at most.
HALVES, MOST = 40_000, 20_000
#: Words of one half and length that are compared one by one; longer rests always are.
FEW, LONG = 8, 64
#: Distinct words that a task counts before it hands them on.
HELD = 250_000


def counted(df: DataFrame, *, key: str = "doc_id", text: str = "text", spoil: int | None = None) -> DataFrame:
    """(word, n) of all texts' runs of Latin letters, A-Z as a-z; n: occurrences.

    spoil: where it divides the crc32 of ``<key>:<run>``, that number names a sign of the run that is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        give = lambda: pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = Counter(RUN.findall(lower(t or "")))
                if spoil:
                    base = zlib.crc32(f"{'' if name is None else name}:".encode())
                    for w, n in found.items():
                        h = zlib.crc32(w.encode(), base)
                        held[w if h % spoil else w[: h % len(w)] + w[h % len(w) + 1 :]] += n
                else:
                    held.update(found)
                if len(held) > HELD:
                    yield give()
                    held.clear()
        yield give()

    rows = df.select(F.col(key).cast("string"), F.col(text)).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def lower(text: str) -> str:
    return text.lower() if text.isascii() else text.encode().lower().decode()


def one_apart(a: str, b: str) -> bool:
    """Whether one insertion, deletion or replacement makes a out of b."""
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else i < len(a) and a[i + 1 :] == b[i + 1 :]


class Group:
    """Words of one length that share a half: their rests, and, once there are many, an index of them."""

    __slots__ = ("longer", "plain", "rests", "same")

    def __init__(self) -> None:
        self.rests: list[tuple[str, int]] = []
        self.plain: dict[str, int] | None = None

    def near(self, rest: str, more: int) -> Iterator[int]:
        """Words whose rest is one apart; more: how many signs their rest has more than this one."""
        if len(self.rests) <= FEW or len(rest) > LONG:
            yield from (i for r, i in self.rests if one_apart(rest, r))
            return
        if self.plain is None:
            self.plain, self.same, self.longer = {}, {}, {}
            for r, i in self.rests:
                self.plain[r] = i
                for k in range(len(r)):
                    self.same.setdefault(f"{r[:k]}\0{r[k + 1 :]}", []).append(i)
                for s in {r[:k] + r[k + 1 :] for k in range(len(r))}:
                    self.longer.setdefault(s, []).append(i)
        if more == 1:
            yield from self.longer.get(rest, ())
        elif more == 0:
            me = self.plain.get(rest)
            for k in range(len(rest)):
                yield from (i for i in self.same.get(f"{rest[:k]}\0{rest[k + 1 :]}", ()) if i != me)
        else:
            for s in {rest[:k] + rest[k + 1 :] for k in range(len(rest))}:
                if s in self.plain:
                    yield self.plain[s]


class Shard:
    """An automaton over halves of words; sides: 0 the beginning of a word, 1 its end."""

    def __init__(self) -> None:
        self.words: list[tuple[int, str]] = []  # (-n, word): the least is the best
        self.halves: dict[str, dict[tuple[int, int], Group]] = {}
        self.automaton: ahocorasick.Automaton | None = None

    def add(self, side: int, word: str, n: int) -> None:
        half = len(word) // 2
        segment, rest = (word[:half], word[half:]) if side == 0 else (word[half:], word[:half])
        self.halves.setdefault(segment, {}).setdefault((side, len(word)), Group()).rests.append((rest, len(self.words)))
        self.words.append((-n, word))

    def seal(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for segment, groups in self.halves.items():
            self.automaton.add_word(segment, (len(segment), groups))
        self.automaton.make_automaton()

    def scan(self, word: str) -> tuple[int, tuple[int, str] | None]:
        """(number of near words, the best of them) among the words of which the shard holds the half that stays whole."""
        found, best, n = 0, None, len(word)
        if not self.halves:
            return 0, None
        for end, (size, groups) in self.automaton.iter(word):
            first = end + 1 == size
            last = end + 1 == n
            if not (first or last):
                continue
            for (side, length), group in groups.items():
                if -1 <= length - n <= 1 and (first if side == 0 else last):
                    for i in group.near(word[size:] if side == 0 else word[: n - size], length - n):
                        other = self.words[i]
                        if side == 1 and word.startswith(other[1][: length // 2]):
                            continue  # counted by its first half
                        found += 1
                        if best is None or other < best:
                            best = other
        return found, best


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, best): for the words (word, n) that have near words, their number and (-n, word) of the best."""
    words = words.select("word", "n").where("length(word) > 1")
    shards = max(1, -(-2 * words.count() // HALVES))
    size = F.length("word")
    half = F.floor(size / 2).cast("int")
    side = lambda i, part: F.struct(F.lit(i).alias("side"), part.alias("half"))
    begin, end = (lambda k: F.substring("word", F.lit(1), k)), (lambda k: F.right("word", k))
    own = words.select("word", "n", F.explode(F.array(side(0, begin(half)), side(1, end(size - half)))).alias("s")).select("word", "n", "s.*")
    # fewer than 2 * words / MOST halves have so many words
    hot = own.groupBy("side", "half").count().where(F.col("count") > MOST).select("side", "half", F.ceil(F.col("count") / MOST).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    shard = lambda part: F.pmod(F.xxhash64("side", "half", part), F.lit(shards)).cast("int").alias("shard")
    held = own.join(F.broadcast(hot), ["side", "half"], "left").withColumn("part", F.pmod(F.xxhash64("word"), parts).cast("int"))
    held = held.select(shard(F.col("part")), F.lit(0).alias("scan"), "side", "word", "n")
    # halves of words that are one shorter, as long and one longer
    lengths = [(size + d, F.floor((size + d) / 2).cast("int")) for d in (-1, 0, 1)]
    routes = F.array_distinct(F.array(*(side(0, begin(k)) for _, k in lengths), *(side(1, end((m - k).cast("int"))) for m, k in lengths)))
    asked = words.select("word", F.explode(routes).alias("s")).select("word", "s.*").join(F.broadcast(hot), ["side", "half"], "left")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("word", shard(F.col("part"))).distinct()
    both = held.unionByName(asked.select("shard", F.lit(1).alias("scan"), F.lit(0).alias("side"), "word", F.lit(0).cast("long").alias("n")))
    both = both.repartition(shards, "shard").sortWithinPartitions("shard", "scan").select("shard", "scan", "side", "word", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = Shard(), None
        for batch in batches:
            out = []
            for number, scan, side_, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if number != at:
                    now, at = Shard(), number
                if not scan:
                    now.add(side_, word, n)
                    continue
                if now.automaton is None:
                    now.seal()
                found, best = now.scan(word)
                if found:
                    out.append((word, found, *best))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "minus", "other"])

    hits = both.mapInArrow(run, "word string, n_near long, minus long, other string")
    return hits.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus", "other")).alias("best"))


def variants(words: DataFrame, *, times: int = 2) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of words (word, n): the most frequent near word, if it is ``times`` as frequent.

    root: what following forms leads to. Forms grow in frequency, so the ways end; each turn doubles how far a word sees.
    """
    words = cut(words.select("word", "n"))
    ranked = words.join(near(words), "word", "left").withColumn("_form_n", -F.col("best.minus"))
    fits: Column = F.col("_form_n") >= times * F.col("n")
    found = cut(ranked.select("word", "n", F.when(fits, F.col("best.other")).alias("form"), F.when(fits, F.col("_form_n")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")))
    ways = cut(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = cut(ways.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        ways = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return found.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
