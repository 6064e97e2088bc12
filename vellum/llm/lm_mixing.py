"""Language-model scores by online logistic context mixing.

A text is a sequence of lower-case words and an end. The commonest training words (``CODED``) and the end have
binary (Huffman) codes of their own; the other words have the code of a bucket, which the last three bytes name. Every bit is
predicted by several predictors, each from the counts under a hashed context and the place in the code: the
last of the few commonest words (it tells languages and styles apart; its counts lean on those without context), the word before, the two words before.
Predictions are stretched to log-odds and combined with weights chosen by a gate, the confidences of the two longer
contexts. The weights start from fixed values and follow each text's own gradient, block by block. A last table refines the mixed
log-odds by what log-odds like it came to, and follows the text too.

Below a bucket only one predictor knows more, the words' own counts, so its bits telescope to the word's share of the
bucket: its count, which every training word keeps however rare it is, over the bucket's, times what Good and Turing leave
to words seen. A word unseen is a bit for that and its spelling: its bytes' bits under the same mixer, with
the one, two, three and five bytes before as contexts, counted over the training words seen once. Unseen words that come
again in the text are predicted from the text (a Chinese restaurant process). The sum of the bits' logarithms is the score.

What is gathered grows with the input: all words' counts stay in a table that the texts are joined with. The
commonest ``LOCAL`` words' counts are broadcast, so that no frequent word is a hot key. The two hashed context tables have a slot for each
training token up to ``TABLE_BITS``; beyond it contexts share slots. They are summed by tasks and then
in groups of bounded size, in levels. Training texts are scored by the model that has seen them, as in the base score.

Null texts count as empty, that is an end alone; rows that repeat are scored each; equal counts are ranked by the word's bytes;
other columns are not touched. Without training texts every word is unseen and counts are zero. Arrays of a step are bounded
by ``STEP`` bytes of text and ``SLICE`` tokens' bits; a longer text is a step of its own whose bits come slice by slice.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, rows_of, steps, text_bytes

#: Words with codes of their own, buckets of the others, words whose counts are broadcast and their bytes.
CODED = 1 << 14
BUCKETS = 128
LOCAL, LOCAL_BYTES = 1 << 17, 16_000_000
#: The commonest words that serve as the skipping context.
COMMON = 64
TABLE_BITS = 20
SPELL_BITS = 18
#: Tokens, or bytes of spellings, of a block of the online updates.
BLOCK, SPELL_BLOCK = 64, 32
#: Levels of confidence of a count, and those of two contexts together.
LEVELS, GATES = 4, 16
RATE, REFINE = 0.1, 0.1
#: Bytes of texts and tokens whose bits are held at once.
STEP, SLICE = 800_000, 1 << 15
#: Slots of one piece of a table, and tables that one task sums.
PIECE = 1 << 13
FAN_IN = 64
#: A new unseen word's weight against those of the text.
NOVEL = 4.0
END = 0x20
_LOG10_2 = math.log10(2)
_K = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BUCKETS


def scrambled(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * _K
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Ranks(dict):
    """Rank of a local word; of any other its bucket's place after them."""

    def __missing__(self, word: bytes) -> int:
        return len(self) + bucket(word)


class Code:
    """Huffman codes of the coded words, then buckets, then end; as flat paths of inner nodes and bits."""

    def __init__(self, ranked: list[tuple[bytes, int]], totals: np.ndarray, ends: int):
        """ranked: the local words with counts; totals: of the buckets, without coded words."""
        self.rank = Ranks((w, i) for i, (w, _) in enumerate(ranked))
        coded = min(len(ranked), CODED)
        self.end, self.symbols = coded + BUCKETS, coded + BUCKETS + 1
        #: Symbol and count of each local word, then of what is in a bucket, then of the end.
        self.symbol = np.array([*range(coded), *(coded + bucket(w) for w, _ in ranked[coded:]), *range(coded, self.symbols)], np.int64)
        self.count = np.array([c for _, c in ranked] + [0] * BUCKETS + [ends], np.int64)
        self.local, self.coded = len(ranked), coded
        weights = [c for _, c in ranked[:coded]] + [int(t) + 1 for t in totals] + [ends + 1]
        heap = [(w, i, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        new = len(weights)
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x], parent[y] = (new, 0), (new, 1)
            heapq.heappush(heap, (a + b, new, new))
            new += 1
        paths = []
        for i in range(len(weights)):
            path = []
            while i in parent:
                i, bit = parent[i]
                path.append((i - len(weights)) << 1 | bit)
            paths.append(path[::-1])
        self.nodes = new - len(weights)
        self.length = np.array([len(p) for p in paths], np.int64)
        self.at = np.cumsum(self.length) - self.length
        flat = np.array([x for p in paths for x in p], np.int64)
        self.node, self.bit = flat >> 1, flat & 1
        self.hash = scrambled(self.node + 1)

    def ids(self, tokens: list[bytes]) -> np.ndarray:
        """Of each token its rank among the local words, else its bucket's place after them; and the end's at last."""
        out = np.empty(len(tokens) + 1, np.int64)
        out[:-1] = np.fromiter(map(self.rank.__getitem__, tokens), np.int64, len(tokens))
        out[-1] = self.local + BUCKETS
        return out


class Tokens:
    """Some texts' tokens with their contexts, in order of their blocks if wanted."""

    def __init__(self, code: Code, ids: list[np.ndarray], ordered: bool = True):
        lengths = np.array([len(s) for s in ids])
        flat = np.concatenate(ids)
        starts = np.cumsum(lengths) - lengths
        doc = np.repeat(np.arange(len(ids)), lengths)
        begin = starts[doc]
        at = np.arange(len(flat))
        place = at - begin
        one = np.where(place > 0, np.concatenate([[0], flat[:-1]]) + 1, 0)
        two = np.where(place > 1, np.concatenate([[0, 0], flat[:-2]])[: len(flat)] + 1, 0)
        last = np.maximum.accumulate(np.where(flat < min(COMMON, code.coded), at, -1))
        last = np.concatenate([[-1], last[:-1]])
        skip = np.where(last >= begin, flat[last] + 1, 0)
        self.symbol, self.doc, self.block, self.skip = code.symbol[flat], doc, place // BLOCK, skip
        self.one, self.two = scrambled(one * 2 + 1), scrambled((two << 20) + one + (1 << 50))
        if ordered:
            order = np.argsort(self.block.astype(np.uint16) if self.block.max(initial=0) < 1 << 16 else self.block, kind="stable")
            self.symbol, self.doc, self.block, self.skip, self.one, self.two = (x[order] for x in (self.symbol, self.doc, self.block, self.skip, self.one, self.two))

    def slices(self) -> Iterator[slice]:
        """Tokens in turn, blocks whole."""
        edges = np.concatenate([[0], np.flatnonzero(np.diff(self.block)) + 1, [len(self.block)]])
        a = 0
        for i in range(1, len(edges)):
            if i == len(edges) - 1 or edges[i + 1] - a > SLICE:
                yield slice(a, int(edges[i]))
                a = int(edges[i])


def bits_of(code: Code, tokens: Tokens, part: slice, table_bits: int) -> tuple[np.ndarray, ...]:
    """(token, node, bit, slot by one word, slot by two) of each bit of some tokens."""
    symbol = tokens.symbol[part]
    n = code.length[symbol]
    ends = np.cumsum(n)
    token = np.repeat(np.arange(len(symbol)), n)
    at = np.arange(len(token)) + (code.at[symbol] - ends + n)[token]
    own, shift = code.hash[at], np.uint64(64 - table_bits)
    slots = []
    for x in (tokens.one, tokens.two):
        slot = x[part][token]
        slot ^= own
        slot *= _K
        slot >>= shift
        slots.append(slot.view(np.int64))
    one, two = slots
    return token, code.node[at], code.bit[at], one, two


def spelled(data: np.ndarray, place: np.ndarray, a: int, b: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Slots in the spelling tables and value of each bit of data[a:b], words with an ``END`` each; place: of a byte in its word."""
    own, at = data[a:b].astype(np.int64), place[a:b]
    back = []
    for k in range(1, 6):
        before = np.zeros(b - a, np.int64)
        low = max(a - k, 0)
        if b - k > low:
            before[low + k - a :] = data[low : b - k]
        back.append(np.where(at >= k, before, 0))
    two = back[0] | back[1] << 8
    three = two | back[2] << 16
    contexts = (back[0] | np.minimum(at, 7) << 8, two, three, three | back[3] << 24 | back[4] << 32)
    shift = np.arange(7, -1, -1)
    bit = (own[:, None] >> shift & 1).ravel()
    node = ((1 << np.arange(8)) | (own[:, None] >> (shift + 1)) & ((1 << np.arange(8)) - 1)).ravel()
    hashed = scrambled(node)
    return [((np.repeat(scrambled(c * 8 + k + 1), 8) ^ hashed) * _K >> np.uint64(64 - SPELL_BITS)).astype(np.int64) for k, c in enumerate(contexts)], bit


def stream(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words, each with an ``END``, and each byte's place in its word."""
    lengths = np.array([len(t) + 1 for t in tokens])
    data = np.frombuffer(b"".join(t + bytes([END]) for t in tokens), np.uint8)
    return data, np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


#: Log-odds of a slot's byte: 63 steps from -8 to 8 in the low bits, above them the level of confidence.
STRETCHED = np.tile((np.arange(64) - 31) * np.float32(8 / 31), 4).clip(-8, 8).astype(np.float32)


def packed(counts: np.ndarray) -> np.ndarray:
    """(zeros, ones) as one byte each."""
    n0, n1 = counts[:, 0], counts[:, 1]
    odds = np.clip(np.log((n1 + 0.4) / (n0 + 0.4)), -8, 8)
    level = np.digitize(n0 + n1, [1, 3, 12])
    return (level << 6 | np.rint(odds * 31 / 8).astype(np.int64) + 31).astype(np.uint8)


class Mixer:
    """Weights by text and gate, and each text's last table."""

    def __init__(self, start: np.ndarray, docs: int):
        self.inputs = start.shape[1]
        self.w = np.tile(start.astype(np.float32).T, docs)
        self.last = np.tile(np.linspace(-8, 8, 33, dtype=np.float32), docs)

    def step(self, doc: np.ndarray, gate: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Loss (nats) of each bit of a block; the weights and the table follow it. x: a row for each input; y: 1 or -1."""
        at = doc * GATES + gate
        dot = self.w[0].take(at)
        dot *= x[0]
        for k in range(1, self.inputs):
            dot += self.w[k].take(at) * x[k]
        np.clip(dot, -12, 12, out=dot)
        cell = np.rint((np.clip(dot, -8, 8) + np.float32(8)) * np.float32(2)).astype(np.int64) + doc * 33
        refined = self.last[cell]
        miss = np.exp(-y * (dot + refined) * np.float32(0.5))
        # of a block with few texts only these texts' weights are touched
        first = int(doc.min())
        low = first * GATES
        local = at - low
        rate = RATE / np.sqrt(1 + np.bincount(local))
        error = y / (1 + np.exp(y * dot))
        for k in range(self.inputs):
            self.w[k, low : low + len(rate)] += rate * np.bincount(local, error * x[k])
        low = first * 33
        local = cell - low
        rate = REFINE / np.sqrt(1 + np.bincount(local))
        self.last[low : low + len(rate)] += rate * np.bincount(local, y * miss / (1 + miss))
        return np.log1p(miss)


def _starts() -> np.ndarray:
    """Fixed starting weights: the surer a longer context, the more it counts."""
    out = np.zeros((GATES, 3))
    for a in range(LEVELS):
        for b in range(LEVELS):
            two, one = (0, 0.2, 0.35, 0.6)[b], (0, 0.1, 0.15, 0.25)[a]
            out[a * LEVELS + b] = [max(0.95 - 0.3 * (one + two), 0.1), one * (1, 0.7, 0.5, 0.3)[b], two]
    return out


def _spell_starts() -> np.ndarray:
    out = np.zeros((GATES, 4))
    for a in range(LEVELS):
        for b in range(LEVELS):
            five, three = (0, 0.1, 0.2, 0.3)[b], (0, 0.3, 0.5, 0.6)[a]
            out[a * LEVELS + b] = [0.1, 0.4 - five * 0.3, three, five]
    return out


class Model:
    """wide: counts of (skipping context, symbol); tables: packed by one and by two words; seen_once: tokens of each bucket seen once; totals: all of each."""

    def __init__(self, code: Code, wide: np.ndarray, tables: list[np.ndarray], spell: list[np.ndarray], totals: np.ndarray, seen_once: np.ndarray):
        self.code, self.tables, self.spell = code, tables, spell
        self.table_bits = int(math.log2(len(tables[0])))
        owner = np.repeat(np.arange(code.symbols), code.length)
        cells = code.node * 2 + code.bit
        made = np.array([np.bincount(cells, row[owner], minlength=2 * code.nodes) for row in wide.reshape(COMMON + 1, code.symbols)]).reshape(COMMON + 1, code.nodes, 2)
        p = made.sum(axis=0) + 0.4
        p /= p.sum(axis=1, keepdims=True)
        # the skipping context's counts lean on those without one
        made = made + 4 * p
        self.skip = np.log(made[..., 1] / made[..., 0]).ravel().astype(np.float32)
        #: Log10 share of seen words below a bucket, without the words' counts, and of unseen ones.
        unseen = (seen_once + 1) / (totals + 2)
        self.seen, self.unseen = np.log10(1 - unseen) - np.log10(np.maximum(totals, 1)), np.log10(unseen)

    def score(self, tokens: Tokens, docs: int) -> np.ndarray:
        """Log10 probability of each text's symbols."""
        mixer, total = Mixer(_starts(), docs), np.zeros(docs)
        for part in tokens.slices():
            token, node, bit, one, two = bits_of(self.code, tokens, part, self.table_bits)
            one, two = self.tables[0][one], self.tables[1][two]
            x = np.empty((3, len(token)), np.float32)
            x[0], x[1], x[2] = self.skip[(tokens.skip[part] * self.code.nodes)[token] + node], STRETCHED[one], STRETCHED[two]
            gate = ((one >> 6) * LEVELS + (two >> 6)).astype(np.int64)
            doc, y = tokens.doc[part][token], (2 * bit - 1).astype(np.float32)
            last = np.cumsum(self.code.length[tokens.symbol[part]])  # bits up to each token
            edges = np.concatenate([[0], last[np.flatnonzero(np.diff(tokens.block[part]))], last[-1:]])
            loss = [mixer.step(doc[a:b], gate[a:b], x[:, a:b], y[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if a < b]
            if loss:
                total -= np.bincount(doc, np.concatenate(loss), minlength=docs)
        return total / math.log(10)

    def novel(self, found: list[list[tuple[bytes, int]]]) -> np.ndarray:
        """For each text the log10 probability of its unseen words, each with how often it stands there, beyond that they are unseen."""
        total = np.zeros(len(found))
        for i, own in enumerate(found):
            times = sum(k for _, k in own)
            total[i] = len(own) * math.log(NOVEL) + sum(math.lgamma(k) for _, k in own) - math.lgamma(NOVEL + times) + math.lgamma(NOVEL)
        streams = [stream([w for w, _ in own]) if own else None for own in found]
        sizes = np.array([len(x[0]) if x else 0 for x in streams])
        mixer = Mixer(_spell_starts(), len(found))
        for a in range(0, int(sizes.max(initial=0)), SPELL_BLOCK):
            live = np.flatnonzero(sizes > a)
            made = [spelled(*streams[i], a, min(a + SPELL_BLOCK, int(sizes[i]))) for i in live.tolist()]
            bit = np.concatenate([m[1] for m in made])
            codes = [t[np.concatenate([m[0][k] for m in made])] for k, t in enumerate(self.spell)]
            x = np.stack([STRETCHED[c] for c in codes])
            gate = ((codes[2] >> 6) * LEVELS + (codes[3] >> 6)).astype(np.int64)
            doc = np.repeat(live, [len(m[1]) for m in made])
            total -= np.bincount(doc, mixer.step(doc, gate, x, (2 * bit - 1).astype(np.float32)), minlength=len(found))
        return total / math.log(10)


def _small(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as they need, which the first byte names; where most are zero, the places of the others and these."""
    kind = np.min_scalar_type(int(counts.max()))
    places = np.flatnonzero(counts)
    if len(places) * (2 + kind.itemsize) < len(counts) * kind.itemsize // 2:
        return bytes([kind.itemsize, 1]) + places.astype("<u2").tobytes() + counts[places].astype(kind).tobytes()
    return bytes([kind.itemsize, 0]) + counts.astype(kind).tobytes()


def _added(data: bytes, to: np.ndarray) -> None:
    kind = f"<u{data[0]}"
    if data[1]:
        n = (len(data) - 2) // (2 + data[0])
        to[np.frombuffer(data, "<u2", n, 2)] += np.frombuffer(data, kind, n, 2 + 2 * n).astype(np.int64)
    else:
        part = np.frombuffer(data, kind, -1, 2)
        to[: len(part)] += part.astype(np.int64)


def _pieces(tables: list[np.ndarray]) -> pa.RecordBatch:
    """A task's tables of counts, cut up."""
    kind, piece, data = [], [], []
    for t, table in enumerate(tables):
        for i in range(0, len(table), PIECE):
            part = table[i : i + PIECE]
            if part.any():
                kind.append(t)
                piece.append(i // PIECE)
                data.append(_small(part))
    return pa.record_batch([pa.array(kind, pa.int32()), pa.array(piece, pa.int32()), pa.array([TaskContext.get().partitionId()] * len(kind), pa.int32()), pa.array(data, pa.binary())], names=["t", "piece", "task", "data"])


def _total(group: pa.Table) -> np.ndarray:
    total = np.zeros(PIECE, np.int64)
    for x in group["data"]:
        _added(x.as_py(), total)
    return total


def _sum(group: pa.Table) -> pa.Table:
    one = group.slice(0, 1)
    return pa.table([one["t"], one["piece"], pa.array([one["task"][0].as_py() // FAN_IN], pa.int32()), pa.array([_small(_total(group))], pa.binary())], names=["t", "piece", "task", "data"])


def summed(parts: DataFrame, sizes: list[int], whole: int = 0) -> list[np.ndarray]:
    """The tables' totals, from tasks' pieces, by levels of at most FAN_IN tables a task; pairs of counts are packed but for the first ``whole`` tables."""
    parts = cut(parts)
    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > FAN_IN:
        parts = cut(parts.groupBy("t", "piece", F.floor(F.col("task") / FAN_IN).alias("_g")).applyInArrow(_sum, "t int, piece int, task int, data binary"))
        tasks = -(-tasks // FAN_IN)

    def shrink(group: pa.Table) -> pa.Table:
        one, total = group.slice(0, 1), _total(group)
        small = total.astype("<i8") if one["t"][0].as_py() < whole else packed(total.reshape(-1, 2))
        return pa.table([one["t"], one["piece"], pa.array([small.tobytes()], pa.binary())], names=["t", "piece", "data"])

    empty = packed(np.zeros((1, 2), np.int64))[0]
    out = [np.zeros(n, np.int64) if t < whole else np.full(n, empty, np.uint8) for t, n in enumerate(sizes)]
    for r in parts.groupBy("t", "piece").applyInArrow(shrink, "t int, piece int, data binary").collect():
        t, width = r["t"], PIECE if r["t"] < whole else PIECE // 2
        part = np.frombuffer(r["data"], "<i8" if t < whole else np.uint8)
        room = out[t][r["piece"] * width : (r["piece"] + 1) * width]
        room[:] = part[: len(room)]
    return out


def count_words(training: DataFrame, text: str) -> DataFrame:
    """(token, c, h) of all training words, and the end as the token null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        ends = 0

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["token", "c"])

        for batch in batches:
            for x in text_bytes(batch.column(0)):
                held.update(words(x))
                ends += 1
                if len(held) > 300_000:
                    yield out()
                    held.clear()
        if held:
            yield out()
            held.clear()
        if ends:
            yield pa.record_batch([pa.array([None], pa.binary()), pa.array([ends], pa.int64())], names=["token", "c"])
        give_back()

    counted = training.select(text).mapInArrow(run, "token binary, c long")
    return counted.groupBy("token").agg(F.sum("c").alias("c")).withColumn("h", F.xxhash64("token"))


def local_words(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The commonest words, at most ``LOCAL`` and ``LOCAL_BYTES``: those whose counts reach a threshold, by count and bytes."""
    level = F.floor(F.log2("c") * 32)
    named = counts.where(F.col("token").isNotNull())
    least, n, size = None, 0, 0
    for r in sorted(named.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("token")).alias("s")).collect(), reverse=True):
        n, size = n + r["n"], size + r["s"]
        if n > LOCAL or size > LOCAL_BYTES:
            break
        least = r["l"]
    if least is None:
        return []
    return sorted(((bytes(r["token"]), r["c"]) for r in named.where(level >= least).select("token", "c").collect()), key=lambda x: (-x[1], x[0]))


def fit(training: DataFrame, counts: DataFrame, *, text: str = "text") -> tuple[Model, int, int]:
    """(model, all tokens, distinct tokens) from the training texts and their counted words."""
    whole = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("token").isNull(), F.col("c"))).alias("e")).first()
    n, v, ends = whole["n"] or 0, whole["v"] or 0, whole["e"] or 0
    ranked = local_words(counts)
    totals, once = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    by = F.crc32(F.substring("token", -3, 3)) % BUCKETS
    for r in counts.where(F.col("token").isNotNull()).groupBy(by.alias("b")).agg(F.sum("c").alias("n"), F.count_if(F.col("c") == 1).alias("once")).collect():
        totals[r["b"]], once[r["b"]] = r["n"], r["once"]
    for w, c in ranked[:CODED]:
        totals[bucket(w)] -= c
        once[bucket(w)] -= c == 1
    code = Code(ranked, totals, ends)
    shared = training.sparkSession.sparkContext.broadcast(code)
    table_bits = min(TABLE_BITS, max(10, int(n).bit_length()))
    sizes = [(COMMON + 1) * code.symbols, 1 << table_bits, 1 << table_bits]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        tables = [np.zeros(s, np.int32) for s in (sizes[0], 2 * sizes[1], 2 * sizes[2])]
        any_text = False
        for batch in batches:
            texts = text_bytes(batch.column(0))
            for part in steps(texts, STEP):
                any_text = True
                count_bits(code, tables, texts[part], table_bits)
            give_back()
        if any_text:
            yield _pieces(tables)
        del tables
        give_back()

    def gather_spelling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 << SPELL_BITS, np.int32) for _ in range(4)]
        any_word = False
        for batch in batches:
            any_word = any_word or batch.num_rows > 0
            for i in range(0, batch.num_rows, 4000):
                count_spelling(tables, batch.column(0).slice(i, 4000).to_pylist())
        if any_word:
            yield _pieces(tables)
        del tables
        give_back()

    columns = "t int, piece int, task int, data binary"
    wide, *tables = summed(training.select(text).mapInArrow(gather, columns), sizes, whole=1)
    once_seen = counts.where(F.col("token").isNotNull() & (F.col("c") == 1)).select("token")
    spell = summed(once_seen.mapInArrow(gather_spelling, columns), [1 << SPELL_BITS] * 4)
    return Model(code, wide, tables, spell, totals, once), n, v


def count_bits(code: Code, tables: list[np.ndarray], texts: list[bytes], table_bits: int) -> None:
    tokens = Tokens(code, [code.ids(words(x)) for x in texts], ordered=False)
    tables[0] += np.bincount(tokens.skip * code.symbols + tokens.symbol, minlength=len(tables[0]))
    for a in range(0, len(tokens.symbol), 2 * SLICE):
        _, _, bit, one, two = bits_of(code, tokens, slice(a, a + 2 * SLICE), table_bits)
        for table, slot in ((tables[1], one), (tables[2], two)):
            slot <<= 1
            slot |= bit
            table += np.bincount(slot, minlength=len(table))


def count_spelling(tables: list[np.ndarray], tokens: list[bytes]) -> None:
    data, place = stream(tokens)
    for a in range(0, len(data), 1 << 15):
        slots, bit = spelled(data, place, a, min(a + (1 << 15), len(data)))
        for table, slot in zip(tables, slots, strict=True):
            table += np.bincount(slot * 2 + bit, minlength=len(table))


def score(df: DataFrame, training: DataFrame, held_out: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte); held_out: the boolean column of rows that ``training`` lacks."""
    counts = cut(count_words(training, text))
    model, n, v = fit(training, counts, text=text)
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        code = model.code
        logs = np.log10(code.count + 1.0)
        # of local words in a bucket the share of it is added here
        share = np.zeros(len(code.count))
        below = np.arange(code.coded, code.local)
        share[below] = np.log10(code.count[below]) + model.seen[code.symbol[below] - code.coded]
        any_end = code.count[-1] > 0
        for batch in batches:
            bodies = text_bytes(rows_of(batch, text))
            outside = rows_of(batch, held_out).to_pylist()
            for part in steps(bodies, STEP):
                texts = bodies[part]
                tokens = [words(x) for x in texts]
                ids = [code.ids(t) for t in tokens]
                total = model.score(Tokens(code, ids), len(texts)) + np.array([share[i].sum() for i in ids])
                others = [Counter(t[j] for j in np.flatnonzero((i >= code.local) & (i < code.local + BUCKETS)).tolist()) for t, i in zip(tokens, ids, strict=True)]
                flat = [w for o in others for w in o]
                ends = np.concatenate([[0], np.cumsum([len(o) for o in others])]).astype(np.int32)
                hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in flat], np.uint64).view(np.int64)
                new = [w if h else None for o, h in zip(others, outside[part], strict=True) for w in o]  # a training text has no unseen words
                pairs = pa.StructArray.from_arrays([pa.array(hashes), pa.array([c for o in others for c in o.values()], pa.int64()), pa.array([bucket(w) for w in flat], pa.int32()), pa.array(new, pa.binary())], ["h", "k", "b", "w"])
                known = [len(i) - sum(o.values()) - (not any_end) for i, o in zip(ids, others, strict=True)]
                at = batch.slice(part.start, len(texts))
                yield pa.record_batch([
                    rows_of(at, key), rows_of(at, held_out), pa.array([len(i) for i in ids], pa.int64()), pa.array(known, pa.int64()), pa.array([logs[i].sum() for i in ids]),
                    pa.array(total), pa.array([len(x) for x in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pairs),
                ], names=["id", "held_out", "n_tokens", "known", "base", "score", "size", "others"])
            give_back()

    rows = df.select(key, text, held_out).mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, known long, base double, score double, size long, others array<struct<h:long,k:long,b:int,w:binary>>")
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    shares = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(model.seen, model.unseen, strict=True))], "b int, seen double, unseen double")
    met = rows.select("_row", F.inline("others")).join(counts.where(F.col("token").isNotNull()).select("h", "c"), "h", "left").join(F.broadcast(shares), "b")  # BUCKETS rows
    met = met.groupBy("_row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("k"))).alias("more"),
        F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("plus"),
        F.sum(F.col("k") * F.coalesce(F.log10("c") + F.col("seen"), "unseen")).alias("share"),
        F.sort_array(F.collect_list(F.when(F.col("c").isNull(), F.struct("w", "k")))).alias("unseen"),
    )

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            made = []
            for i in range(0, batch.num_rows, 200):
                made.append(model.novel([[(x["w"] or b"", x["k"]) for x in found] for found in batch.column(4).slice(i, 200).to_pylist()]))
            yield pa.record_batch([*batch.columns[:4], pa.array(np.concatenate([np.zeros(0), *made]))], names=["_row", "more", "plus", "share", "novel"])
            give_back()

    met = met.mapInArrow(spell, "_row long, more long, plus double, share double, novel double")
    out = rows.drop("others").join(met, "_row", "left")
    zero = F.lit(0.0)
    base = F.col("base") + F.coalesce("plus", zero) - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    total = F.col("score") + F.coalesce("share", zero) + F.coalesce("novel", zero)
    return out.select(
        F.col("id").alias(key), "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"), total.alias("score"), (-total / F.lit(_LOG10_2) / F.greatest("size", F.lit(1))).alias("bits_per_byte"),
    )
