"""Long repeated byte strings through a run-compressed Burrows-Wheeler transform.

Every string of ``span`` bytes that starts at two or more places of the corpus is to be removed wherever
it stands, whole. Comparing everything with everything is avoided in three steps.

1. Anchors. Of the k-grams inside a window of ``span`` bytes the one with the least hash owns the window.
   The choice hangs on the window's bytes alone, so equal windows have equal owners at equal offsets.
   Successive windows with one owner form a region: the owner's hash, the bytes that its windows cover.
2. Regions are reduced to (owner hash, content hash) with their counts before they are shuffled. A window whose
   owner hash stands once in the corpus is unique. Where all regions of an owner hash are copies of one, all
   their windows repeat.
3. The other owners' distinct regions go, by owner hash, into blocks of bounded size. A block's regions are
   concatenated and their suffixes sorted; the transform is kept as runs, with the suffix array
   sampled at the runs' ends. Matching statistics against the other regions are streamed in text order: the match
   with the neighbour in suffix order is compared byte by byte where a run begins (or ends), and shortens by one
   from each position to the next elsewhere. A window repeats if its statistic reaches ``span`` or its region has copies.
   An owner hash with more distinct regions than a block may hold has its windows grouped by their hashes
   instead, which any number of tasks can share.

Hashes are 64-bit polynomials; two regions count as equal on two independent ones. Null texts count as
empty; rows that repeat are copies of each other, and all copies lose what they share; rows are told apart by key and text, so
keys may be null or repeat; a very long text is cut into regions by one task; other columns are not touched.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, give_back, join_hot, rows_of, text_bytes

SPAN = 200
GRAM = 48
#: Bytes of a block's concatenated regions, and the distinct regions of one owner that a block takes.
BLOCK_BYTES = 2_000_000
BLOCK_REGIONS = 4096
#: Bytes of texts that one step of the anchor scan holds; a longer text is a step of its own.
STEP_BYTES = 2_000_000
#: Odd multipliers of the two polynomials.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_PLACE = np.uint64((1 << 24) - 1)


@functools.lru_cache(8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64."""
    inverse = pow(base, -1, 1 << 64)
    made = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    return made[0], made[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _size(n: int) -> int:
    """Lengths of the tables of powers come in steps, so that few are made."""
    return max(1 << 16, 1 << (n + 1).bit_length())


class Scan:
    """Regions of some concatenated texts."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, span: int, gram: int):
        n = len(data)
        starts = np.concatenate([[0], ends[:-1]])
        self.owner = self.low = self.count = self.key = self.content = np.zeros(0, np.int64)
        windows = n - span + 1
        if windows <= 0:
            return
        up, down = _powers(BASES[0], _size(n))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        grams = _mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
        width, best, have = span - gram + 1, grams & ~_PLACE, 1
        # places modulo 2^24 in the low bits: the first of equal hashes wins; a window is far shorter than that
        best |= np.arange(len(best), dtype=np.uint64) & _PLACE
        wrap = len(best) > int(_PLACE)
        if wrap:  # the comparison must not see the places wrap round: move by whole windows instead
            best = self._by_parts(grams, width)
        else:
            while have * 2 <= width:
                best = np.minimum(best[:-have], best[have:])
                have *= 2
            if have < width:
                best = np.minimum(best[: len(best) - (width - have)], best[width - have :])
            best = (best & _PLACE).astype(np.int64)
        valid = np.zeros(windows, bool)
        marks = np.zeros(windows + 1, np.int32)
        whole = ends - starts >= span
        np.add.at(marks, starts[whole], 1)
        np.add.at(marks, np.minimum(ends[whole] - span + 1, windows), -1)
        valid = np.cumsum(marks[:-1]) > 0
        at = best[:windows]
        first = valid.copy()
        first[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
        first[np.minimum(starts[whole], windows - 1)] = True
        low = np.flatnonzero(first & valid)
        if not len(low):
            return
        stop = np.flatnonzero(valid & np.concatenate([first[1:] | ~valid[1:], [True]]))
        self.low, self.count = low, stop - low + 1
        self.owner = np.searchsorted(ends, low, side="right")
        self.key = grams[at[low]].view(np.int64)
        up, down = _powers(BASES[1], _size(n))
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        # the owner's offset and the length are part of the content
        content = (sums[stop + span] - sums[low]) * down[low]
        self.content = _mixed(content + np.uint64(0xA24BAED4963EE407) * (self.count.astype(np.uint64) << np.uint64(16) | (at[low] - low).astype(np.uint64))).view(np.int64)

    @staticmethod
    def _by_parts(grams: np.ndarray, width: int) -> np.ndarray:
        """Place of the least hash of each window of a text too long for places of 24 bits."""
        out = np.empty(len(grams) - width + 1, np.int64)
        step = 1 << 22
        for a in range(0, len(out), step):
            part = grams[a : a + step + width - 1]
            best, have = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64), 1
            while have * 2 <= width:
                best = np.minimum(best[:-have], best[have:])
                have *= 2
            best = np.minimum(best[: len(best) - (width - have)], best[width - have :]) if have < width else best
            out[a : a + step] = (best & _PLACE).astype(np.int64) + a
        return out


def _steps(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > STEP_BYTES:
            yield at, texts[at:i]
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, texts[at:]


def regions(texts: DataFrame, span: int, gram: int) -> DataFrame:
    """(ah, rh, id, th, p, more, n) from (id, th, text): p is the first place of the region in its text, more the further ones."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_texts = text_bytes(rows_of(batch, "text"))
            for begin, part in _steps(all_texts):
                ends = np.cumsum([len(t) for t in part])
                s = Scan(np.frombuffer(b"".join(part), np.uint8), ends, span, gram)
                if not len(s.low):
                    continue
                order = np.lexsort((s.low, s.content, s.key, s.owner))
                owner, key, content, low, count = (x[order] for x in (s.owner, s.key, s.content, s.low, s.count))
                new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (key[1:] != key[:-1]) | (content[1:] != content[:-1])])
                head = np.flatnonzero(new)
                n = np.diff(np.concatenate([head, [len(owner)]]))
                place = (low - np.concatenate([[0], ends[:-1]])[owner]).astype(np.int32)
                more = [None if k == 1 else place[h + 1 : h + k].tobytes() for h, k in zip(head.tolist(), n.tolist(), strict=True)] if (n > 1).any() else [None] * len(head)
                docs = pa.array(owner[head] + begin)
                yield pa.record_batch([pa.array(key[head]), pa.array(content[head]), rows_of(batch, "id").take(docs), rows_of(batch, "th").take(docs), pa.array(place[head]), pa.array(count[head].astype(np.int32)), pa.array(more, pa.binary()), pa.array(n.astype(np.int32))], names=["ah", "rh", "id", "th", "p", "w", "more", "n"])
            give_back()

    return texts.select("id", "th", "text").mapInArrow(run, f"ah long, rh long, id {kind}, th long, p int, w int, more binary, n int")


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of symbols under 512 in order, by doubling from seven symbols; a suffix that is alone with its rank is not sorted again."""
    n = len(s)
    padded = np.concatenate([s.astype(np.uint64), np.zeros(8, np.uint64)])
    keys = np.zeros(n, np.uint64)
    for i in range(7):
        keys = keys << np.uint64(9) | padded[i : i + n]
    order = np.argsort(keys)
    keys = keys[order]
    #: Places in the order that are still open, and the suffixes there; a rank is the place of its first suffix, from 1 on.
    at, open_ = np.arange(n), order
    rank = np.zeros(2 * n + 8, np.uint64)
    have = 7
    while True:
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        head = np.flatnonzero(new)
        rank[open_] = (np.repeat(at[head], np.diff(np.concatenate([head, [len(at)]]))) + 1).astype(np.uint64)
        more = ~(new & np.concatenate([new[1:], [True]]))
        at, open_ = at[more], open_[more]
        if not len(at) or have >= n:
            return order
        keys = rank[open_] << np.uint64(32) | rank[open_ + have]  # beyond the end the rank is zero
        by = np.argsort(keys)
        keys, open_ = keys[by], open_[by]
        order[at] = open_
        have *= 2


class RunIndex:
    """Run-length compressed transform of concatenated regions, with the suffix array at the runs' ends.

    The places of suffixes inside a run are not kept: they follow from the samples by stepping through the text.
    """

    def __init__(self, symbols: np.ndarray):
        order = suffix_array(symbols)
        before = symbols[order - 1]  # the last symbol stands before the first
        # separators count as distinct symbols: each is a run of its own
        edge = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] == 0)) + 1
        self.symbols = symbols
        self.starts = np.concatenate([[0], edge])
        self.heads = before[self.starts]
        ends = np.concatenate([edge, [len(order)]]) - 1
        #: (place, neighbour before it) at the runs' starts, (place, neighbour after it) at their ends.
        self.first = order[self.starts], np.concatenate([[-1], order[self.starts[1:] - 1]])
        self.last = order[ends], np.concatenate([order[ends[:-1] + 1], [-1]])

    def _common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the common start of the suffixes at a and b, up to ``most``; a separator ends it."""
        n, s = len(self.symbols), np.concatenate([self.symbols, np.zeros(most + 8, self.symbols.dtype)])
        length = np.zeros(len(a), np.int64)
        alive = np.flatnonzero((a >= 0) & (b >= 0) & (a < n) & (b < n))
        for d in range(most):
            x = s[a[alive] + d]
            alive = alive[(x == s[b[alive] + d]) & (x > 0)]
            if not len(alive):
                break
            length[alive] += 1
        return length

    def statistics(self, most: int) -> np.ndarray:
        """For each place the longest match that starts there and elsewhere, up to ``most``; none goes past a separator."""
        n = len(self.symbols)
        out = np.zeros(n, np.int64)
        for places, others in (self.first, self.last):
            length = self._common(places, others, most)
            reach = np.zeros(n, np.int64)
            np.maximum.at(reach, places, length + places)
            known = np.full(n, -1, np.int64)
            known[places] = places
            since = np.maximum.accumulate(known)
            there = np.where(since >= 0, reach[np.maximum(since, 0)], 0)
            out = np.maximum(out, there - np.arange(n))
        return out


def repeats(contents: list[bytes], span: int) -> list[np.ndarray]:
    """For each of some distinct regions, which of its windows stand elsewhere among them."""
    lengths = np.array([len(c) for c in contents])
    symbols = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8).astype(np.uint16) + 1
    ends = np.cumsum(lengths + 1) - 1
    symbols[ends] = 0
    found = RunIndex(symbols).statistics(int(lengths.max())) >= span
    return [found[e - n : e - span + 1] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]


def _intervals(mask: np.ndarray, at: int = 0) -> bytes:
    """(first, last) window of each run of a mask, as 32-bit numbers."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    pairs = edge.reshape(-1, 2) + at
    pairs[:, 1] -= 1
    return pairs.astype("<i4").tobytes()


def _index(span: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("ah", "ascending")])
        ah, content = group["ah"].to_numpy(), group["content"].to_pylist()
        made: list[bytes] = []
        at = 0
        while at < len(content):  # blocks of whole owners
            end, held = at, 0
            while end < len(content):
                stop = int(np.searchsorted(ah, ah[end], side="right"))
                held += sum(len(c) for c in content[end:stop])
                if end > at and held > BLOCK_BYTES:
                    break
                end = stop
            made += [_intervals(m) for m in repeats(content[at:end], span)]
            at = end
        return pa.table([group["ah"], group["rh"], pa.array(made, pa.binary())], names=["ah", "rh", "found"])

    return run


def _windows(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, c in enumerate(rows_of(batch, "content").to_pylist()):
                data = np.frombuffer(c, np.uint8).astype(np.uint64) + np.uint64(1)
                n = len(data) - span + 1
                hashes = []
                for base in BASES:
                    up, down = _powers(base, _size(len(data)))
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(data * up[: len(data)], dtype=np.uint64)])
                    hashes.append(pa.array(((sums[span:] - sums[:-span]) * down[:n]).view(np.int64)))
                same = lambda name: rows_of(batch, name).take(pa.array(np.full(n, i)))  # noqa: E731, B023
                yield pa.record_batch([same("ah"), same("rh"), pa.array(np.arange(n, dtype=np.int32)), *hashes], names=["ah", "rh", "o", "u", "v"])

    return run


def _same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def repeated_windows(texts: DataFrame, *, span: int, gram: int, block_regions: int = BLOCK_REGIONS) -> DataFrame:
    """(id, th, marks) of the texts with repeated windows; marks: (first, last) window of each run, as 32-bit numbers."""
    found = cut(regions(texts, span, gram))
    owners = found.groupBy("ah").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_rows"), F.min("rh").alias("_lo"), F.max("rh").alias("_hi")).where("_n > 1").select("ah", "_rows", (F.col("_lo") != F.col("_hi")).alias("mixed"))
    shared = cut(join_hot(found, cut(owners), "ah", "_rows"))
    mixed = shared.where("mixed")
    distinct = mixed.groupBy("ah", "rh").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"), F.min(F.struct("id", "th", "p", "w")).alias("at"))
    distinct = cut(distinct)
    counts = distinct.groupBy("ah").agg(F.count(F.lit(1)).alias("_kinds")).withColumn("_rows", F.col("_kinds"))
    distinct = join_hot(distinct, cut(counts), "ah", "_rows").select("ah", "rh", "n", "m", "at.*", (F.col("_kinds") > block_regions).alias("crowded"))
    cut_out = distinct.alias("d").join(texts.alias("t"), _same_row("d", "t")).select("ah", "rh", "n", "m", "crowded", F.expr(f"substring(cast(text as binary), p + 1, w + {span - 1})").alias("content"))
    cut_out = cut(cut_out.dropDuplicates(["ah", "rh"]))
    blocks = max(8, -(-found.count() // 200_000))
    indexed = cut_out.where("not crowded").select("ah", "rh", "content", F.pmod(F.xxhash64("ah"), F.lit(blocks)).alias("b")).groupBy("b").applyInArrow(_index(span), "ah long, rh long, found binary")
    windows = cut_out.where("crowded").select("ah", "rh", "content").mapInArrow(_windows(span), "ah long, rh long, o int, u long, v long")
    repeated = windows.groupBy("u", "v").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    crowded = windows.join(repeated, ["u", "v"]).groupBy("ah", "rh").agg(F.array_sort(F.collect_list("o")).alias("o"))
    crowded = crowded.mapInArrow(_packed, "ah long, rh long, found binary")
    verdicts = cut_out.select("ah", "rh", "m", (F.col("n") > 1).alias("whole")).join(indexed.unionByName(crowded), ["ah", "rh"], "left")
    verdicts = cut(verdicts.where(F.col("whole") | (F.octet_length("found") > 0)))
    none = F.lit(None).cast("binary")
    placed = shared.where("not mixed").select("id", "th", "p", "w", "more", none.alias("found")).unionByName(
        join_hot(mixed, verdicts, ["ah", "rh"], "m").select("id", "th", "p", "w", "more", F.when(F.col("whole"), none).otherwise(F.col("found")).alias("found"))
    )
    return placed.groupBy("id", "th").agg(F.collect_list(F.struct("p", "w", "more", "found")).alias("marks"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for o in batch.column(2).to_pylist():
            mask = np.zeros(max(o) + 1, bool)
            mask[o] = True
            made.append(_intervals(mask))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["ah", "rh", "found"])


def covered(size: int, marks: list[dict] | None, span: int) -> np.ndarray:
    """(start, end) of each maximal run of bytes that marked windows cover."""
    edges = np.zeros(size + 1, np.int32)
    for m in marks or ():
        places = [m["p"], *(np.frombuffer(m["more"], "<i4").tolist() if m["more"] else ())]
        inner = np.array([[0, m["w"] - 1]]) if m["found"] is None else np.frombuffer(m["found"], "<i4").reshape(-1, 2)
        for p in places:
            np.add.at(edges, inner[:, 0] + p, 1)
            np.add.at(edges, inner[:, 1] + p + span, -1)
    inside = np.cumsum(edges[:-1]) > 0
    return np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))).reshape(-1, 2)


def dedup(df: DataFrame, *, key: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, carry: list[str] | None = None, decoded: str | None = None, **options: int) -> DataFrame:
    """(key, n_bytes, spans, kept) of each row, and the columns to ``carry``; spans: removed runs of bytes, kept: the remaining bytes.

    decoded: a name under which the remaining bytes come as text instead, without what is left of characters cut in two.
    """
    carried = carry or []
    body = F.coalesce(F.col(text), F.lit(""))
    texts = df.select(F.col(key).alias("id"), body.alias("text"), F.xxhash64(body).alias("th"))
    marks = repeated_windows(texts, span=span, gram=gram, **options)
    whole = df.select(F.col(key).alias("id"), body.alias("text"), F.xxhash64(body).alias("th"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carried)))
    joined = whole.alias("t").join(marks.alias("m"), _same_row("t", "m"), "left").select(F.col("t.id").alias("id"), "text", "marks", *(f"_c{i}" for i in range(len(carried))))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                sizes, spans, kept = [], [], []
                for data, m in zip(text_bytes(rows_of(part, "text")), rows_of(part, "marks").to_pylist(), strict=True):
                    runs = covered(len(data), m, span) if m else np.zeros((0, 2), np.int64)
                    edges = [0, *runs.ravel().tolist(), len(data)]
                    sizes.append(len(data))
                    spans.append([{"start": a, "end": b} for a, b in runs.tolist()])
                    kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if len(runs) else data)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if decoded else pa.array(kept, pa.binary()), *part.columns[3:]], ["id", "n_bytes", "spans", "kept", *part.schema.names[3:]])
            give_back()

    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    made = [T.StructField("n_bytes", T.LongType()), T.StructField("spans", spans), T.StructField("kept", T.StringType() if decoded else T.BinaryType())]
    out = joined.mapInArrow(run, T.StructType([T.StructField("id", df.schema[key].dataType), *made, *(T.StructField(f"_c{i}", df.schema[c].dataType) for i, c in enumerate(carried))]))
    return out.select(F.col("id").alias(key), "n_bytes", "spans", F.col("kept").alias(decoded or "kept"), *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carried)))
