"""Token ids in compressed files: a Re-Pair grammar for each shard, decodable from any place.

The documents are ordered by key over the whole cluster, each partition encodes its texts and closes a shard after about
``SHARD`` ids, at the end of a document. In a shard, pairs of neighbouring symbols that occur often are replaced by
nonterminals, again and again, until that no longer pays. A pair with the end id is never replaced, so every document
begins at a symbol. Each shard is one row of a Parquet file, self-contained:

    magic "RPG1", bytes a symbol (2 or 4), 3 bytes of padding, then unsigned 32-bit: first nonterminal, rules, documents,
    stride; unsigned 64-bit: symbols, ids; then the arrays: left and right symbol of each rule, number of ids that each rule
    stands for (32 bits each), symbols, the ids before every stride-th symbol (64 bits), ids of each document (64 bits)

All numbers are little-endian. A rule refers to symbols before it only. ``before`` is the number of ids of earlier shards
of the partition; those of earlier partitions follow from one sum a partition, of which there are no more than shuffle
partitions. Spark's own writer commits the files, so a lost executor costs its tasks again and nothing else.

Null and empty texts are documents of the end id alone. Rows that repeat are written each; a null key comes first; rows of
one key stand in the order of their texts' hashes, equal rows in any order, which nothing shows. The end id inside a
text stays an id of the text: documents are told apart by their lengths. A very long text makes a shard as long as itself.
Empty tables make no shards and read back as no rows. Other columns are not touched, whatever their names.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import word_ids
from .common import give_back

#: Ids after which a shard is closed.
SHARD = 1 << 21
#: A pair becomes a rule if it stands at so many places of a shard at least.
LEAST = 12
#: Replacing ends when a round takes less than this share of the symbols away.
PAYS = 0.01
#: Symbols between two of the places of which the number of ids before is stored.
STRIDE = 1 << 10

_HEAD = struct.Struct("<4sB3xIIIIQQ")


def _frequent(s: np.ndarray, end: int, most: int, least: int) -> np.ndarray:
    """Keys of the pairs that occur ``least`` times or more, most frequent first (ties: least key), ``most`` at most."""
    width = s.dtype.itemsize * 8
    wide = np.uint32 if width == 16 else np.uint64
    keys = (s[:-1].astype(wide) << wide(width)) | s[1:]
    keys.sort()
    cuts = np.flatnonzero(keys[1:] != keys[:-1])
    ends = np.append(cuts, len(keys) - 1)
    counts = np.diff(ends, prepend=-1)
    often = np.flatnonzero(counts >= least)
    found, counts = keys[ends[often]], counts[often]
    low = wide((1 << width) - 1)
    whole = (found >> wide(width) != end) & (found & low != end)
    found, counts = found[whole], counts[whole]
    return found[np.argsort(-counts, kind="stable")][:most]


def _places(s: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, rank) of occurrences of the pairs that do not overlap, ascending; of two that would, the pair of lower rank.

    Ranks are found by a table over hashed pairs; where two pairs share a slot, the more frequent has it this round.
    """
    wide = keys.dtype.type
    width = s.dtype.itemsize * 8
    bits = 20
    mix, shift = (wide(0x9E3779B1), wide(32 - bits)) if width == 16 else (wide(0x9E3779B97F4A7C15), wide(64 - bits))
    slots = np.full(1 << bits, -1, np.int32)
    slots[(keys[::-1] * mix) >> shift] = np.arange(len(keys) - 1, -1, -1, dtype=np.int32)
    pairs = (s[:-1].astype(wide) << wide(width)) | s[1:]
    rank = slots[(pairs * mix) >> shift]
    at = np.flatnonzero(rank >= 0)
    rank = rank[at]
    at, rank = (x[keys[rank] == pairs[at]] for x in (at, rank))
    if not len(at):
        return at, rank
    # neighbours differ in the last bit of their places, so one of two that overlap always comes before the other
    turn = rank.astype(np.int64) * 2 + (at & 1)
    close = at[1:] - at[:-1] == 1
    first = np.ones(len(at), bool)
    first[1:] &= ~(close & (turn[1:] > turn[:-1]))
    first[:-1] &= ~(close & (turn[:-1] > turn[1:]))
    return at[first], rank[first]


def compress(ids: np.ndarray, end: int, vocabulary: int, least: int = LEAST, pays: float = PAYS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, lengths): rules as rows (left, right), nonterminal i is vocabulary + i and stands for lengths[i] ids.

    Each round counts all pairs of neighbours, gives the frequent ones nonterminals and replaces their occurrences.
    """
    narrow = vocabulary + 4096 <= 1 << 16
    s = ids.astype(np.uint16 if narrow else np.uint32)
    room = (1 << (16 if narrow else 31)) - vocabulary
    rules: list[np.ndarray] = []
    made = 0
    lengths = np.ones(0, np.uint32)
    span = lambda x: np.where(x < vocabulary, 1, lengths[np.maximum(x.astype(np.int64) - vocabulary, 0)] if made else 1)
    while len(s) > 1 and made < room:
        keys = _frequent(s, end, min(room - made, 4096), least)
        if not len(keys):
            break
        at, rank = _places(s, keys)
        uses = np.bincount(rank, minlength=len(keys))
        kept = np.flatnonzero(uses >= least)
        if not len(kept):
            break
        new = np.full(len(keys), -1, np.int64)
        new[kept] = vocabulary + made + np.arange(len(kept))
        at, name = (x[new[rank] >= 0] for x in (at, new[rank]))
        width = s.dtype.itemsize * 8
        pair = np.stack([keys[kept] >> keys.dtype.type(width), keys[kept] & keys.dtype.type((1 << width) - 1)], axis=1).astype(np.uint32)
        lengths = np.concatenate([lengths, (span(pair[:, 0]) + span(pair[:, 1])).astype(np.uint32)])
        rules.append(pair)
        made += len(kept)
        stays = np.ones(len(s), bool)
        stays[at + 1] = False
        s[at] = name
        before = len(s)
        s = s[stays]
        if before - len(s) < pays * before:
            break
    return s, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), lengths


def pack_shard(ids: np.ndarray, sizes: Sequence[int], end: int, vocabulary: int, *, least: int = LEAST, pays: float = PAYS, stride: int = STRIDE) -> bytes:
    """The bytes of a shard of documents with ``sizes`` ids each."""
    symbols, rules, lengths = compress(ids, end, vocabulary, least, pays)
    spans = _spans(symbols, vocabulary, lengths)
    before = np.concatenate([[0], np.cumsum(spans)])[:-1][::stride] if len(symbols) else np.zeros(0)
    head = _HEAD.pack(b"RPG1", symbols.dtype.itemsize, vocabulary, len(rules), len(sizes), stride, len(symbols), len(ids))
    parts = (rules[:, 0].astype("<u4"), rules[:, 1].astype("<u4"), lengths.astype("<u4"), symbols.astype(symbols.dtype.newbyteorder("<")), before.astype("<u8"), np.array(sizes, "<u8"))
    return head + b"".join(p.tobytes() for p in parts)


def _spans(symbols: np.ndarray, vocabulary: int, lengths: np.ndarray) -> np.ndarray:
    """How many ids each symbol stands for."""
    spans = np.ones(len(symbols), np.int64)
    made = np.flatnonzero(symbols >= vocabulary)
    spans[made] = lengths[symbols[made].astype(np.int64) - vocabulary]
    return spans


class Shard:
    """A shard's arrays over its bytes, which are not copied."""

    def __init__(self, body: bytes):
        magic, width, self.vocabulary, n_rules, n_docs, self.stride, n_symbols, self.n_ids = _HEAD.unpack_from(body)
        if magic != b"RPG1":
            raise ValueError("not a shard of this format")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(body, kind, n, at)
            at += found.nbytes
            return found

        self.left, self.right, self.lengths = take("<u4", n_rules), take("<u4", n_rules), take("<u4", n_rules)
        self.symbols = take(f"<u{width}", n_symbols)
        self.before = take("<u8", -(-n_symbols // self.stride))
        self.sizes = take("<u8", n_docs)

    @functools.cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of all rules, one after the other, and where each rule's begin.

        Rules whose parts are written are written together, so there are as many steps as rules nest.
        """
        first = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])
        out = np.zeros(int(first[-1]), np.uint32)
        depth = np.zeros(len(self.lengths), np.int32)
        for i, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist())):
            depth[i] = 1 + max((depth[x - self.vocabulary] for x in (a, b) if x >= self.vocabulary), default=0)
        for d in range(1, int(depth.max(initial=0)) + 1):
            now = np.flatnonzero(depth == d)
            for part, shift in ((self.left[now], 0), (self.right[now], None)):
                place = first[now] if shift == 0 else first[now] + _spans(self.left[now], self.vocabulary, self.lengths)
                plain = part < self.vocabulary
                out[place[plain]] = part[plain]
                inner = part[~plain].astype(np.int64) - self.vocabulary
                target, n = place[~plain], self.lengths[inner].astype(np.int64)
                step = _ramp(n)
                out[np.repeat(target, n) + step] = out[np.repeat(first[inner], n) + step]
        return out, first

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that the symbols stand for."""
        words, first = self.words
        spans = _spans(symbols, self.vocabulary, self.lengths)
        ends = np.cumsum(spans)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
        begin = ends - spans
        plain = symbols < self.vocabulary
        out[begin[plain]] = symbols[plain]
        rule, n = symbols[~plain].astype(np.int64) - self.vocabulary, spans[~plain]
        step = _ramp(n)
        out[np.repeat(begin[~plain], n) + step] = words[np.repeat(first[rule], n) + step]
        return out

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from start to stop, from the symbols around them alone."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.before, start, "right")) - 1
        b = int(np.searchsorted(self.before, stop, "left"))
        skipped = start - int(self.before[a])
        return self.expand(self.symbols[a * self.stride : b * self.stride])[skipped : skipped + stop - start]


def _ramp(n: np.ndarray) -> np.ndarray:
    """0, 1, .. n[0]-1, 0, 1, .. n[1]-1, and so on."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n)


def write(df: DataFrame, at: str, path: str, *, end_id: int, key: str = "doc_id", text: str = "text", shard: int = SHARD, least: int = LEAST) -> None:
    """Encode the texts with the tokenizer at ``path``, append ``end_id`` to each, and write shards to the folder ``at``."""
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("_h", F.xxhash64("text"))
    # equal rows are dealt by their place in the scan, so that a row that repeats very often has many partitions
    docs = docs.withColumn("_m", F.monotonically_increasing_id())
    docs = docs.repartitionByRange("key", "_h", "_m").sortWithinPartitions("key", "_h", "_m").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids.encoder(path)
        part = TaskContext.get().partitionId()
        keys: list[pa.Array] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        number = before = held = 0

        def close() -> pa.RecordBatch:
            nonlocal number, before, held
            n = np.concatenate(sizes)
            body = pack_shard(np.concatenate(ids), n, end_id, known.vocabulary, least=least)
            names = pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.concat_arrays(keys))
            row = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), names, pa.array([body], pa.binary())]
            number, before, held = number + 1, before + held, 0
            for x in (keys, ids, sizes):
                x.clear()
            return pa.record_batch(row, names=["part", "number", "before", "n_ids", "keys", "body"])

        for batch in batches:
            for rows in _slices(batch):
                found, n = with_end(*known.encode(rows.column(1)), end_id)
                ends = np.concatenate([[0], np.cumsum(n)])
                at = 0
                while at < len(n):
                    # up to the document that fills the shard, or all that are left
                    stop = min(int(np.searchsorted(ends, ends[at] + shard - held)), len(n))
                    keys.append(rows.column(0).slice(at, stop - at))
                    ids.append(found[ends[at] : ends[stop]])
                    sizes.append(n[at:stop])
                    held += int(ends[stop] - ends[at])
                    at = stop
                    if held >= shard:
                        yield close()
        if held:
            yield close()
        known.words.forget()
        give_back()

    docs.mapInArrow(run, f"part int, number int, before long, n_ids long, keys array<{kind}>, body binary").write.parquet(at)


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the end id after each document's, and the sizes with it."""
    out = np.empty(len(ids) + len(sizes), np.uint32)
    ends = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[ends], out[inside] = end_id, ids
    return out, sizes + 1


def _slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Successive rows with texts of about ``most`` bytes together; a longer text is alone."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def shards(spark: SparkSession, at: str) -> DataFrame:
    """(start, n_ids, keys, body) of each shard in the folder; start: ids of all shards before it.

    Only the sums of the partitions go through the driver, no more rows than the writer had shuffle partitions.
    """
    found = spark.read.parquet(at)
    starts, total = [], 0
    for part, n in sorted(tuple(r) for r in found.groupBy("part").agg(F.sum("n_ids")).collect()):
        starts.append((part, total))
        total += n
    parts = spark.createDataFrame(starts, "part int, _start long")
    return found.join(F.broadcast(parts), "part").select((F.col("_start") + F.col("before")).alias("start"), "n_ids", "keys", "body")


def read(spark: SparkSession, at: str, *, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids) of each document in the folder; ids are unsigned, little-endian and of 32 bits."""
    found = shards(spark, at)
    kind = found.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.column(2)[i].as_buffer())
                sizes = shard.sizes.astype(np.int64)
                ids = shard.ids().astype("<u4")
                ends = np.concatenate([[0], np.cumsum(sizes)])
                keys = batch.column(1).slice(i, 1).flatten()
                starts = ends[:-1] + batch.column(0)[i].as_py()
                for a, b in _blocks(sizes):
                    places = (ends[a : b + 1] - ends[a]) * 4
                    blob = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(ids[ends[a] : ends[b]].tobytes())])
                    yield pa.record_batch([keys.slice(a, b - a), pa.array(starts[a:b]), pa.array(sizes[a:b]), blob], names=[key, "start", "n_tokens", "ids"])

    return found.select("start", "keys", "body").mapInArrow(run, f"{key} {kind}, start long, n_tokens long, ids binary")


def _blocks(sizes: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Successive documents of about ``most`` ids together; a longer one alone."""
    a, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > a and held + n > most:
            yield a, i
            a, held = i, 0
        held += n
    if a < len(sizes):
        yield a, len(sizes)


def cut_out(spark: SparkSession, at: str, ranges: DataFrame) -> DataFrame:
    """The asked columns of ``ranges`` (begin, end: ids counted over the whole folder) with the ``ids`` that stand there.

    For each shard only the symbols around a range are decoded. A range that runs over several shards has a row for each,
    told by ``first``, the place of its first id; one that touches no id has none. Ranges meet shards by the
    stretches of ``SHARD`` ids that both touch.
    """
    found = shards(spark, at).drop("keys")
    stretch = lambda a, b: F.explode(F.sequence(F.floor(a / SHARD), F.floor((b - 1) / SHARD)))
    left = found.withColumn("_s", stretch(F.col("start"), F.col("start") + F.col("n_ids")))
    right = ranges.where("end > begin and begin >= 0").withColumn("_s", stretch(F.col("begin"), F.col("end")))
    met = left.join(right, "_s").where("begin < start + n_ids and end > start")
    once = met.where(F.col("_s") == F.floor(F.greatest("start", "begin") / SHARD))

    @F.pandas_udf("binary")
    def piece(body, a, b):
        return body.combine(a, lambda x, y: (x, y)).combine(b, lambda x, y: Shard(x[0]).ids(x[1], y).astype("<u4").tobytes())

    first = F.greatest("start", "begin")
    last = F.least(F.col("start") + F.col("n_ids"), "end")
    return once.select(*ranges.columns, first.alias("first"), piece("body", first - F.col("start"), last - F.col("start")).alias("ids"))
