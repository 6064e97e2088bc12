"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into overlapping chunks. Each chunk is pre-tokenised by itself, in parallel with the
others. The pattern only looks ahead, so two chunks that both begin a pre-token at one place agree on
all that follows: the chunks are stitched at the first such place of their overlap. Where a run without
any common boundary fills the overlap, pre-tokenising goes on from the last settled boundary until the
next chunk's boundaries are met. The stitched pieces are then encoded, each by itself. Decoding
concatenates the raw bytes of the ids.

The pattern's classes are those of the tokenizer library, asked of it once a worker. Every text goes this way; one of a single
chunk has nothing to stitch. A very long text is pre-tokenised by many tasks; its stitched pieces are encoded in one. Ties cannot occur. Null texts count as empty, empty texts have no ids, rows that repeat are kept, columns other than those
asked for are not touched.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, rows_of

#: Pieces held in memory for reuse; beyond that the table is emptied, which no result depends on.
KEPT = 400_000
KEPT_CHARS = 64


@functools.cache
def matched(source: str) -> str:
    """All code points that the tokenizer library's own pattern engine matches with ``source``, as ranges of a class."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    probe = tiktoken.Encoding("probe", pat_str=source, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    found = np.frombuffer(bytes(probe.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4").astype(np.int64)
    edge = np.flatnonzero(np.diff(found) != 1)
    first, last = found[np.concatenate([[0], edge + 1])], found[np.concatenate([edge, [len(found) - 1]])]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first.tolist(), last.tolist(), strict=True))


#: Code points below this have a pattern of their own, whose classes are short.
LATIN = 0x250
_BEYOND = re.compile(f"[^\0-{chr(LATIN - 1)}]")


@functools.cache
def pattern(source: str, latin: bool = False) -> regex.Pattern | re.Pattern:
    """The pre-token pattern with its classes spelt out as the library has them: editions of Unicode differ in letters and numbers.

    latin: for texts below ``LATIN`` only, where the classes end there too.
    """
    classes = {k: matched(k) for k in (r"\p{L}", r"\p{N}", r"\s")}
    if latin:
        classes = {k: "".join(re.escape(c) for c in map(chr, range(LATIN)) if regex.match(f"[{v}]", c)) for k, v in classes.items()}
    out, inside, i = [], False, 0
    while i < len(source):
        token = next((k for k in (*classes, r"\S") if source.startswith(k, i)), source[i : i + 2] if source[i] == "\\" else source[i])
        inside = (inside or token == "[") and token != "]"
        if token in classes:
            out.append(classes[token] if inside else f"[{classes[token]}]")
        else:
            out.append(f"[^{classes[chr(92) + 's']}]" if token == r"\S" else token)
        i += len(token)
    return (re if latin else regex).compile("".join(out))


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Pieces(dict):
    """Piece of text to its ids, as little-endian 32-bit bytes."""

    def __init__(self, path: str, source: str):
        self.core = tiktoken.Encoding("own", pat_str=source, mergeable_ranks=ranks(path), special_tokens={})

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.core._encode_single_piece(piece), dtype="<u4").tobytes()
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = ids
        return ids


@functools.cache
def pieces(path: str, source: str) -> Pieces:
    return Pieces(path, source)


def chunks(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(start, text) of each chunk; each reaches ``overlap`` characters into the next."""
    return [(at, text[at : at + size + overlap]) for at in range(0, max(len(text), 1), size)]


def boundaries(source: str, chunk: str) -> np.ndarray:
    """Starts of the pre-tokens of a chunk, and its length at the end."""
    return np.fromiter((m.start() for m in pattern(source, not _BEYOND.search(chunk)).finditer(chunk)), np.int64, -1) if chunk else np.zeros(0, np.int64)


def stitch(source: str, text: str, parts: list[tuple[int, np.ndarray]], size: int, overlap: int) -> np.ndarray:
    """Starts of the pre-tokens of the whole text from those of its chunks.

    A pre-token that ends where its chunk ends might go on, and so might white space before it, whose
    extent hangs on the character after: the chunk's last two boundaries are not trusted unless it is the last.
    """
    settled = parts[0][1]
    end = min(size + overlap, len(text))
    for at, own in parts[1:]:
        own = own + at
        safe = settled[:-2] if end < len(text) else settled
        common = safe[np.isin(safe, own)] if len(safe) else safe
        if len(common := common[common >= at]):
            meet = common[0]
            settled = np.concatenate([settled[: np.searchsorted(settled, meet)], own[np.searchsorted(own, meet) :]])
        elif end < len(text):  # no place in common: go on from the last settled boundary
            known, on, more = set(own.tolist()), int(safe[-1]) if len(safe) else 0, []
            for m in pattern(source).finditer(text, on):
                if m.start() >= at and m.start() in known:
                    own = own[np.searchsorted(own, m.start()) :]
                    break
                more.append(m.start())
            else:
                own = own[:0]
            settled = np.concatenate([safe[:-1] if len(safe) else safe, np.array(more, np.int64), own])
        end = min(at + size + overlap, len(text))
    return settled


def _list_array(blobs: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(blobs) + 1, np.int32)
    np.cumsum([len(b) // 4 for b in blobs], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(blobs))]))


def encode(df: DataFrame, path: str, source: str, *, key: str = "doc_id", text: str = "text", chunk_chars: int = 1 << 11, overlap: int = 1 << 8, spread_chars: int = 1 << 16) -> DataFrame:
    """(key, ids) of each row. Texts of over ``spread_chars`` characters have their chunks dealt over the cluster, others are cut and stitched in one task."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    is_long = F.length("_text") > spread_chars

    def stitched(whole: str, parts: list[tuple[int, np.ndarray]]) -> bytes:
        known = pieces(path, source)
        starts = stitch(source, whole, parts, chunk_chars, overlap).tolist()
        return b"".join([known[whole[a:b]] for a, b in zip(starts, [*starts[1:], len(whole)], strict=True)]) if whole else b""

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                blobs = [stitched(x, [(a, boundaries(source, c)) for a, c in chunks(x, chunk_chars, overlap)]) for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), _list_array(blobs)], names=[key, "ids"])
        pieces(path, source).clear()
        give_back()

    def pre_tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                starts = boundaries(source, rows_of(one, "chunk")[0].as_py()).tolist()
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([starts], pa.list_(pa.int64()))], [*one.schema.names, "starts"])

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by("n")
        at = [n * chunk_chars for n in group["n"].to_pylist()]
        whole = "".join(c[:chunk_chars] for c in group["chunk"].to_pylist())
        parts = [(a, np.array(s, np.int64)) for a, s in zip(at, group["starts"].to_pylist(), strict=True)]
        return pa.table([group[key].slice(0, 1), _list_array([stitched(whole, parts)])], names=[key, "ids"])

    cut_up = (
        rows.where(is_long)
        .withColumn("_row", F.monotonically_increasing_id())
        .select(key, "_row", F.posexplode(F.expr(f"transform(sequence(0, length(_text) - 1, {chunk_chars}), a -> substring(_text, a + 1, {chunk_chars + overlap}))")).alias("n", "chunk"))
        .repartition("_row", "n")
    )
    joined = cut_up.mapInArrow(pre_tokenise, f"{key} {kind}, _row long, n int, chunk string, starts array<bigint>").groupBy("_row").applyInArrow(join, f"{key} {kind}, ids array<int>")
    return rows.where(~is_long).mapInArrow(here, f"{key} {kind}, ids array<int>").unionByName(joined)


def decode(df: DataFrame, path: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that its ids stand for."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path)
        by_id: list[bytes] = [b""] * (max(table.values(), default=-1) + 1)
        for raw, n in table.items():
            by_id[n] = raw
        words = pa.array(by_id, pa.binary())
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                lists = rows_of(part, ids)
                flat = words.take(lists.flatten())
                lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                at = np.frombuffer(flat.buffers()[1], np.int32)[ends] if len(flat) else np.zeros(len(ends), np.int32)
                data = flat.buffers()[2] if len(flat) else pa.py_buffer(b"")
                made = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(np.ascontiguousarray(at, np.int32)), data])
                yield pa.RecordBatch.from_arrays([*part.columns, made], schema.names)

    return df.mapInArrow(run, schema)
