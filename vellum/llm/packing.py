"""Packing by power-of-two decomposition.

A document of n tokens (its ids, then the end id) is cut, from its start, into as many pieces of the
sequence length as fit and one piece for each binary digit of the rest, longest first. Every piece is
a sequence of its own whose length is a power of two, so equal lengths batch without padding and no
sequence holds tokens of two documents.

Null and empty texts become a document of the end id alone; rows that repeat, or share or lack a key, are packed each;
a very long text is encoded whole in one task; nothing is ordered, so there are no ties; other columns are not touched. The sequence length must be a power of two.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import give_back

#: Words held in memory for reuse; beyond that the table is emptied, which no result depends on.
KEPT = 400_000
KEPT_CHARS = 64
#: Separators of str.split() that are not Unicode white space, so that they are tokens to the tokenizer.
_INFO_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"[^\S\x1c-\x1f]+")


#: Code points below this are split and composed here; a run with any other goes to the tokenizer as it is.
PLAIN = "\u0250"
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: A byte that UTF-8 never has stands for the end of a word.
_END = b"\xff"


class Pieces(dict):
    """Ids of a lower-case piece, from the tokenizer's own merges run by a faster merger.

    The end of a word is a byte of its own here; the symbols "byte with end" have the lowest ranks of all
    merges in the vocabulary, so they are formed first, as the tokenizer begins with them.
    """

    def __init__(self, core: Tokenizer):
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {_END: 1 << 30}
        for token, n in core.get_vocab(with_added_tokens=False).items():
            body, end = (token[:-4], _END) if token.endswith("</w>") else (token, b"")
            if all(c in byte_of for c in body):
                ranks[bytes(byte_of[c] for c in body) + end] = n
        self.merge = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.merge(piece.encode() + _END), "<u4").tobytes()
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = ids
        return ids


class Words(dict):
    """Ids of a run of text without white space, as little-endian 32-bit bytes.

    The tokenizer drops white space and every step before that (composition, case, splitting) works
    within such a run, so the ids of a text are those of its runs one after another.
    """

    def __init__(self, path: str):
        self.core = Tokenizer.from_file(path)
        self.pieces = Pieces(self.core)

    def __missing__(self, word: str) -> bytes:
        if max(word) < PLAIN and "<|" not in word:
            plain = word if word.isascii() else unicodedata.normalize("NFC", word)
            ids = b"".join(map(self.pieces.__getitem__, _PIECE.findall(plain.lower())))
        else:
            ids = np.array(self.core.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[word] = ids
        return ids

    def forget(self) -> None:
        """Drop what is held for reuse: a worker lives on between tasks, whether or not these need it."""
        self.clear()
        self.pieces.clear()

    def text(self, text: str | None) -> bytes:
        runs = [] if not text else [x for x in _SPACE.split(text) if x] if _INFO_SEPARATORS.search(text) else text.split()
        return b"".join(map(self.__getitem__, runs))


@functools.cache
def words(path: str) -> Words:
    return Words(path)


@functools.lru_cache(4096)
def piece_lengths(n: int, longest: int) -> tuple[int, ...]:
    """Lengths of the pieces of a document of n tokens, in order."""
    whole, rest = divmod(n, longest)
    return (longest,) * whole + tuple(1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1)


def pack(df: DataFrame, path: str, *, end_id: int, longest: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, ids, doc_tokens, bucket) of each piece; ids are unsigned, little-endian and of 32 bits, bucket is
    the length of the piece's sequence, which it fills."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the sequence length must be a power of two")
    kind = df.schema[key].dataType.simpleString()
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words(path)
        for batch in batches:
            for part in (batch.slice(i, 250) for i in range(0, batch.num_rows, 250)):
                blobs = [known.text(x) + tail for x in part.column(1).to_pylist()]
                cuts = [piece_lengths(len(b) // 4, longest) for b in blobs]
                counts = np.array([len(c) for c in cuts])
                lengths = np.array([n for c in cuts for n in c], np.int32)
                ends = np.zeros(len(lengths) + 1, np.int32)
                np.cumsum(lengths, out=ends[1:])
                first = np.repeat(ends[:-1][np.cumsum(counts) - counts], counts)
                ids = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends * np.int32(4)), pa.py_buffer(b"".join(blobs))])
                owner = np.repeat(np.arange(len(blobs)), counts)
                tokens = np.array([len(b) // 4 for b in blobs])[owner]
                yield pa.record_batch([part.column(0).take(pa.array(owner)), pa.array((ends[:-1] - first).astype(np.int64)), ids, pa.array(tokens), pa.array(lengths)], names=[key, "start", "ids", "doc_tokens", "bucket"])
        known.forget()
        give_back()

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, start long, ids binary, doc_tokens long, bucket int")


def with_sequences(pieces: DataFrame) -> DataFrame:
    """Adds sequence_id and offset: a sequence for each piece, numbered by input partition and row."""
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
