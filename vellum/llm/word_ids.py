"""Ids of many texts at once, for tokenizers whose words have ends and which drop white space.

Texts are split at white space, equal words of a batch are encoded once: letters of Latin-1 with signs of the end of a
clause behind them by one run of the merges over all of them, any other word as ``packing`` encodes it. The result is that
of the tokenizer, text for text.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

from . import packing

#: Letters whose lower case is one letter of the same list and which no composition changes; signs that form a piece of their own.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = f"^[{_LETTERS}]+[.,;:!?]*$"


class Encoder:
    def __init__(self, path: str):
        self.words = packing.words(path)
        core = self.words.core
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        # the end of a word is a blank here, which no piece holds
        ranks, self.vocabulary = {b" ": 1 << 30}, core.get_vocab_size()
        self.ends = np.zeros(self.vocabulary, bool)
        for token, n in core.get_vocab(with_added_tokens=False).items():
            body, end = (token[:-4], b" ") if token.endswith("</w>") else (token, b"")
            if all(c in byte_of for c in body):
                ranks[bytes(byte_of[c] for c in body) + end] = n
                self.ends[n] = bool(end)
        self.merge = tiktoken.Encoding("own", pat_str=r"\S+ ", mergeable_ranks=ranks, special_tokens={})

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths): ids of the words one after the other, and how many each has."""
        plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
        lengths = np.zeros(len(words), np.int64)
        split = pc.replace_substring_regex(pc.utf8_lower(words.filter(pa.array(plain))), r"([.,;:!?]+)$", r" \1")
        ids = np.zeros(0, np.uint32)
        if len(split):
            ids = self.merge.encode_to_numpy(" ".join(split.to_pylist()) + " ")
            pieces = 1 + pc.match_substring(split, " ").to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != pieces.sum():
                raise ValueError("a piece of letters must end with one end of a word")
            lengths[plain] = np.diff(ends[np.cumsum(pieces) - 1], prepend=0)
        rest = [self.words[w] if w else b"" for w in words.filter(pa.array(~plain)).to_pylist()]
        lengths[~plain] = [len(x) // 4 for x in rest]
        # the words in their order again: plain ones first, the others behind them
        begin = np.zeros(len(words), np.int64)
        begin[plain] = np.cumsum(lengths[plain]) - lengths[plain]
        begin[~plain] = len(ids) + np.cumsum(lengths[~plain]) - lengths[~plain]
        return gathered(np.concatenate([ids, np.frombuffer(b"".join(rest), "<u4")]), begin, lengths), lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes): the texts' ids one after the other, and how many each has; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if pc.any(pc.match_substring_regex(texts, "[\\x1c-\\x1f]")).as_py():  # white space to the splitter, tokens to the tokenizer
            blobs = [self.words.text(x) for x in texts.to_pylist()]
            return np.frombuffer(b"".join(blobs), "<u4"), np.array([len(b) // 4 for b in blobs], np.int64)
        split = pc.utf8_split_whitespace(texts)
        every = split.flatten()
        # a text that begins or ends with white space has an empty word there
        coded = every.dictionary_encode()
        ids, lengths = self._of_words(coded.dictionary)
        use = coded.indices.to_numpy()
        n = lengths[use]
        bounds = np.concatenate([[0], np.cumsum(n)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return gathered(ids, (np.cumsum(lengths) - lengths)[use], n), np.diff(bounds)


def gathered(values: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """values[begin[0]:begin[0]+n[0]], values[begin[1]:begin[1]+n[1]], and so on."""
    ends = np.cumsum(n)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + n, n)]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
