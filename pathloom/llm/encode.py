"""Whole-corpus encoding with a public tokenizer, by forced boundaries.

Two neighbouring bytes that occur inside no token of the vocabulary can never be merged over, so
a cut between them is certain. A batch of texts is one buffer of bytes; a table over all byte
pairs marks its cuts in one gather, the fragments are an Arrow array over the same buffer, each
distinct fragment is encoded once, and the ids of every text are gathered from those.

A cut must also leave the tokenizer's own splitting of the text as it is. That splitting reads
from left to right; it looks ahead only over blanks, and only a leading space or apostrophe joins
a character to what follows. So there is no cut after a blank (of any kind), before an
apostrophe, or inside a character.

Defined ids: empty and null texts have the empty list.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.charform import chunks

#: Folder of vocabulary files; a parameter, as the files aren't part of this repository.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Distinct fragments remembered by a worker between batches; beyond it the memory starts anew.
REMEMBERED = 400_000
#: Bytes of text encoded at a time.
CHUNK_BYTES = 4 << 20
# UTF-8 of the blanks beyond ASCII.
_BLANKS = [bytes.fromhex(x) for x in "C285 C2A0 E19A80 E280A8 E280A9 E280AF E2819F E38080".split()] + [b"\xe2\x80" + bytes([x]) for x in range(0x80, 0x8B)]
_ASCII_BLANKS = b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "


class Encoder:
    """A byte-level vocabulary with its table of certain cuts."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        joined = b"".join(token + b"\x00\x00" for token in ranks)
        raw = np.frombuffer(joined, np.uint8).astype(np.int64)
        size = np.array([len(token) for token in ranks])
        inside = np.ones(len(raw), bool)
        ends = np.cumsum(size + 2)
        for back in (1, 2, 3):  # the last byte of a token and the two fillers begin no pair within it
            inside[ends - back] = False
        inside[-1] = False
        at = np.flatnonzero(inside)
        self.certain = np.ones(65536, bool)
        self.certain[raw[at] << 8 | raw[at + 1]] = False
        first, second = np.arange(65536) >> 8, np.arange(65536) & 255
        self.certain &= (second & 0xC0) != 0x80
        self.certain &= ~np.isin(first, np.frombuffer(_ASCII_BLANKS, np.uint8)) & (second != ord("'"))
        self.known: dict[str, list[int]] = {}

    def cuts(self, raw: np.ndarray) -> np.ndarray:
        """Positions before which a cut is certain."""
        if len(raw) < 2:
            return np.empty(0, np.int64)
        found = self.certain[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        high = np.flatnonzero(found & (raw[:-1] >= 0x80))
        if len(high):
            for blank in _BLANKS:
                here = high[high >= len(blank) - 1]
                same = np.ones(len(here), bool)
                for back, byte in enumerate(reversed(blank)):
                    same &= raw[here - back] == byte
                found[here[same]] = False
        return np.flatnonzero(found) + 1

    def fragments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The fragments of all texts end to end, and how many each text has."""
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
        at = at - at[0]
        bounds = np.unique(np.concatenate([self.cuts(raw), at]))
        pieces = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
        return pieces, np.diff(np.searchsorted(bounds, at))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each text has."""
        parts = [self._encode(part) for part in chunks(texts, CHUNK_BYTES)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces, per_text = self.fragments(texts)
        if not len(pieces):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        coded = pieces.dictionary_encode()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, encode = self.known, self.coder.encode_ordinary
        ids = []
        for piece in coded.dictionary.to_pylist():
            found = known.get(piece)
            if found is None:
                found = encode(piece)
                if len(piece) <= 64:
                    known[piece] = found
            ids.append(found)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        pool = np.fromiter((i for x in ids for i in x), np.int32, int(size.sum()))
        which = coded.indices.to_numpy(zero_copy_only=False)
        length = size[which]
        ends = np.cumsum(length)
        within = np.arange(int(ends[-1])) - np.repeat(ends - length, length)
        flat = pool[np.repeat((np.cumsum(size) - size)[which], length) + within]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return flat, np.diff(upto)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _shipped(vocabulary: str, folder: str | None) -> Callable[[], Encoder]:
    """The encoder as workers find it: the driver's vocabulary file is sent to every executor once."""
    path = f"{folder or TOKENIZERS}/{vocabulary}.tiktoken"
    SparkSession.getActiveSession().sparkContext.addFile(path)
    name = os.path.basename(path)
    return lambda: encoder(SparkFiles.get(name))


def token_ids(text: str, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> Column:
    """``array<int>`` of the ids of a text column, without special tokens."""
    own = _shipped(vocabulary, folder)

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def ids(texts: pa.Array) -> pa.Array:
        flat, size = own().encode(texts)
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(flat, pa.int32()))

    return ids(F.col(text))


def token_count(text: str, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> Column:
    """``int`` number of ids of a text column; 0 for empty and null."""
    own = _shipped(vocabulary, folder)

    @F.arrow_udf(T.IntegerType())
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(own().encode(texts)[1].astype(np.int32))

    return count(F.col(text))
