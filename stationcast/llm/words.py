"""Words of whole texts as flat numpy arrays.

A word is a run of characters other than ``\\x20`` and ``\\x09``-``\\x0D``. A block holds the
words of consecutive documents as 64-bit hashes with the word offsets of each document, so
that window operators run as a few array operations over a bounded amount of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20  # text handled at once; one longer document makes a block of its own
LONG_WORD = 1024  # longer words are hashed by hashlib

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
KEEP_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
U = np.uint64
M1, M2, M3 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
ODD = 0xD6E8FEB86659FD93
ODD_INV = pow(ODD, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> U(30))) * M1
    h = (h ^ (h >> U(27))) * M2
    return h ^ (h >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.ones(n, U)
    if n > 1:
        out[1:] = U(base)
        np.multiply.accumulate(out, out=out)
    return out


@dataclass
class Block:
    """Words of some documents: ``data`` bytes, word ``starts`` and ``ends`` in bytes, ``bounds`` in words."""

    data: np.ndarray
    text_at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.bounds)

    def document_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.n_words)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of every word, equal for equal words in any block."""
        starts, length = self.starts, self.ends - self.starts
        out = mix(length.astype(U) + U((seed * ODD + 1) % 2**64))
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = self.data
        lanes = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        todo = np.flatnonzero(length <= LONG_WORD)
        at = 0
        while len(todo):
            left = length[todo] - at
            lane = lanes[starts[todo] + at] & KEEP_LOW[np.minimum(left, 8)]
            out[todo] = mix((out[todo] ^ lane) * M3 + U(at + 1))
            todo = todo[left > 8]
            at += 8
        for i in np.flatnonzero(length > LONG_WORD):
            digest = hashlib.blake2b(self.data[starts[i]:self.ends[i]].tobytes(), digest_size=8, key=b"%d" % seed)
            out[i] = U(int.from_bytes(digest.digest(), "little"))
        return out

    def windows(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all n-word windows inside one document, and the windows' 64-bit hashes."""
        if len(hashes) < n:
            return np.zeros(0, np.int64), np.zeros(0, U)
        last = np.repeat(self.bounds[1:], self.n_words)
        at = np.flatnonzero(np.arange(len(hashes)) + n <= last)
        sums = np.zeros(len(hashes) + 1, U)
        np.cumsum(hashes * powers(ODD, len(hashes)), out=sums[1:])
        return at, mix((sums[at + n] - sums[at]) * powers(ODD_INV, len(hashes))[at])


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and each text's offset among them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, offsets


def split_words(data: np.ndarray, offsets: np.ndarray) -> Block:
    data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
    word = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Block(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """First row, end row and words of consecutive rows with about ``limit`` bytes of text."""
    data, offsets = text_buffers(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, split_words(data, offsets[row:end + 1])
        row = end


def per_document(flags: np.ndarray, block: Block) -> np.ndarray:
    """Sum of a value per word over each document."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[block.bounds[1:]] - sums[block.bounds[:-1]]


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Whether each of ``size`` positions lies in one of the n-long windows at ``starts``."""
    steps = np.bincount(starts, minlength=size + 1) - np.bincount(starts + n, minlength=size + 1)
    return np.cumsum(steps[:size]) > 0
