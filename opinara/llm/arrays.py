"""Words, word hashes and shingles of whole Arrow text columns, as numpy arrays.

A word is a run of characters other than ASCII punctuation, blanks and controls, with A-Z lowered; on UTF-8
bytes that is a run of digits, ASCII letters and bytes from 0x80. Null texts count as empty. Equal words have
equal 64-bit hashes in every task. Texts are handled in blocks of documents of about BLOCK bytes, a longer
text is a block of its own, so memory follows the longest text and not the partition.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
RUN = 1 << 18
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers: list[np.ndarray] = []

_LOWERED = np.zeros(256, np.uint8)
_LOWERED[0x30:0x3A] = np.arange(0x30, 0x3A)
_LOWERED[0x61:0x7B] = np.arange(0x61, 0x7B)
_LOWERED[0x41:0x5B] = np.arange(0x61, 0x7B)
_LOWERED[0x80:] = np.arange(0x80, 0x100)


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(18, int(n - 1).bit_length())
        tables = []
        for base in (_MULTIPLIER, _INVERSE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table, dtype=np.uint64))
        _powers[:] = tables
    return _powers


def trim() -> None:
    """Give freed memory back to the system: workers outlive tasks, and executors share their memory."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1]
    ends = ends.astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[ends[0]: ends[-1]], ends - ends[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges [first, last) of documents of about `limit` bytes each; a document is never cut."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


class Words:
    """Words of a block of documents: hashes in order, and counts[i] words in document i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, last: int):
        ends = offsets[first: last + 1] - offsets[first]
        low = _LOWERED[data[offsets[first]: offsets[last]]]
        n = len(low)
        inside = low != 0
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        cuts = ends[:-1][ends[:-1] < n]
        opens[cuts] = inside[cuts]  # a text never continues the word that ended the text before
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        cuts = cuts[cuts > 0] - 1
        closes[cuts] = inside[cuts]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.hashes = mix(self._sums(low))
        self.bounds = np.searchsorted(self.starts, ends)  # bounds[i]: first word of document i
        self.counts = np.diff(self.bounds)

    def _sums(self, low: np.ndarray) -> np.ndarray:
        """Polynomial of each word's bytes, from running sums over runs of words of at most RUN bytes."""
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(out):
            begin = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, begin + RUN, "right")))
            n = int(self.ends[j - 1] - begin)
            up, down = _power_tables(n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(low[begin: begin + n] * up[:n], dtype=np.uint64, out=sums[1:])
            opens, closes = self.starts[i:j] - begin, self.ends[i:j] - begin
            out[i:j] = (sums[closes] - sums[opens]) * down[opens]
            i = j
        return out

    def __len__(self) -> int:
        return len(self.hashes)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k consecutive words that start at each position; the last k - 1 positions have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total *= np.uint64(_MULTIPLIER)
        total += hashes[j: j + n]
    return mix(total)


def whole(hashes: np.ndarray) -> np.uint64:
    """One hash for all the given words in order."""
    return rolling(hashes, len(hashes))[0]


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes of a block and their document numbers, in order.

    A document with fewer than k words, but at least one, has one shingle: all its words.
    """
    grams = rolling(words.hashes, k)
    document = np.repeat(np.arange(len(words.counts)), words.counts)
    n = len(grams)
    whole_k = document[:n] == document[k - 1: k - 1 + n] if n else np.zeros(0, bool)
    hashes, owners = grams[whole_k], document[:n][whole_k]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        extra = np.array([whole(words.hashes[words.bounds[i]: words.bounds[i + 1]]) for i in short], np.uint64)
        hashes, owners = np.concatenate([hashes, extra]), np.concatenate([owners, short])
        order = np.argsort(owners, kind="stable")
        hashes, owners = hashes[order], owners[order]
    return hashes, owners


def unique_per_owner(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each owner, sorted by owner, then hash."""
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return hashes[fresh], owners[fresh]


class Lookup:
    """Positions of 64-bit keys in a sorted table; a bitmap of their top bits settles most misses at once."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.keys = np.sort(keys.astype(np.uint64))
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.keys >> self.shift).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Indices of the given hashes that are in the table."""
        if not len(self.keys) or not len(hashes):
            return np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.seen[(hashes >> self.shift).astype(np.int64)])
        at = np.searchsorted(self.keys, hashes[maybe])
        at[at == len(self.keys)] = 0
        return maybe[self.keys[at] == hashes[maybe]]
