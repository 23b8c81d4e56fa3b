"""Words, lines and shingles of a whole Arrow batch of texts as numpy arrays over its UTF-8 bytes.

All hashes are 64-bit: a polynomial of random byte values, taken from one running sum over the batch, then mixed. Two
different words or lines of one corpus share a hash with a chance of about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20240613))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_STEP = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes of text worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1_000_000

#: Word characters of the contracts that split at blank and control white space: every byte but 0x20 and 0x09 to 0x0D.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers = {1: np.ones(1, np.uint64)}


def _powers_of(base: int, n: int) -> np.ndarray:
    found = _powers.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, 1 << 16), base, np.uint64)
        found[0] = 1
        np.multiply.accumulate(found, out=found)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = found
    return found[:n]


class Texts:
    """One slice of a column of texts; null counts as empty."""

    def __init__(self, column: pa.Array, word_bytes: np.ndarray = NOT_BLANK, lower: bool = False) -> None:
        column = pc.fill_null(column.cast(pa.large_string()), "")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
        self.bounds = offsets - offsets[0]
        self.data = LOWER[raw] if lower else raw
        self.word_bytes = word_bytes

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def count(self, mask: np.ndarray) -> np.ndarray:
        """Bytes of each text that the mask marks."""
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    @cached_property
    def in_word(self) -> np.ndarray:
        return self.word_bytes[self.data]

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of every word."""
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.bounds] = True
        w = self.in_word
        before = np.zeros(len(w), bool)
        before[1:] = w[:-1]
        after = np.zeros(len(w), bool)
        after[:-1] = w[1:]
        return np.flatnonzero(w & (~before | edge[:-1])), np.flatnonzero(w & (~after | edge[1:])) + 1

    @cached_property
    def first_word(self) -> np.ndarray:
        """Number of the first word of each text, and of the end."""
        return np.searchsorted(self.words[0], self.bounds)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first_word)

    @cached_property
    def _running(self) -> np.ndarray:
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _powers_of(_BASE, len(self.data)), out=sums[1:])
        return sums

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each span of bytes."""
        found = self._running[ends] - self._running[starts]
        found *= _powers_of(_BASE_INVERSE, len(self.data) + 1)[starts]
        return mix(found ^ (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return self.hashes(*self.words)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the first word, hash) of every window of ``k`` words within one text."""
        h, n = self.word_hashes, len(self.word_hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total += h[j : j + n] * _STEP[j]
        fits = np.ones(n, bool)
        # A window that starts in the last k - 1 words of a text would reach into the next one.
        for j in range(1, k):
            at = self.first_word[1:] - j
            at = at[(at >= 0) & (at < n)]
            fits[at] = False
        at = np.flatnonzero(fits)
        return at, mix(total[at])

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.n_words)


def slices(batches: Iterator[pa.RecordBatch], text: int, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each have about ``max_bytes`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + max_bytes, "right")))
            yield batch.slice(at, end - at)
            at = end
