"""NumPy kernels over the bytes of a block of texts, as they lie in an Arrow column.

A block holds whole texts of about BLOCK_BYTES in sum (one text at least), so memory is bounded by
that and the longest text.  Words are runs of bytes other than space and 0x09 to 0x0D, which in UTF-8
are the same as runs of such characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2_000_000
LONG_WORD = 512

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_C1, _C2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


class Block:
    """Texts ``first`` to ``last`` - 1 of an Arrow column: ``data`` and the texts' ``bounds`` in it."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        self.n = len(bounds) - 1
        self._words = None

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """The sum of ``flags`` (one for each byte) over every text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each word."""
        if self._words is None:
            space = _SPACE[self.data]
            begin, close = ~space, ~space
            if len(space):
                cut = self.bounds[:-1][self.bounds[:-1] < self.bounds[1:]]
                first = np.zeros(len(space) + 1, bool)
                first[cut] = True
                first[-1] = True
                begin[1:] &= space[:-1] | first[1:-1]
                close[:-1] &= space[1:] | first[1:-1]
            start, end = np.flatnonzero(begin), np.flatnonzero(close) + 1
            self._words = start, end, np.searchsorted(self.bounds, start, "right") - 1
        return self._words

    def word_hashes(self) -> np.ndarray:
        start, end, _ = self.words()
        out = np.zeros(len(start), np.uint64)
        if not len(start):
            return out
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded, 0, (1,))
        length = end - start
        out[:] = mix(length.astype(np.uint64))
        live = np.flatnonzero(length <= LONG_WORD)
        at = 0
        while len(live):
            left = length[live] - at
            out[live] = mix(out[live] ^ (eight[start[live] + at] & _KEEP[np.minimum(left, 8)]))
            at += 8
            live = live[left > 8]
        for i in np.flatnonzero(length > LONG_WORD):
            out[i] = np.frombuffer(hashlib.blake2b(self.data[start[i] : end[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
        return out

    def windows(self, k: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text and first word of each window of ``k`` words.  ``short``: a text of 1 to k - 1 words is one window."""
        h = self.word_hashes()
        _, _, doc = self.words()
        n = len(h)
        if n >= k:
            first = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
            out = np.zeros(len(first), np.uint64)
            for j in range(k):
                out = mix(out ^ h[first + j])
        else:
            first, out = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if short and n:
            count = np.bincount(doc, minlength=self.n)
            few = np.flatnonzero((count > 0) & (count < k))
            at = np.searchsorted(doc, few)
            extra = mix(count[few].astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
            for j in range(k - 1):
                has = count[few] > j
                extra[has] = mix(extra[has] ^ h[at[has] + j])
            first, out = np.concatenate([first, at]), np.concatenate([out, extra])
        return out, doc[first] if len(first) else np.zeros(0, np.int64), first


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """(first row, last row + 1, Block) over a string or binary column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j, Block(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def each_block(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """The rows of a batch block by block."""
    for i, j, block in blocks(batch.column(batch.schema.get_field_index(column))):
        yield batch.slice(i, j - i), block
