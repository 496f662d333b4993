"""Whole Arrow columns of text as NumPy arrays of words, lines and n-gram hashes.

Everything works on UTF-8 bytes.  All separators that the operators use are
ASCII, and every byte of a multi-byte character is 0x80 or above, so splitting
bytes gives the same words as splitting code points.

Hashes are 64 bits wide: a polynomial over random byte weights modulo 2**64,
taken from prefix sums, then mixed.  They are the same on every machine.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools

import numpy as np
import pyarrow as pa

# Text that is handled at once, with some 80 bytes of arrays for each; a single longer text is still taken whole.
CHUNK_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240607))
_WEIGHT = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 2**62)) * 8 + 5
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = 4096
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
GRAM = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _table(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    x = 1
    for i in range(n):
        out[i] = x
        x = x * base % 2**64
    return out


_LOW, _LOW_INV = _table(_BASE, _STEP), _table(_INVERSE, _STEP)
_HIGH, _HIGH_INV = _table(pow(_BASE, _STEP, 2**64), 1024), _table(pow(_INVERSE, _STEP, 2**64), 1024)


def _high(n: int) -> None:
    global _HIGH, _HIGH_INV
    if n > len(_HIGH):
        _HIGH, _HIGH_INV = _table(pow(_BASE, _STEP, 2**64), 2 * n), _table(pow(_INVERSE, _STEP, 2**64), 2 * n)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _C1
    x = x ^ (x >> np.uint64(29))
    x = x * _C2
    return x ^ (x >> np.uint64(32))


def byte_set(pattern: str, invert: bool = False) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(pattern.encode("latin-1"))] = True
    return ~out if invert else out


SPACES = " \t\n\x0b\x0c\r"
NOT_SPACE = byte_set(SPACES, invert=True)
#: Digits, a-z and all of the non-ASCII range, after lower-casing.
ALNUM = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def parts(column: pa.Array, limit: int = CHUNK_BYTES, rows: int = 1 << 30):
    """Slices (first row, text column) of at most `limit` bytes or one row, and at most `rows` rows; null becomes empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    lo = 0
    while lo < len(column):
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1))
        yield lo, Text(column, offsets, lo, hi)
        lo = hi


class Text:
    """Rows lo..hi of a text column as one array of bytes."""

    def __init__(self, column, offsets, lo, hi):
        data = column.buffers()[2]
        first, last = int(offsets[lo]), int(offsets[hi])
        self.raw = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
        self.off = (offsets[lo : hi + 1] - first).astype(np.int64)
        self.n = hi - lo
        self._sums = None
        self.bytes = self.raw

    def lower(self) -> Text:
        self.bytes = LOWER[self.raw]
        return self

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and end of each word."""
        is_word = table[self.bytes]
        begin, end = is_word.copy(), is_word.copy()
        begin[1:] &= ~is_word[:-1]
        end[:-1] &= ~is_word[1:]
        inner = self.off[1:-1]
        inner = inner[(inner > 0) & (inner < len(is_word))]
        begin[inner] = is_word[inner]
        end[inner - 1] = is_word[inner - 1]
        start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
        return np.searchsorted(self.off, start, "right") - 1, start, stop

    def per_row(self, mask: np.ndarray) -> np.ndarray:
        return self.between(mask, self.off[:-1], self.off[1:])

    @staticmethod
    def between(mask: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[stop] - total[start]

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        if self._sums is None:
            n = len(self.bytes)
            rows = -(-n // _STEP)
            _high(rows + 1)
            power = (_HIGH[:rows, None] * _LOW[None, :]).ravel()[:n]
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_WEIGHT[self.bytes] * power, out=sums[1:])
            self._sums = sums
        inverse = _LOW_INV[start % _STEP] * _HIGH_INV[start // _STEP]
        return mix((self._sums[stop] - self._sums[start]) * inverse + (stop - start).astype(np.uint64))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and end of each line; an empty text has one empty line."""
        breaks = np.flatnonzero(self.raw == 10)
        start = np.sort(np.concatenate([self.off[:-1], breaks + 1]), kind="stable")
        stop = np.sort(np.concatenate([breaks, self.off[1:]]), kind="stable")
        count = self.per_row(self.raw == 10) + 1
        return np.repeat(np.arange(self.n), count), start, stop


def grams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the n-word windows that stay in one row."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = len(h) - n + 1
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out += h[at + k] * GRAM[k]
    return at, mix(out)


class Counter:
    """Counts 64-bit keys; holds at most about `most` of them, then its user takes the counts so far."""

    def __init__(self, most: int = 8_000_000):
        self.keys, self.held, self.most = [], 0, most

    def add(self, keys: np.ndarray) -> bool:
        """Whether it is time to take."""
        self.keys.append(keys)
        self.held += len(keys)
        return self.held >= self.most

    def take(self, least: int = 1):
        """Batches (h, c) of the keys counted at least `least` times; starts anew."""
        if self.held:
            keys = np.concatenate(self.keys)
            keys.sort()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            counts = np.diff(np.concatenate([first, [len(keys)]]))
            keys = keys[first]
            if least > 1:
                keys, counts = keys[counts >= least], counts[counts >= least]
            for lo in range(0, len(keys), 1 << 19):
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + (1 << 19)].view(np.int64)), pa.array(counts[lo : lo + (1 << 19)])], ["h", "c"])
        self.keys, self.held = [], 0


def lean(run):
    """run, after which its Python worker, which later tasks use again, gives free memory back."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return task


def text_of(column) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]
