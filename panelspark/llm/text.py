"""Words of Arrow string columns as numpy arrays, without a Python object for each word.

``pieces`` walks a string column in pieces of about 256 KB. A word's 64-bit
value is a polynomial over the 64-bit codes of its bytes, read off one running
sum for the whole piece, and then mixed. Equal words have equal values; two
given different words share one with a chance of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_CODES = _rng.integers(1, 2**64, 256, dtype=U64)
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_BASE_INV = pow(_BASE, -1, 2**64)
PIECE = 1 << 18

#: Lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: all but ASCII white space; and letters, digits and all that isn't ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U64)
    done = 1
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * U64(pow(base, done, 2**64))
        done += k
    return out


_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(2 * PIECE, 1 << (n - 1).bit_length())
    if size not in _pow:
        if len(_pow) > 1:
            _pow.pop(max(_pow))
        _pow[size] = _powers(_BASE, size), _powers(_BASE_INV, size)
    return _pow[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Words:
    """The words of some rows. ``first[i]:first[i+1]`` are the words of row i; ``raw`` holds the lower-cased bytes."""

    __slots__ = ("raw", "start", "end", "value", "first", "_total")

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, kind: np.ndarray):
        self.raw = LOWER[raw]
        n = len(raw)
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
            self.value, self.first = np.zeros(0, U64), np.zeros(len(bounds), np.int64)
            self._total = np.zeros(1, U64)
            return
        word = kind[self.raw]
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = word[:-1]
        edge = bounds[:-1][bounds[:-1] < n]
        before[edge] = False
        self.start = np.flatnonzero(word & ~before)
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = word[1:]
        after[edge[edge > 0] - 1] = False
        self.end = np.flatnonzero(word & ~after) + 1
        up, down = powers(n)
        total = np.empty(n + 1, U64)
        total[0] = 0
        np.cumsum(_CODES[self.raw] * up[:n], out=total[1:])
        self.value = mix((total[self.end] - total[self.start]) * down[self.start])
        self.first = np.searchsorted(self.start, bounds)
        self._total = total

    def prefix(self, k: int) -> np.ndarray:
        """The values of the first k bytes of each word; shorter words have their own value."""
        if not len(self.raw):
            return self.value
        _, down = powers(len(self.raw))
        return mix((self._total[np.minimum(self.start + k, self.end)] - self._total[self.start]) * down[self.start])

    def text(self, i: int, j: int) -> bytes:
        """Words i to j-1, lower-cased, one space between."""
        return b" ".join(self.raw[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j], strict=True))


def pieces(col: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row bounds) of successive rows, about ``limit`` bytes each; a longer text stands alone. Nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    wide = pa.types.is_large_string(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def words(col: pa.Array, kind: np.ndarray) -> Iterator[tuple[int, Words]]:
    for row, raw, bounds in pieces(col):
        yield row, Words(raw, bounds, kind)


def ramp(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length n, one after another."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
