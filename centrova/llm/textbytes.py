"""Whole-batch text scanning with NumPy: words, lines and span hashes of UTF-8 bytes.

Arrow hands a batch of texts over as one byte buffer with offsets.  Everything here works on slices of that buffer of about
``SLICE_BYTES`` (one text at least), so memory does not depend on the batch, and no Python object is made per word.

A span hash is ``sum(T[b[s+j]] * C**j) mod 2**64``, read off one prefix sum; ``T`` is a table of random words per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240613))
RAW = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
RAW2 = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
FOLDED = RAW.copy()
FOLDED[65:91] = RAW[97:123]
FOLDED2 = RAW2.copy()
FOLDED2[65:91] = RAW2[97:123]
#: Bytes of words: all but space, tab, newline, vertical tab, form feed and carriage return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words made of ASCII letters and digits and of all code points from U+0080 on.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True

_C = 0x9E3779B97F4A7C15 | 5
_C_INV = pow(_C, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """C**i and C**-i for i up to n; kept for slices of the usual size."""
    if len(_powers[0]) > n:
        return _powers[0], _powers[1]
    n = max(n, SLICE_BYTES)
    both = []
    for c in (_C, _C_INV):
        p = np.full(n + 1, c, np.uint64)
        p[0] = 1
        both.append(np.cumprod(p))
    if n <= 4 * SLICE_BYTES:
        _powers[:] = both
    return both[0], both[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of rows + 1) of each slice; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + 60_000)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def prefix(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, stop); spans of equal bytes have equal hashes wherever they stand."""
    return mix((sums[stop] - sums[start]) * powers(len(sums))[1][start] + (stop - start).astype(np.uint64))


def spans(data: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of the maximal runs of member bytes; runs end with their text."""
    n = len(data)
    m = member[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    prev, cur = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    prev[1:] = m
    cur[:n] = m
    return np.flatnonzero(cur & (~prev | edge)), np.flatnonzero(prev & (~cur | edge))


@dataclass
class Words:
    start: np.ndarray
    stop: np.ndarray
    hash: np.ndarray
    #: Row of each word, and the first word of each row (rows + 1).
    doc: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


def words(data: np.ndarray, offs: np.ndarray, member: np.ndarray = NOT_SPACE, table: np.ndarray = RAW) -> Words:
    start, stop = spans(data, offs, member)
    h = span_hash(prefix(data, table), start, stop)
    first = np.searchsorted(start, offs)
    first[-1] = len(start)
    return Words(start, stop, h, np.repeat(np.arange(len(offs) - 1), np.diff(first)), first)


def ngram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of each k consecutive word hashes (positions whose k words end in the array)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, U64(k), np.uint64)
    for j in range(k):
        out = mix(out * U64(0xD6E8FEB86659FD93) + h[j : j + n])
    return out


def ngrams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every k-word window within a row."""
    h = ngram_hash(w.hash, k)
    at = np.flatnonzero(w.doc[: len(h)] == w.doc[k - 1 : k - 1 + len(h)])
    return at, h[at]


def whole_hash(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash of all its words) of the rows with at least one word and fewer than k."""
    n = np.diff(w.first)
    rows = np.flatnonzero((n > 0) & (n < k))
    out = np.zeros(len(rows), np.uint64)
    for size in range(1, k):
        at = np.flatnonzero(n[rows] == size)
        if len(at):
            h = np.full(len(at), U64(size), np.uint64)
            for j in range(size):
                h = mix(h * U64(0xD6E8FEB86659FD93) + w.hash[w.first[rows[at]] + j])
            out[at] = h
    return rows, out


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def covered(at: np.ndarray, width: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n items lie in [at, at + width)."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, at, 1)
    np.add.at(d, at + width, -1)
    return np.cumsum(d[:-1]) > 0


def by_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Sum of weights (or count) per row, as long."""
    return np.bincount(rows, weights, minlength=n)[:n].astype(np.int64)
