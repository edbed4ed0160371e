"""Column-wise construction of the Burrows-Wheeler transform and common prefixes of a collection of strings.

All strings stand at one column; each round inserts one symbol of every string, from the column leftwards, into the transform of
the collection.  The transform and the common prefixes live in sequential files that a round reads from end to end and writes
anew.  Where a suffix goes follows from the order of the transform alone: the suffixes that start with a symbol stand in the order of the
entries that hold this symbol, so the new place of ``c + suffix`` is the stable rank of its entry among all entries by symbol.
Its common prefix with a neighbour is one more than the least common prefix between their entries.

A string goes on only while it can still share a run: its common prefix with a neighbour grows by one symbol a round at most, so it
ends once that and the rounds that it has left come to less than a run.

What stands right of the column is inserted before the first round as a whole: the strings' ends are sorted once and act as the
ends of the collection's strings, in this order, with the common prefixes that they have.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np


class _File:
    """An array on disk that is read and written as a whole, in sequence.

    It is written over what it holds and never shrinks: a file that is emptied first is put on the disk as it is closed.
    """

    def __init__(self, folder: str, name: str, dtype):
        self.path, self.dtype, self.size = os.path.join(folder, name), dtype, 0

    def write(self, values: np.ndarray) -> None:
        with open(self.path, "r+b" if self.size else "wb") as f:
            values.astype(self.dtype, copy=False).tofile(f)
        self.size = len(values)

    def read(self) -> np.ndarray:
        return np.fromfile(self.path, self.dtype, self.size)


def _common_prefixes(ends: list[bytes]) -> np.ndarray:
    """Of each of the sorted ends with the one before it; 0 for the first."""
    out = np.zeros(len(ends), np.uint16)
    for lo in range(1, len(ends), 2048):
        part = ends[lo - 1 : lo + 2048]
        size = np.array([len(x) for x in part])
        width = int(size.max()) + 1
        a = np.zeros((len(part), width), np.uint8)
        for i, x in enumerate(part):
            a[i, : len(x)] = np.frombuffer(x, np.uint8)
        differ = a[1:] != a[:-1]
        differ[:, -1] = True
        out[lo : lo + len(part) - 1] = np.minimum(differ.argmax(axis=1), np.minimum(size[1:], size[:-1]))
    return out


class _RangeMin:
    """Least value of [lo, hi) for many ranges at once, by tables of doubling width."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        k = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), np.uint16)
        for level in np.unique(k):
            while len(self.levels) <= level:
                t, w = self.levels[-1], 1 << (len(self.levels) - 1)
                self.levels.append(np.minimum(t[:-w], t[w:]))
            at = np.flatnonzero(k == level)
            t = self.levels[level]
            out[at] = np.minimum(t[lo[at]], t[hi[at] - (1 << level)])
        return out


def repeated_starts(strings: list[bytes], column: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string, which of its starts 0 .. len - length begin a run of ``length`` bytes that another string holds as well.

    ``column[i]`` is where string i stands at the common column; runs are compared at equal distance from it only, which is what
    strings cut around a common anchor need.
    """
    m = len(strings)
    found = [np.zeros(max(len(s) - length + 1, 0), bool) for s in strings]
    if m < 2:
        return found
    used = np.unique(np.frombuffer(b"".join(strings), np.uint8))
    kind = np.uint8 if len(used) < 255 else np.uint16
    code = np.zeros(256, kind)
    code[used] = np.arange(1, len(used) + 1)
    ends = [s[c:] for s, c in zip(strings, column, strict=True)]
    by_end = np.array(sorted(range(m), key=ends.__getitem__))
    rounds = int(column.max())
    # Column r of heads is the symbol that round r inserts; 0 where the string has begun.
    heads = np.zeros((m, rounds + 1), kind)
    for i, (s, c) in enumerate(zip(strings, column, strict=True)):
        if c:
            heads[i, :c] = code[np.frombuffer(s, np.uint8, int(c))[::-1]]
    place = np.empty(m, np.int64)
    place[by_end] = np.arange(m)

    active = np.ones(m, bool)

    def note(who: np.ndarray, at: np.ndarray, common: np.ndarray, r: int) -> np.ndarray:
        """Mark the starts that are repeated; which strings end, for they can share no run in the rounds that they have left."""
        most = common[at].astype(np.int64)
        inner = at + 1 < len(common)
        most[inner] = np.maximum(most[inner], common[at[inner] + 1])
        for i in who[most >= length]:
            found[i][column[i] - r] = True
        ends = most + column[who] - r < length
        active[who[ends]] = False
        return ends

    with tempfile.TemporaryDirectory(prefix="bwt") as folder:
        symbols, prefixes = _File(folder, "symbols", kind), _File(folder, "prefixes", np.uint16)
        common = _common_prefixes([ends[i] for i in by_end])
        everyone, first = np.arange(m), heads[by_end, 0]
        first[place[note(everyone, place, common, 0)]] = 0
        symbols.write(first)
        prefixes.write(common)
        for r in range(1, rounds + 1):
            who = everyone[active & (column >= r)]
            if len(who) == 0:
                break
            b, common = symbols.read(), prefixes.read()
            order = np.argsort(b, kind="stable")
            rank = np.empty(len(b), np.int64)
            rank[order] = np.arange(len(b))
            ended = int(np.count_nonzero(b == 0))
            t = rank[place[who]]
            turn = np.argsort(t)
            who, t = who[turn], t[turn]
            own = place[who]
            new = t - ended + m
            least = _RangeMin(common)
            before, after = np.zeros(len(who), np.uint16), np.zeros(len(who), np.uint16)
            prev = order[np.maximum(t - 1, 0)]
            has = np.flatnonzero((t - 1 >= ended) & (b[prev] == b[own]))
            before[has] = least.least(prev[has] + 1, own[has] + 1) + np.uint16(1)
            nxt = order[np.minimum(t + 1, len(b) - 1)]
            has = np.flatnonzero((t + 1 < len(b)) & (b[nxt] == b[own]))
            after[has] = least.least(own[has] + 1, nxt[has] + 1) + np.uint16(1)
            size = len(b) + len(who)
            old = np.ones(size, bool)
            old[new] = False
            b2, c2 = np.empty(size, kind), np.empty(size, np.uint16)
            b2[old], c2[old] = b, common
            inner = new + 1 < size
            c2[new[inner] + 1] = after[inner]
            b2[new], c2[new] = heads[who, r], before
            place[who] = new
            b2[new[note(who, new, c2, r)]] = 0
            symbols.write(b2)
            prefixes.write(c2)
    return found
