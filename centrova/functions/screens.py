"""Squared Euclidean distances by one matrix product: not exact enough to return, but enough to tell which pairs need their own."""

from __future__ import annotations

import numpy as np

from centrova.functions.measures import block_distance

#: Rows of each side that are looked at together, so that their distances stay in a core's cache.
LEFT, RIGHT = 128, 2048
#: Pairs whose own distances are taken at a time.
PAIRS = 16_384


def euclidean(m, *sides: np.ndarray) -> bool:
    """Whether the measure grows with the squared distance, and no square overflows."""
    return m.name in ("L2", "SQRL2") and all(np.isfinite(x).all() and (not x.size or np.abs(x).max() < 1e150) for x in sides)


def left(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows for ``squares``, squared norms)."""
    norm = (x * x).sum(axis=1)
    return np.concatenate([-2 * x, np.ones((len(x), 1)), norm[:, None]], axis=1), norm


def right(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = (y * y).sum(axis=1)
    return np.concatenate([y, norm[:, None], np.ones((len(y), 1))], axis=1), norm


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``nonzero`` of a matrix, which is several times slower than that of a vector."""
    return np.divmod(np.flatnonzero(mask.ravel()), mask.shape[1])


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T


def slack(dim: int, x_norm: np.ndarray, y_norm: np.ndarray) -> np.ndarray:
    """How far ``squares`` and the measure's own sums of a row of x may be apart, over any row of y, several times over."""
    return 1e-15 * (dim + 8) * (x_norm + y_norm.max(initial=0.0))


def own(m, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The measure of row i of x and row i of y, in the same operations as ``block_distance``; for ``euclidean`` measures."""
    out = np.empty(len(x))
    for lo in range(0, len(x), PAIRS):
        out[lo : lo + PAIRS] = ((x[lo : lo + PAIRS] - y[lo : lo + PAIRS]) ** 2).sum(axis=1)
    return np.sqrt(out) if m.name == "L2" else out


def nearest(m, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of the row of y that is nearest to each row of x, the first of equal ones; y has rows."""
    if not euclidean(m, x, y):
        d = block_distance(m, x, y)
        at = d.argmin(axis=1)
        return at, d[np.arange(len(x)), at]
    a, x_norm = left(x)
    least, found = np.full(len(x), np.inf), []
    b, y_norm = right(y)
    room = slack(x.shape[1], x_norm, y_norm)
    for lo in range(0, len(y), RIGHT):
        s = squares(a, b[lo : lo + RIGHT])
        least = np.minimum(least, s.min(axis=1))
        i, j = places(s <= (least + room + 1e-14 * np.abs(least))[:, None])
        found.append((i, j + lo, s[i, j]))
    i, j, s = (np.concatenate(v) for v in zip(*found, strict=True))
    keep = s <= (least + room + 1e-14 * np.abs(least))[i]
    i, j = i[keep], j[keep]
    d = np.concatenate([own(m, x[i[lo : lo + PAIRS]], y[j[lo : lo + PAIRS]]) for lo in range(0, len(i), PAIRS)])
    order = np.lexsort((j, d, i))
    first = order[np.searchsorted(i[order], np.arange(len(x)))]
    return j[first], d[first]


def _spared(y: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of rows that may be among k nearest others: of equal rows, which come by id, the first k + 1."""
    if not len(y) or len(np.unique(ids)) < len(ids):
        return np.arange(len(y))
    _, group = np.unique(np.ascontiguousarray(y).view(np.dtype((np.void, y.shape[1] * y.itemsize))).ravel(), return_inverse=True)
    order = np.argsort(group, kind="stable")
    first = np.searchsorted(group[order], group[order])
    return np.sort(order[np.arange(len(order)) - first <= k])


def k_nearest(m, prior: float, x: np.ndarray, x_ids: np.ndarray, y: np.ndarray, y_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of x, ids of y, distances, negated for similarities) of the k nearest rows of y with another id, ties to the lower id.

    Both sides are cut in pieces by their widest feature; a piece of x meets those of y from the closest on, until none can hold
    anything nearer, and only pairs that the matrix product cannot rule out get their own distance.
    """
    if not len(x) or not len(y):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    sign = -1.0 if m.similarity else 1.0
    order = np.argsort(y_ids, kind="stable")
    y, y_ids = y[order], y_ids[order]
    near = x.shape[1] > 0 and euclidean(m, x, y)
    at = np.arange(len(x))
    if near:
        keep = _spared(y, y_ids, k)
        y, y_ids = y[keep], y_ids[keep]
        f = int(np.argmax(y.max(axis=0) - y.min(axis=0)))
        at, order = np.argsort(x[:, f], kind="stable"), np.argsort(y[:, f], kind="stable")
        y, y_ids = y[order], y_ids[order]
        b, y_norm = right(y)
        starts = np.arange(0, len(y), RIGHT)
        low, high = y[starts, f], y[np.minimum(starts + RIGHT, len(y)) - 1, f]
    out = []
    for lo in range(0, len(x), LEFT):
        rows = at[lo : lo + LEFT]
        best, ids = np.full((len(rows), k), np.inf), np.zeros((len(rows), k), np.int64)
        pieces = range(0, len(y), RIGHT)
        if near:
            a, x_norm = left(x[rows])
            room = slack(x.shape[1], x_norm, y_norm)
            ends = x[rows[0], f], x[rows[-1], f]
            gap = np.maximum(0, np.maximum(low - ends[1], ends[0] - high))
            visit = np.lexsort((np.abs(low + high - ends[0] - ends[1]), gap))
            pieces = starts[visit]
        for n, begin in enumerate(pieces):
            theirs = y_ids[begin : begin + RIGHT]
            if near:
                most = best[:, -1] ** 2 if m.name == "L2" else best[:, -1]
                most = most * (1 + 1e-14) + room
                if gap[visit[n]] ** 2 * (1 - 1e-14) > most.max():
                    break
                d = squares(a, b[begin : begin + RIGHT])
            else:
                d = sign * block_distance(m, x[rows], y[begin : begin + RIGHT], prior)
                d, most = np.where(np.isfinite(d), d, np.inf), best[:, -1]
            none = np.isinf(best[:, -1])
            if none.any() and len(theirs) > k + 1:  # one of k + 1 may be the row itself
                bound = np.partition(d[none], k, axis=1)[:, k]
                most = most.copy()
                most[none] = bound + 1e-14 * np.abs(bound) + 2 * room[none] if near else bound
            i, j = places(d <= most[:, None])
            other = x_ids[rows[i]] != theirs[j]
            i, j = i[other], j[other]
            if not len(i):
                continue
            own_d = np.concatenate([own(m, x[rows[i[s : s + PAIRS]]], y[begin + j[s : s + PAIRS]]) for s in range(0, len(i), PAIRS)]) if near else d[i, j]
            i, own_d, found = np.concatenate([np.repeat(np.arange(len(rows)), k), i]), np.concatenate([best.ravel(), own_d]), np.concatenate([ids.ravel(), theirs[j]])
            sort = np.lexsort((found, own_d, i))
            first = np.searchsorted(i[sort], np.arange(len(rows)))
            take = sort[(first[:, None] + np.arange(k)).ravel()]
            best, ids = own_d[take].reshape(-1, k), found[take].reshape(-1, k)
        ok = np.isfinite(best)
        out.append((np.repeat(rows, k)[ok.ravel()], ids[ok], best[ok]))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))
