"""Distances, medians and geometric medians of sparse rows (id, idx, val, dim), without making them dense.

A measure that is a sum over places splits into the places of the left row, those of the right row alone, and those that are zero in
both, which all have one term; so a pair costs as much as its entries, whatever the dimension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from centrova.functions.measures import measure
from centrova.operators.pairwise import BLOCK_ROWS
from centrova.plans.iterate import saved


@dataclass
class Rows:
    """Sparse rows: the entries of row i are ptr[i] .. ptr[i + 1]."""

    ptr: np.ndarray
    idx: np.ndarray
    val: np.ndarray
    dim: int

    def __len__(self) -> int:
        return len(self.ptr) - 1

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.ptr))

    def sums(self) -> np.ndarray:
        return np.bincount(self.row, self.val, minlength=len(self))

    @staticmethod
    def of(idx: pa.Array, val: pa.Array, dim: int) -> Rows:
        size = idx.value_lengths().to_numpy(zero_copy_only=False) if len(idx) else np.zeros(0, np.int64)
        return Rows(np.concatenate([[0], np.cumsum(size)]).astype(np.int64), idx.flatten().to_numpy(zero_copy_only=False).astype(np.int64), val.flatten().to_numpy(zero_copy_only=False).astype(float), dim)

    @staticmethod
    def of_dense(x: np.ndarray) -> Rows:
        x = np.atleast_2d(np.asarray(x, float))
        row, idx = np.nonzero(x)
        return Rows(np.searchsorted(row, np.arange(len(x) + 1)), idx, x[row, idx], x.shape[1])


def _xlog(a, b):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(a <= 0, 0.0, np.where(b <= 0, np.inf, a * np.log(a / b)))


def _is(a, b):
    with np.errstate(divide="ignore", invalid="ignore"):
        v = a / b - np.log(a / b) - 1
    return np.where((a <= 0) & (b <= 0), 0.0, np.where((a <= 0) | (b <= 0), np.inf, v))


def _weighed(a, b, share):
    r = share * a + (1 - share) * b
    return share * _xlog(a, r) + (1 - share) * _xlog(b, r)


def _same(t, sx, sy):
    return t


def _root(t, sx, sy):
    return np.sqrt(np.maximum(t, 0))


def _power(p: float) -> tuple:
    return (lambda a, b, s: np.abs(a - b) ** p), (lambda t, sx, sy: t ** (1 / p))


_SQ = lambda a, b, s: (a - b) ** 2
_JSD = lambda a, b, s: 0.5 * (_xlog(a, (a + b) / 2) + _xlog(b, (a + b) / 2))
_OVER = lambda a, b, s: np.sqrt(np.maximum(a, 0) * np.maximum(b, 0))
#: Measure: (term of a place of point and center, what the sum of terms gives); s is the point's share of both sums.
TERMS: dict[str, tuple[Callable, Callable]] = {
    "L1": (lambda a, b, s: np.abs(a - b), _same), "SQRL1": (lambda a, b, s: np.abs(a - b), lambda t, sx, sy: t**2),
    "SQRL2": (_SQ, _same), "L2": (_SQ, _root), "PSL2": (_SQ, _same), "PL2": (_SQ, _root),
    "L3": _power(3), "L4": _power(4), "SQRL3": (_power(3)[0], lambda t, sx, sy: t ** (2 / 3)), "SQRL4": (_power(4)[0], _root),
    "JSD": (_JSD, _same), "JSM": (_JSD, _root),
    "MKL": (lambda a, b, s: _xlog(a, b), _same), "REVERSE_MKL": (lambda a, b, s: _xlog(b, a), _same),
    "HELLINGER": (lambda a, b, s: (np.sqrt(a) - np.sqrt(b)) ** 2, _root),
    "BHATTACHARYYA_METRIC": (_OVER, lambda t, sx, sy: np.sqrt(np.maximum(1 - t, 0))),
    "BHATTACHARYYA_DISTANCE": (_OVER, lambda t, sx, sy: -np.log(np.maximum(t, 1e-300))),
    "TVD": (lambda a, b, s: np.abs(a - b) / 2, _same),
    "UWLLR": (_weighed, _same), "LLR": (_weighed, lambda t, sx, sy: t * (sx + sy)),
    "SRULRT": (_weighed, _root), "SRLRT": (_weighed, lambda t, sx, sy: np.sqrt(np.maximum(t * (sx + sy), 0))),
    "ITAKURA_SAITO": (lambda a, b, s: _is(a, b), _same), "REVERSE_ITAKURA_SAITO": (lambda a, b, s: _is(b, a), _same),
    "SYMMETRIC_ITAKURA_SAITO": (lambda a, b, s: (_is(a, (a + b) / 2) + _is(b, (a + b) / 2)) / 2, _same),
    "RSYMMETRIC_ITAKURA_SAITO": (lambda a, b, s: (_is((a + b) / 2, a) + _is((a + b) / 2, b)) / 2, _same),
}


def _cosine(x: Rows, y: Rows, place: np.ndarray) -> np.ndarray:
    norm = lambda r: np.sqrt(np.bincount(r.row, r.val**2, minlength=len(r)))
    nx, ny, out = norm(x), norm(y), np.zeros((len(x), len(y)))
    for j in range(len(y)):
        e = slice(y.ptr[j], y.ptr[j + 1])
        place[y.idx[e]] = y.val[e]
        out[:, j] = np.bincount(x.row, x.val * place[x.idx], minlength=len(x))
        place[y.idx[e]] = 0.0
    both = nx[:, None] * ny[None]
    return np.where(both > 0, np.clip(out / np.where(both > 0, both, 1), -1, 1), 0.0)


def block_distance(which, x: Rows, y: Rows, prior: float = 0.0) -> np.ndarray:
    """The measure of every sparse row of x (points) and of y (centers), in time by their entries."""
    m, d = measure(which), x.dim
    place = np.zeros(d)  # the right row at hand, by place
    if m.name in ("COSINE_DISTANCE", "COSINE_SIMILARITY"):
        cos = _cosine(x, y, place)
        return cos if m.similarity else np.arccos(cos) / np.pi
    if m.name in ("LINF", "SQRLINF") or m.name not in TERMS:
        from centrova.functions import measures

        return measures.block_distance(m, _dense(x), _dense(y), prior)
    term, finish = TERMS[m.name]
    sx, sy = x.sums(), y.sums()
    if m.probability:
        beta = 1.0 / d if prior < 0 else prior
        wx, wy = sx + beta * d, sy + beta * d
        inv = lambda w: np.where(w > 0, 1 / np.where(w > 0, w, 1), 0.0)
        ix, iy = inv(wx), inv(wy)
    else:
        beta, ix, iy = 0.0, np.ones(len(x)), np.ones(len(y))
    row, n = x.row, len(x)
    a, zero_a = (x.val + beta) * ix[row], beta * ix
    here, out = np.zeros(d, bool), np.zeros((n, len(y)))
    for j in range(len(y)):
        e = slice(y.ptr[j], y.ptr[j + 1])
        idx = y.idx[e]
        b, zero_b = (y.val[e] + beta) * iy[j], beta * iy[j]
        both = sx + sy[j]
        share = np.where(both > 0, sx / np.where(both > 0, both, 1), 0.5)
        place[:] = zero_b
        place[idx], here[idx] = b, True
        shared = here[x.idx]
        total = np.bincount(row, term(a, place[x.idx], share[row]), minlength=n)
        # places of the center alone: all of its places, less those that the point has too
        alone = term(zero_a[:, None], b[None], share[:, None]).sum(axis=1) if len(b) else np.zeros(n)
        s = np.flatnonzero(shared)
        alone = alone - np.bincount(row[s], term(zero_a[row[s]], place[x.idx[s]], share[row[s]]), minlength=n)
        neither = d - np.diff(x.ptr) - len(idx) + np.bincount(row[s], minlength=n)
        rest = np.where(neither > 0, neither * term(zero_a, np.full(n, zero_b), share), 0.0)
        if np.isinf(alone).any() or np.isnan(alone).any():  # an infinite term taken away again
            from centrova.functions import measures

            return measures.block_distance(m, _dense(x), _dense(y), prior)
        out[:, j] = total + alone + rest
        here[idx] = False
    return finish(out, sx[:, None], sy[None])


def _dense(r: Rows) -> np.ndarray:
    out = np.zeros((len(r), r.dim))
    out[r.row, r.idx] = r.val
    return out


def dimension(sparse: DataFrame) -> int:
    return sparse.agg(F.max("dim").alias("d")).first()["d"] or 0


def compare(matrix: DataFrame, data: DataFrame, which="SQRL2", prior: float = 0.0, reverse: bool = False) -> DataFrame:
    """i, j, dist of sparse rows, as ``pairwise.compare`` of dense ones.

    A side of up to ``BLOCK_ROWS`` rows goes to every task over the other; above that both are cut in blocks that meet in tiles.
    """
    m, d = measure(which), max(dimension(matrix), dimension(data))

    def pairs(ii: np.ndarray, a: Rows, jj: np.ndarray, c: Rows) -> pa.RecordBatch:
        dist = block_distance(m, a, c, prior) if reverse else block_distance(m, c, a, prior).T
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ii, len(jj))), pa.array(np.tile(jj, len(ii))), pa.array(dist.ravel())], ["i", "j", "dist"])

    if data.limit(BLOCK_ROWS + 1).count() <= BLOCK_ROWS:
        few = data.select("id", "idx", "val").orderBy("id").toArrow().combine_chunks()  # bounded by BLOCK_ROWS
        few = few.to_batches()[0] if few.num_rows else None
        sent = matrix.sparkSession.sparkContext.broadcast(None if few is None else (few.column(0).to_numpy(), Rows.of(few.column(1), few.column(2), d)))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if sent.value is None:
                return
            jj, c = sent.value
            for b in batches:
                for lo in range(0, b.num_rows, 2048):
                    part = b.slice(lo, 2048)
                    yield pairs(part.column(0).to_numpy(), Rows.of(part.column(1), part.column(2), d), jj, c)

        return matrix.select("id", "idx", "val").mapInArrow(near, "i long, j long, dist double")

    def blocks(df: DataFrame, name: str) -> DataFrame:
        n = -(-df.count() // BLOCK_ROWS)
        g = df.groupBy(F.pmod(F.xxhash64("id"), F.lit(max(n, 1))).alias(f"{name}b")).agg(F.sort_array(F.collect_list(F.struct("id", "idx", "val"))).alias("r"))
        return g.select(F.col("r.id").alias(f"{name}i"), F.col("r.idx").alias(f"{name}x"), F.col("r.val").alias(f"{name}v"))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in range(b.num_rows):
                ii, jj = b.column(0)[t].values.to_numpy(), b.column(3)[t].values.to_numpy()
                a, c = Rows.of(b.column(1)[t].values, b.column(2)[t].values, d), Rows.of(b.column(4)[t].values, b.column(5)[t].values, d)
                yield pairs(ii, a, jj, c)

    return blocks(matrix, "l").join(blocks(data, "r")).mapInArrow(tile, "i long, j long, dist double")


def self_pairs(matrix: DataFrame, which="SQRL2", prior: float = 0.0) -> DataFrame:
    """i, j, dist for i < j of sparse rows."""
    return compare(matrix, matrix, which, prior, reverse=True).filter("i < j")


def assign(points: DataFrame, centers: np.ndarray, which="SQRL2", prior: float = 0.0) -> DataFrame:
    """All columns of sparse points, and cid, cost of the nearest of the centers, given as a dense array."""
    m, names = measure(which), points.columns
    sign, c = (-1.0 if m.similarity else 1.0), Rows.of_dense(centers)
    sent = points.sparkSession.sparkContext.broadcast(c)
    at = [names.index(x) for x in ("idx", "val")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                d = sign * block_distance(m, Rows.of(part.column(at[0]), part.column(at[1]), sent.value.dim), sent.value, prior)
                d = np.where(np.isnan(d), np.inf, d)
                best = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best.astype(np.int32)), pa.array(sign * d[np.arange(len(d)), best])], [*names, "cid", "cost"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema) + ", cid int, cost double"
    return points.mapInArrow(run, schema)


def _entries(members: DataFrame, shares: bool) -> DataFrame:
    """cid, feature, value, weight of the entries that are not zero; shares: of rows over their sum."""
    whole = F.aggregate("val", F.lit(0.0), lambda a, v: a + v)
    val = F.when(whole != 0, F.transform("val", lambda v: v / whole)).otherwise(F.col("val")) if shares else F.col("val")
    e = members.withColumn("val", val).select("cid", "weight", F.explode(F.arrays_zip("idx", "val")).alias("e"))
    return e.select("cid", F.col("e.idx").alias("feature"), F.col("e.val").alias("value"), "weight").filter("value != 0")


def medians(members: DataFrame, shares: bool = False, weighted: bool = False) -> DataFrame:
    """cid, feature, value: medians by coordinate over (cid, idx, val, weight), with the zeros that are not stored; zero medians are not rows.

    Unweighted, the mean of the two middle values for an even number; weighted, the least value at which the weights of values up
    to it reach half of all.  Equal values are one row before any sort, and the zeros of a place are one more.
    """
    w = F.col("weight") if weighted else F.lit(1.0)
    own = members.select("cid", "idx", "val", w.alias("weight"))
    all = own.groupBy("cid").agg(F.sum("weight").alias("all"))
    v = _entries(own, shares).groupBy("cid", "feature", "value").agg(F.sum("weight").alias("w"))
    zeros = v.groupBy("cid", "feature").agg(F.sum("w").alias("s")).join(all, "cid").filter("all > s").select("cid", "feature", F.lit(0.0).alias("value"), (F.col("all") - F.col("s")).alias("w"))
    run = W.partitionBy("cid", "feature").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    c = v.unionByName(zeros).join(all, "cid").withColumn("cum", F.sum("w").over(run))
    if weighted:
        out = c.filter(F.col("cum") >= F.col("all") / 2).groupBy("cid", "feature").agg(F.min("value").alias("value"))
    else:
        lower, upper = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)  # places from 0
        low, high = F.min(F.when(F.col("cum") > lower, F.col("value"))), F.min(F.when(F.col("cum") > upper, F.col("value")))
        out = c.groupBy("cid", "feature").agg(((low + high) / 2).alias("value"))
    return out.filter("value != 0")


def geometric_medians(members: DataFrame, start: np.ndarray, eps: float = 1e-6, max_iterations: int = 100, floor: float = 1e-30) -> np.ndarray:
    """(k, d) geometric medians of sparse rows (cid, weight, idx, val) by Weiszfeld steps from start, in time by their entries."""
    from centrova.operators.centroids import added

    centers, before = np.array(start, float), np.inf
    k, d = centers.shape
    for _ in range(max_iterations):
        sent = members.sparkSession.sparkContext.broadcast(centers)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c0, acc, w_acc, cost = sent.value, np.zeros((k, d)), np.zeros(k), np.zeros(k)
            square = (c0**2).sum(axis=1)
            for b in batches:
                if not b.num_rows:
                    continue
                c, w, x = b.column(0).to_numpy(), b.column(1).to_numpy(), Rows.of(b.column(2), b.column(3), d)
                at = c0[c[x.row], x.idx]
                apart = np.bincount(x.row, (x.val - at) ** 2 - at**2, minlength=len(x)) + square[c]
                dist = np.sqrt(np.maximum(apart, 0))
                cost += np.bincount(c, w * dist, minlength=k)
                v = w / np.maximum(dist, floor)
                np.add.at(acc, (c[x.row], x.idx), x.val * v[x.row])
                w_acc += np.bincount(c, v, minlength=k)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(w_acc), pa.array([[*r, z] for r, z in zip(acc, cost, strict=True)], pa.list_(pa.float64()))], ["cid", "w", "s"])

        found = added(members.select("cid", "weight", "idx", "val").mapInArrow(run, "cid int, w double, s array<double>"))
        cost, new = 0.0, centers.copy()
        for cid, (w, s) in sorted(found.items()):
            cost += s[-1]
            if w > 0:
                new[cid] = s[:-1] / w
        if before - cost <= eps * max(cost, 1e-300) and before < np.inf:
            break
        centers, before = new, cost
    return centers


def hard(points: DataFrame, centers: np.ndarray, which="SQRL2", prior: float = 0.0, eps: float = 1e-4, max_iterations: int = 50) -> tuple[np.ndarray, DataFrame, list[float]]:
    """(centers, assigned points, costs) of Lloyd steps over sparse points (id, idx, val, dim, weight); empty clusters keep their center."""
    m, at = measure(which), np.asarray(centers, float)
    assigned = saved(assign(points, at, which, prior))
    total = lambda df: df.agg(F.sum(F.col("weight") * F.col("cost")).alias("c")).first()["c"] or 0.0
    costs = [total(assigned)]
    for _ in range(max_iterations):
        if m.centroid == "geo_median":
            new = geometric_medians(assigned, at)
        else:
            new = np.zeros_like(at)
            if m.centroid == "mean":
                own = assigned.groupBy("cid").agg(F.sum("weight").alias("all"))
                s = _entries(assigned.select("cid", "idx", "val", "weight"), m.probability).groupBy("cid", "feature").agg(F.sum(F.col("weight") * F.col("value")).alias("s"))
                rows = s.join(own, "cid").select("cid", "feature", (F.col("s") / F.col("all")).alias("value"))
            else:
                rows = medians(assigned, shares=m.centroid == "tvd_median")
            for r in rows.toLocalIterator():  # at most k * d values
                new[r["cid"], r["feature"]] = r["value"]
            filled = [r["cid"] for r in assigned.select("cid").distinct().collect()]
            new = np.where(np.isin(np.arange(len(at)), filled)[:, None], new, at)
        again = saved(assign(points, new, which, prior))
        cost = total(again)
        if cost > costs[-1]:
            break
        at, assigned = new, again
        costs.append(cost)
        if costs[-2] - cost < eps * max(costs[-2], cost):
            break
    return at, assigned, costs
