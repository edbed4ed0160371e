"""Clusters of clusters: every node of more than radix rows is split, with a bounded number of jobs a level over all its nodes.

A node of at most ``LOCAL_VALUES`` values is split to its end by one task; larger ones are split together, their centers sent to
every worker in blocks of bounded size.  Both ways run the same steps, those of ``kmeanspp`` and ``hard``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centrova.functions.draws import PRIME
from centrova.functions.measures import block_distance, measure
from centrova.operators.centroids import update
from centrova.operators.pairwise import matrix_of
from centrova.plans.iterate import CENTER_VALUES, saved

#: Values (rows * d) of a node that one task splits to its end.
LOCAL_VALUES = 1 << 18

Centers = dict[int, np.ndarray]
#: Of each node: how many rows to draw, the seed, and the ids that may not be drawn.
Wanted = dict[int, tuple[int, int, list[int]]]


def _uniform(ids: np.ndarray, round: int, seed: int) -> np.ndarray:
    """draws.uniform for arrays."""
    h1 = ((ids % PRIME + 1) * 1103515245 + round * 40692 + seed * 69621) % PRIME
    h2 = (h1 * h1 + round * 48271 + seed) % PRIME
    return ((h2 * 48271 + 11) % PRIME + 0.5) / 2147483647.0


def _nearest(m, x: np.ndarray, c: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    sign = -1.0 if m.similarity else 1.0
    d = sign * block_distance(m, x, c, prior)
    d = np.where(np.isnan(d), np.inf, d)
    best = d.argmin(axis=1)
    return best, sign * d[np.arange(len(d)), best]


def _best(m, x, w, ids, c, want: tuple[int, int, list[int]], round: int, prior: float, positive: bool) -> list[tuple[float, int, int]]:
    """(key, -id, place) of the rows drawn in proportion to weight, or to weight * cost if there are centers; then the lowest ids, unless positive."""
    n, seed, out = want
    left = w if c is None else w * _nearest(m, x, c, prior)[1]
    key = np.full(len(ids), -np.inf)
    some = left > 0
    key[some] = np.log(_uniform(ids[some], round, seed)) / left[some]
    may = ~np.isin(ids, out) & (some | (not positive))
    at = np.flatnonzero(may)
    at = at[np.lexsort((ids[at], -key[at]))[:n]]
    return [(float(key[i]), -int(ids[i]), int(i)) for i in at]


def _by_node(node: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(node, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
        yield int(node[at[0]]), at


class _Local:
    """The steps over one node, number 0, in memory."""

    def __init__(self, x, w, ids, which, prior):
        self.x, self.w, self.ids, self.m, self.prior = x, w, ids, measure(which), prior

    def draw(self, centers: Centers, want: Wanted, round: int, positive: bool = False) -> dict[int, list[tuple[int, np.ndarray]]]:
        found = _best(self.m, self.x, self.w, self.ids, centers.get(0), want[0], round, self.prior, positive)
        return {0: [(-i, self.x[at]) for _, i, at in found]}

    def costs(self, centers: Centers) -> dict[int, float]:
        return {0: float((self.w * _nearest(self.m, self.x, centers[0], self.prior)[1]).sum())}

    def updated(self, centers: Centers) -> Centers:
        c, kind, x = _nearest(self.m, self.x, centers[0], self.prior)[0], self.m.centroid, self.x
        k = len(centers[0])
        if self.m.probability and kind in ("mean", "geo_median") or kind == "tvd_median":
            whole = x.sum(axis=1, keepdims=True)
            x = np.where(whole > 0, x / np.where(whole > 0, whole, 1), 0.0)
        if kind == "mean":
            s, w = np.zeros((k, x.shape[1])), np.bincount(c, self.w, minlength=k)
            np.add.at(s, c, x * self.w[:, None])
            with np.errstate(invalid="ignore", divide="ignore"):
                return {0: s / w[:, None]}
        out = np.full((k, x.shape[1]), np.nan)
        if kind != "geo_median":
            for i in np.unique(c):
                out[i] = np.median(x[c == i], axis=0)
            return {0: out}
        at, before = centers[0].copy(), np.inf
        for _ in range(100):  # as centroids.geometric_medians
            dist = np.linalg.norm(x - at[c], axis=1)
            v = self.w / np.maximum(dist, 1e-30)
            s, cost = np.zeros_like(at), float((self.w * dist).sum())
            np.add.at(s, c, x * v[:, None])
            total = np.bincount(c, v, minlength=k)
            if before - cost <= 1e-6 * max(cost, 1e-300) and before < np.inf:
                break
            at[total > 0], before = s[total > 0] / total[total > 0, None], cost
        out[np.unique(c)] = at[np.unique(c)]
        return {0: out}


class _Spread:
    """The steps over many nodes at once; rows: node, path, id, features, weight."""

    def __init__(self, rows: DataFrame, radix: int, nodes: list[int], which, prior):
        self.rows, self.radix, self.nodes, self.which, self.prior = rows, radix, nodes, which, prior

    def draw(self, centers: Centers, want: Wanted, round: int, positive: bool = False) -> dict[int, list[tuple[int, np.ndarray]]]:
        sent, m, prior = self.rows.sparkSession.sparkContext.broadcast((centers, want)), measure(self.which), self.prior

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centers, want = sent.value
            top: dict[int, list[tuple[float, int, np.ndarray]]] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                ids, x, w = b.column(1).to_numpy(), matrix_of(b.column(2)), b.column(3).to_numpy()
                for v, at in _by_node(b.column(0).to_numpy()):
                    if v in want:
                        found = _best(m, x[at], w[at], ids[at], centers.get(v), want[v], round, prior, positive)
                        both = top.get(v, []) + [(key, i, x[at[p]]) for key, i, p in found]
                        top[v] = sorted(both, key=lambda t: t[:2], reverse=True)[: want[v][0]]
            flat = [(v, *t) for v, ts in top.items() for t in ts]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in flat], pa.int32()), pa.array([t[1] for t in flat], pa.float64()), pa.array([t[2] for t in flat], pa.int64()), pa.array([t[3] for t in flat], pa.list_(pa.float64()))], ["node", "key", "back", "features"])

        most = max(n for n, _, _ in want.values())
        drawn = self.rows.select("node", "id", "features", "weight").mapInArrow(run, "node int, key double, back long, features array<double>")
        best = drawn.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("key", "back", "features")), False), 1, most).alias("top"))
        return {r["node"]: [(-t["back"], np.array(t["features"], float)) for t in r["top"][: want[r["node"]][0]]] for r in best.collect()}

    def assigned(self, centers: Centers) -> DataFrame:
        """node, path, id, features, weight, cid (within the node), cost of the rows of the nodes that have centers."""
        sent, m, prior = self.rows.sparkSession.sparkContext.broadcast(centers), measure(self.which), self.prior

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centers = sent.value
            for b in batches:
                if not b.num_rows:
                    continue
                x, cid, cost, has = matrix_of(b.column(3)), np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
                for v, at in _by_node(b.column(0).to_numpy()):
                    if v in centers:
                        cid[at], cost[at] = _nearest(m, x[at], centers[v], prior)
                        has[at] = True
                out = pa.RecordBatch.from_arrays([*b.columns, pa.array(cid), pa.array(cost)], [*b.schema.names, "cid", "cost"])
                yield out.filter(pa.array(has))

        own = self.rows.select("node", "path", "id", "features", "weight")
        return own.mapInArrow(run, "node int, path array<int>, id long, features array<double>, weight double, cid int, cost double")

    def costs(self, centers: Centers) -> dict[int, float]:
        own = self.assigned(centers).groupBy("node").agg(F.sum(F.col("weight") * F.col("cost")).alias("c"))
        return {r["node"]: r["c"] for r in own.collect()}

    def updated(self, centers: Centers) -> Centers:
        d, first = len(next(iter(centers.values()))[0]), self.nodes[0]
        start = np.full((len(self.nodes) * self.radix, d), np.nan)
        for v, c in centers.items():
            start[(v - first) * self.radix :][: len(c)] = c
        members = self.assigned(centers).withColumn("cid", ((F.col("node") - first) * self.radix + F.col("cid")).cast("int"))
        new = update(members, len(start), self.which, start)
        return {v: new[(v - first) * self.radix :][: len(c)] for v, c in centers.items()}


def _centers(rows: _Local | _Spread, nodes: list[int], radix: int, seeds: dict[int, int], which, seed: int, eps: float = 1e-4, max_iterations: int = 10) -> Centers:
    """Of each node what kmeanspp with its seed and then hard end with."""
    ids: dict[int, list[int]] = {v: [] for v in nodes}
    at: Centers = {}
    for r in range(radix):
        for v, drawn in rows.draw(at, {v: (1, seeds[v], ids[v]) for v in nodes}, r).items():
            for i, x in drawn:
                ids[v].append(i)
                at[v] = np.vstack([at[v], x]) if v in at else x[None]
    shares = measure(which).probability
    cost = rows.costs(at)
    active = {v for v in nodes if cost[v] != 0}
    for it in range(max_iterations):
        if not active:
            break
        new = rows.updated({v: at[v] for v in sorted(active)})
        empty = {v: np.isnan(c).any(axis=1) for v, c in new.items()}
        want = {v: (int(e.sum()), seed, []) for v, e in empty.items() if e.any()}
        if want:
            drawn = rows.draw({v: new[v][~empty[v]] for v in want}, want, 20_000 + it, positive=True)
            for v in want:
                for i, (_, x) in zip(np.flatnonzero(empty[v]), drawn.get(v, []), strict=False):
                    new[v][i] = x / x.sum() if shares and x.sum() > 0 else x
                new[v] = new[v][~np.isnan(new[v]).any(axis=1)]
        now = rows.costs(new)
        for v in sorted(active):
            if now[v] > cost[v] and v not in want:
                active.discard(v)
                continue
            at[v], before, cost[v] = new[v], cost[v], now[v]
            if cost[v] == 0 or v not in want and before - cost[v] < eps * max(before, cost[v]):
                active.discard(v)
    return at


def _seed(path: tuple[int, ...], seed: int) -> int:
    return seed + 31 * (len(path) + 1) + sum(path)


def _whole(g: pd.DataFrame, radix: int, which, prior: float, seed: int) -> pd.DataFrame:
    """All leaves below one node."""
    g = g.sort_values("id", ignore_index=True)
    x, w, ids = np.stack(g["features"].to_numpy()).astype(float), g["weight"].to_numpy(float), g["id"].to_numpy(np.int64)
    m, leaves = measure(which), [()] * len(ids)
    todo = [(tuple(int(c) for c in g["path"].iloc[0]), np.arange(len(ids)))]
    while todo:
        path, at = todo.pop()
        own = _Local(x[at], w[at], ids[at], which, prior)
        cid = _nearest(m, own.x, _centers(own, [0], radix, {0: _seed(path, seed)}, which, seed)[0], prior)[0]
        found = np.unique(cid)
        for c in found.tolist():
            part, below = at[cid == c], (*path, c)
            if len(part) > radix and len(found) > 1:
                todo.append((below, part))
            else:
                for i in part:
                    leaves[i] = below
    return pd.DataFrame({"node_path": [list(p) for p in leaves], "depth": np.array([len(p) for p in leaves], np.int32), "id": ids})


def leaves(points: DataFrame, radix: int, which="SQRL2", prior: float = 0.0, seed: int = 0) -> DataFrame:
    """node_path, depth, id of every row: the cluster that has at most radix rows or whose node could not be split."""
    spark = points.sparkSession
    rows = saved(points.select(F.lit(0).alias("node"), F.array().cast("array<int>").alias("path"), "id", "features", "weight"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).first()
    d = max(1, size["d"] or 1)
    local: list[DataFrame] = []
    done: list[DataFrame] = []
    paths: dict[int, tuple[int, ...]] = {0: ()}
    if size["n"] * d <= LOCAL_VALUES:
        local, paths = [rows.select("path", "id", "features", "weight")], {}
    while paths:
        step, split = max(1, CENTER_VALUES // (radix * d)), []
        for lo in range(0, len(paths), step):
            nodes = list(range(lo, min(lo + step, len(paths))))
            own = _Spread(rows.filter(F.col("node").between(nodes[0], nodes[-1])), radix, nodes, which, prior)
            split.append(own.assigned(_centers(own, nodes, radix, {v: _seed(paths[v], seed) for v in nodes}, which, seed)).drop("cost"))
        cut = split[0]
        for x in split[1:]:
            cut = cut.unionByName(x)
        cut = saved(cut)
        sizes = {(r["node"], r["cid"]): r["count"] for r in cut.groupBy("node", "cid").count().collect()}  # radix rows a node
        parts: dict[int, int] = {}
        for v, _ in sizes:
            parts[v] = parts.get(v, 0) + 1
        large, kinds = {}, []
        for (v, c), n in sorted(sizes.items()):
            kind = -2 if n <= radix or parts[v] == 1 else -1 if n * d <= LOCAL_VALUES else len(large)
            if kind >= 0:
                large[kind] = (*paths[v], c)
            kinds.append((v, c, kind))
        below = spark.createDataFrame(kinds, "node int, cid int, next int")
        rows = saved(cut.join(F.broadcast(below), ["node", "cid"]).select(F.col("next").alias("node"), F.concat("path", F.array("cid")).alias("path"), "id", "features", "weight"))
        done.append(rows.filter("node = -2").select(F.col("path").alias("node_path"), F.size("path").alias("depth"), "id"))
        local.append(rows.filter("node = -1").select("path", "id", "features", "weight"))
        rows, paths = rows.filter("node >= 0"), large

    for x in local[1:]:
        local[0] = local[0].unionByName(x)
    schema = "node_path array<int>, depth int, id long"
    out = local[0].groupBy("path").applyInPandas(lambda g: _whole(g, radix, which, prior, seed), schema)
    for x in done:
        out = out.unionByName(x)
    return out
