"""Selection of centers among the rows: k-means++ and its variants, farthest-point selection, sampling with pruning."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centrova.functions.draws import race, uniform
from centrova.functions.measures import block_distance, measure
from centrova.operators.pairwise import assign, matrix_of
from centrova.plans.iterate import saved


@dataclass
class Seeds:
    """Ids of the chosen rows in order, their features, and the summed cost of all rows under them."""

    ids: list[int]
    centers: np.ndarray
    cost: float


#: Steps of an incremental seeding after which costs are saved; in between, rows meet the centers since then alone.
EVERY = 16


def id_frame(points: DataFrame, ids: list[int]) -> DataFrame:
    """place, id of chosen rows, in their order."""
    return points.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "place long, id long")


def rows_of(points: DataFrame, ids: list[int]) -> np.ndarray:
    """The features of the rows of these ids, in their order; a join, so that no plan holds the ids."""
    found = {r["id"]: r["features"] for r in points.join(F.broadcast(id_frame(points, list(dict.fromkeys(ids)))), "id").select("id", "features").collect()}
    return np.array([found[i] for i in ids], float)


def _with_cost(points: DataFrame, centers: np.ndarray, which, prior: float) -> DataFrame:
    return assign(points, centers, which, prior)


class Nearest:
    """The cost of every row under centers that grow one by one: each is compared with the rows once, not once a step.

    Between saves (every ``EVERY`` centers) only the centers since the last one are looked at again, and costs meet what was saved.
    """

    def __init__(self, points: DataFrame, which, prior: float):
        self.which, self.prior = which, prior
        self.columns = points.columns
        self.base = points.withColumn("cost", F.lit(float("inf"))).withColumn("chosen", F.lit(False))
        self.ids: list[int] = []
        self.rows: list[np.ndarray] = []

    def add(self, ids: list[int], rows: np.ndarray) -> None:
        if len(self.ids) >= EVERY:
            self.base, self.ids, self.rows = saved(self.costed()), [], []
        self.ids += [int(i) for i in ids]
        self.rows += list(np.asarray(rows, float))

    def costed(self) -> DataFrame:
        """The points with cost (the least so far) and whether they are chosen themselves."""
        m, prior, names = measure(self.which), self.prior, self.base.columns
        if not self.rows:
            return self.base
        if m.block is None:
            raise ValueError("give a named measure")
        at, id_at = names.index("features"), names.index("id")
        sent = self.base.sparkSession.sparkContext.broadcast((np.array(self.ids), np.array(self.rows)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, c = sent.value
            step = max(1, 2_000_000 // max(1, c.shape[1], len(c)))
            for b in batches:
                for lo in range(0, b.num_rows, step):
                    part = b.slice(lo, step)
                    d = block_distance(m, matrix_of(part.column(at)), c, prior)
                    d = np.where(np.isnan(d), np.inf, d).min(axis=1)
                    cost = np.minimum(part.column(names.index("cost")).to_numpy(), d)
                    own = part.column(names.index("chosen")).to_numpy(zero_copy_only=False) | np.isin(part.column(id_at).to_numpy(), ids)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(cost), pa.array(own)], names)

        return self.base.mapInArrow(run, self.base.schema)


def _draw(df: DataFrame, weight, n: int, round: int, seed: int) -> list[int]:
    u = uniform(F.col("id"), round, seed)
    return [r["id"] for r in df.filter(weight > 0).select("id", race(weight, u).alias("r")).orderBy(F.desc("r"), "id").limit(n).collect()]


def _draw_rows(df: DataFrame, weight, n: int, round: int, seed: int) -> tuple[list[int], np.ndarray]:
    """``_draw``, with the features of the rows drawn, in one job."""
    u = uniform(F.col("id"), round, seed)
    rows = df.filter(weight > 0).select("id", "features", race(weight, u).alias("r")).orderBy(F.desc("r"), "id").limit(n).collect()
    return [r["id"] for r in rows], np.array([r["features"] for r in rows], float)


def total_cost(assigned: DataFrame) -> float:
    return assigned.agg(F.sum(F.col("weight") * F.col("cost")).alias("c")).first()["c"] or 0.0


def kmeanspp(points: DataFrame, k: int, which="SQRL2", prior: float = 0.0, seed: int = 0, candidates: int = 1) -> Seeds:
    """k rows, each drawn in proportion to weight times the cost that is left; of several candidates the one that leaves least.

    A step reads the points once and compares them with the newest centers alone; it needs no shuffle.
    Zero cost everywhere ends in the lowest ids not yet chosen; k above the number of rows gives all rows.
    """
    k = min(k, points.count())
    if k == 0:
        return Seeds([], np.zeros((0, 0)), 0.0)
    ids, first = _draw_rows(points, F.col("weight"), 1, 0, seed)
    near, centers = Nearest(points, which, prior), list(first)
    near.add(ids, first)
    for r in range(1, k):
        costed = near.costed()
        left = F.when(F.col("chosen"), F.lit(0.0)).otherwise(F.col("weight") * F.col("cost"))
        drawn, here = _draw_rows(costed, left, candidates, r, seed)
        if not drawn:
            lowest = costed.filter("not chosen").orderBy("id").limit(1).select("id", "features").collect()
            drawn, here = [x["id"] for x in lowest], np.array([x["features"] for x in lowest], float)
        if len(drawn) > 1:
            from centrova.operators.clustering import costs_against

            best = int(np.argmin(costs_against(costed, here, which, prior)))
            drawn, here = [drawn[best]], here[best : best + 1]
        ids.append(drawn[0])
        centers.append(here[0])
        near.add(drawn, here)
    return Seeds(ids, np.array(centers), total_cost(near.costed()))


def best_of(points: DataFrame, k: int, tries: int, which="SQRL2", prior: float = 0.0, seed: int = 0, candidates: int = 1) -> Seeds:
    """The cheapest of several seedings (the first on ties)."""
    return min((kmeanspp(points, k, which, prior, seed + 7919 * t, candidates) for t in range(max(1, tries))), key=lambda s: s.cost)


def local_search_swaps(points: DataFrame, seeds: Seeds, rounds: int, which="SQRL2", prior: float = 0.0, seed: int = 0) -> Seeds:
    """Rounds of: draw a row in proportion to cost, swap it for the center whose loss costs least, if that lowers the cost.

    With the best and second best cost of each row the change for every center is one aggregation.
    """
    ids, centers = list(seeds.ids), seeds.centers.copy()
    for r in range(rounds):
        costed = assign(points, centers, which, prior, second=len(centers) > 1)
        own = costed.join(F.broadcast(id_frame(points, ids).select("id")), "id", "left_anti")
        drawn = _draw(own, F.col("weight") * F.col("cost"), 1, 10_000 + r, seed)
        if not drawn or len(centers) < 2:
            break
        row = rows_of(points, drawn)
        change = swap_changes(costed, row, which, prior)
        now = sum(change["gain"])
        deltas = [now + loss for loss in change["loss"]]
        out = int(np.argmin(deltas))
        if deltas[out] < 0:
            ids[out] = drawn[0]
            centers[out] = row[0]
    return Seeds(ids, centers, total_cost(assign(points, centers, which, prior)))


def swap_changes(costed: DataFrame, row: np.ndarray, which, prior: float) -> dict[str, list[float]]:
    """What a new center does: gain, the (negative) change where it is nearer, and loss by center if that center goes besides."""
    k = costed.agg(F.max(F.greatest("cid", "cid2")).alias("k")).first()["k"] + 1
    near = assign(costed.select("id", "weight", "features", F.col("cid").alias("c1"), F.col("cost").alias("d1"), F.col("cost2").alias("d2")), row, which, prior)
    gain = F.least(F.col("cost") - F.col("d1"), F.lit(0.0)) * F.col("weight")
    loss = (F.least(F.col("cost"), F.col("d2")) - F.least(F.col("cost"), F.col("d1"))) * F.col("weight")
    found = near.groupBy("c1").agg(F.sum(gain).alias("g"), F.sum(loss).alias("l")).collect()
    out = [0.0] * k
    for x in found:
        out[x["c1"]] = x["l"]
    return {"gain": [x["g"] for x in found], "loss": out}


def kmc2(points: DataFrame, k: int, chain: int = 2000, which="SQRL2", prior: float = 0.0, seed: int = 0) -> Seeds:
    """Seeding by Markov chains: per center one job draws a uniform sample with its costs, and the chain runs on the driver."""
    n = points.count()
    k = min(k, n)
    ids = _draw(points, F.col("weight"), 1, 0, seed) if k else []
    for r in range(1, k):
        rng = np.random.default_rng(seed * 1_000_003 + r)
        u = uniform(F.col("id"), r, seed)
        few = points.withColumn("__u", u).orderBy("__u").limit(chain).drop("__u")
        rows = sorted((x["id"], x["weight"] * x["cost"]) for x in _with_cost(few, rows_of(points, ids), which, prior).select("id", "weight", "cost").collect())
        rows = [x for x in rows if x[0] not in ids]
        if not rows:
            break
        order = rng.permutation(len(rows))
        at = rows[order[0]]
        for i in order[1:]:
            y = rows[i]
            if at[1] <= 0 or rng.random() < y[1] / at[1]:
                at = y
        ids.append(at[0])
    centers = rows_of(points, ids)
    return Seeds(ids, centers, total_cost(_with_cost(points, centers, which, prior)))


def kcenter(points: DataFrame, k: int, which="L2", prior: float = 0.0, seed: int = 0, outliers: float = 0.0, slack: float = 1.5, first: int | None = None) -> Seeds:
    """Farthest-point selection; with outliers, each next center is a uniform draw among the ceil((1 + slack) * outliers * n) farthest."""
    n = points.count()
    k = min(k, n)
    if k == 0:
        return Seeds([], np.zeros((0, 0)), 0.0)
    ids, near = [first] if first is not None else _draw(points, F.lit(1.0), 1, 0, seed), Nearest(points, which, prior)
    centers = list(rows_of(points, ids))
    near.add(ids, np.array(centers))
    pool = max(1, math.ceil((1 + slack) * outliers * n)) if outliers else 1
    for r in range(1, k):
        costed = near.costed().filter("not chosen")
        top = costed.orderBy(F.desc("cost"), "id").limit(pool)
        if pool == 1:
            rows = top.select("id", "features").collect()
            far, here = [rows[0]["id"]], np.array([rows[0]["features"]], float)
        else:
            far, here = _draw_rows(saved(top), F.lit(1.0), 1, r, seed)
        ids += far
        centers += list(here)
        near.add(far, here)
    return Seeds(ids, np.array(centers), near.costed().agg(F.max("cost").alias("m")).first()["m"])


def best_kcenter(points: DataFrame, k: int, tries: int, **more) -> Seeds:
    """Of several selections the one whose farthest row is nearest."""
    seed = more.pop("seed", 0)
    return min((kcenter(points, k, seed=seed + 7919 * t, **more) for t in range(max(1, tries))), key=lambda s: s.cost)


@dataclass
class Bicriteria:
    seeds: Seeds
    assigned: DataFrame
    outliers: DataFrame
    threshold: float


def kcenter_bicriteria(points: DataFrame, gamma: float, rounds: int, eta: float = 0.1, slack: float = 0.5, which="L2", prior: float = 0.0, seed: int = 0) -> Bicriteria:
    """More centers than asked for, few outliers: after a uniform sample of ceil(ln(1/eta) / (1 - gamma)) rows, each round samples as many of the farthest."""
    n = points.count()
    per_round = max(1, math.ceil(math.log(1 / eta) / (1 - gamma)))
    pool = max(1, math.ceil((1 + slack) * gamma * n))
    ids, near = _draw(points, F.lit(1.0), per_round, 0, seed), Nearest(points, which, prior)
    near.add(ids, rows_of(points, ids))
    for r in range(1, rounds + 1):
        costed = near.costed().filter("not chosen")
        drawn = _draw(saved(costed.orderBy(F.desc("cost"), "id").limit(pool)), F.lit(1.0), per_round, r, seed)
        if not drawn:
            break
        ids += drawn
        near.add(drawn, rows_of(points, drawn))
    ids = list(dict.fromkeys(ids))
    centers = rows_of(points, ids)
    assigned = saved(_with_cost(points, centers, which, prior))
    outliers = saved(assigned.orderBy(F.desc("cost"), "id").limit(pool))
    threshold = outliers.agg(F.min("cost").alias("m")).first()["m"] or 0.0
    return Bicriteria(Seeds(ids, centers, total_cost(assigned)), assigned, outliers, threshold)


def thorup(points: DataFrame, k: int, which="SQRL2", prior: float = 0.0, seed: int = 0, eps: float = 0.5, rounds: int | None = None) -> tuple[Seeds, DataFrame]:
    """(seeds, assigned) of a sample whose rounds draw a batch of rows and drop the rows no costlier than a random pivot.

    Batches have 21 * k * ln(W) / eps rows, and there are 3 * ln(W) rounds unless given; W is the weight of all rows.
    """
    w = max(points.agg(F.sum("weight").alias("w")).first()["w"] or 0.0, 2.0)
    batch = max(1, math.ceil(21 * k * math.log(w) / eps))
    rounds = math.ceil(3 * math.log(w)) if rounds is None else rounds
    ids: list[int] = []
    left = points
    for r in range(rounds):
        if left.limit(batch + 1).count() <= batch:
            ids += [x["id"] for x in left.select("id").collect()]  # at most a batch
            break
        ids += _draw(left, F.col("weight"), batch, r, seed)
        costed = saved(_with_cost(left.select(*points.columns), rows_of(points, ids), which, prior))
        pivot = _draw(costed, F.col("weight"), 1, 5000 + r, seed)
        at = costed.filter(F.col("id") == pivot[0]).first()["cost"]
        left = costed.filter(F.col("cost") > at).select(*points.columns)
        if left.limit(1).count() == 0:
            break
    ids = list(dict.fromkeys(ids))
    centers = rows_of(points, ids)
    assigned = saved(_with_cost(points, centers, which, prior))
    return Seeds(ids, centers, total_cost(assigned)), assigned


def union_of_samples(points: DataFrame, k: int, times: int, which="SQRL2", prior: float = 0.0, seed: int = 0, eps: float = 0.5, rounds: int | None = None) -> DataFrame:
    """id of the rows in any of several samples with pruning."""
    out = None
    for t in range(times):
        own = id_frame(points, thorup(points, k, which, prior, seed + 101 * t, eps, rounds)[0].ids).select("id")
        out = own if out is None else out.union(own)
    return out.distinct()


def thorup_iterated(points: DataFrame, k: int, iterations: int = 2, tries: int = 2, which="SQRL2", prior: float = 0.0, seed: int = 0, eps: float = 0.5) -> tuple[Seeds, DataFrame]:
    """The best of several samples, then samples of the sample, its rows weighed by what they stand for."""
    at, seeds = points, None
    for it in range(iterations):
        found = [thorup(at, k, which, prior, seed + 101 * (it * tries + t), eps) for t in range(tries)]
        best, assigned = min(found, key=lambda x: x[0].cost)
        if seeds is not None and len(best.ids) >= len(seeds.ids):
            break
        seeds = best
        stands = assigned.groupBy("cid").agg(F.sum("weight").alias("weight"))
        frame = points.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(best.ids)], "cid int, id long")
        at = saved(stands.join(frame, "cid").join(points.select("id", "features"), "id").select("id", "features", "weight"))
    return Seeds(seeds.ids, seeds.centers, total_cost(assign(points, seeds.centers, which, prior))), at
