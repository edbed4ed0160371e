"""Hard, soft, minibatch, coreset-minibatch and hierarchical clustering as loops of DataFrame passes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centrova.functions.draws import race, uniform
from centrova.functions.measures import block_distance, distribution, measure
from centrova.operators.centroids import added, update
from centrova.operators.pairwise import assign, matrix_of
from centrova.operators.seeding import best_of, kmeanspp, local_search_swaps, total_cost
from centrova.options import ClusterOptions
from centrova.plans.iterate import saved


@dataclass
class Clustering:
    """Centers (k, d), the assigned points (id, features, weight, cid, cost), and costs by iteration."""

    centers: np.ndarray
    assigned: DataFrame
    costs: list[float] = field(default_factory=list)

    @property
    def cost(self) -> float:
        return self.costs[-1]


def costs_against(costed: DataFrame, candidates: np.ndarray, which, prior: float) -> np.ndarray:
    """For each candidate the summed weight * min(cost, cost to it), in one pass with a row per task."""
    sent = costed.sparkSession.sparkContext.broadcast(np.asarray(candidates, float))
    m = measure(which)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(len(sent.value))
        for b in batches:
            if b.num_rows:
                d = block_distance(m, matrix_of(b.column(0)), sent.value, prior)
                acc += (np.minimum(d, b.column(1).to_numpy()[:, None]) * b.column(2).to_numpy()[:, None]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(acc))), pa.array(acc)], ["i", "c"])

    rows = costed.select("features", "cost", "weight").mapInArrow(run, "i long, c double").groupBy("i").agg(F.sum("c").alias("c")).collect()
    out = np.zeros(len(candidates))
    for r in rows:
        out[r["i"]] = r["c"]
    return out


def _refill(points: DataFrame, centers: np.ndarray, which, prior: float, round: int, seed: int) -> tuple[np.ndarray, bool]:
    """Empty clusters (rows of NaN) get rows drawn in proportion to cost."""
    empty = np.flatnonzero(np.isnan(centers).any(axis=1))
    if not len(empty):
        return centers, False
    full = centers[~np.isnan(centers).any(axis=1)]
    costed = assign(points, full, which, prior)
    left = F.col("weight") * F.col("cost")
    key = race(left, uniform(F.col("id"), 20_000 + round, seed))
    drawn = costed.filter(left > 0).withColumn("r", key).orderBy(F.desc("r"), "id").limit(len(empty)).select("features").collect()
    out = centers.copy()
    shares = measure(which).probability
    for i, r in zip(empty, drawn, strict=False):
        x = np.array(r["features"], float)
        out[i] = x / x.sum() if shares and x.sum() > 0 else x
    return out[~np.isnan(out).any(axis=1)], True


def hard(points: DataFrame, centers: np.ndarray, which="SQRL2", prior: float = 0.0, eps: float = 1e-4, max_iterations: int = 50, seed: int = 0, weighted: bool = False) -> Clustering:
    """Assign, recenter, again; ends when the cost falls by less than eps of it, and goes back a step if it rose."""
    at = np.asarray(centers, float)
    assigned = saved(assign(points, at, which, prior))
    costs = [total_cost(assigned)]
    for it in range(max_iterations):
        if costs[-1] == 0:
            break
        new = update(assigned, len(at), which, at, weighted)
        new, refilled = _refill(points, new, which, prior, it, seed)
        again = saved(assign(points, new, which, prior))
        cost = total_cost(again)
        if cost > costs[-1] and not refilled:
            break
        at, assigned = new, again
        costs.append(cost)
        if not refilled and costs[-2] - cost < eps * max(costs[-2], cost):
            break
    return Clustering(at, assigned, costs)


def responsibilities(points: DataFrame, centers: np.ndarray, which="SQRL2", prior: float = 0.0, temperature: float = 1.0) -> DataFrame:
    """The points with costs and resp: softmax(-temperature * cost), even over the nearest where that is not a number."""
    m, names = measure(which), points.columns
    at = names.index("features")
    sent = points.sparkSession.sparkContext.broadcast(np.asarray(centers, float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d = block_distance(m, matrix_of(b.column(at)), sent.value, prior)
            z = -temperature * d
            with np.errstate(invalid="ignore"):
                e = np.exp(z - z.max(axis=1, keepdims=True))
                r = e / e.sum(axis=1, keepdims=True)
            odd = np.isnan(r).any(axis=1)
            least = (d == d.min(axis=1, keepdims=True)).astype(float)
            r[odd] = (least / least.sum(axis=1, keepdims=True))[odd]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(d), pa.list_(pa.float64())), pa.array(list(r), pa.list_(pa.float64()))], [*names, "costs", "resp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema) + ", costs array<double>, resp array<double>"
    return points.mapInArrow(run, schema)


def soft(points: DataFrame, centers: np.ndarray, which="SQRL2", prior: float = 0.0, temperature: float = 1.0, eps: float = 1e-4, max_iterations: int = 50) -> Clustering:
    """Soft clusters: centers are responsibility-weighted means (of distributions, for measures on them), or medians for L1 and TVD."""
    m = measure(which)
    at = np.asarray(centers, float)
    soft_cost = F.aggregate(F.zip_with("costs", "resp", lambda c, r: F.when(r > 0, c * r).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)

    def step(c: np.ndarray) -> tuple[DataFrame, float]:
        df = saved(responsibilities(points, c, which, prior, temperature))
        return df, df.agg(F.sum(F.col("weight") * soft_cost).alias("c")).first()["c"] or 0.0

    df, cost = step(at)
    costs = [cost]
    for _ in range(max_iterations):
        if m.centroid in ("l1_median", "tvd_median"):
            new = soft_medians(df, len(at), shares=m.centroid == "tvd_median")
            new = np.where(np.isnan(new), at, new)
            again, cost = step(new)
            if cost > costs[-1]:
                break
            at, df = new, again
            costs.append(cost)
            if costs[-2] - cost < eps * max(costs[-2], cost):
                break
            continue
        x = df.withColumn("features", distribution(F.col("features"))) if m.probability else df
        k = len(at)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = w_acc = None
            for b in batches:
                if b.num_rows:
                    v, w, r = matrix_of(b.column(0)), b.column(1).to_numpy(), matrix_of(b.column(2))
                    r = r * w[:, None]
                    acc = r.T @ v if acc is None else acc + r.T @ v
                    w_acc = r.sum(axis=0) if w_acc is None else w_acc + r.sum(axis=0)
            if acc is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(w_acc), pa.array(list(acc), pa.list_(pa.float64()))], ["cid", "w", "s"])

        parts = x.select("features", "weight", "resp").mapInArrow(run, "cid int, w double, s array<double>")
        new = at.copy()
        for cid, (w, s) in added(parts).items():
            if w > 0:
                new[cid] = s / w
        again, cost = step(new)
        if cost > costs[-1]:
            break
        at, df = new, again
        costs.append(cost)
        if costs[-2] - cost < eps * max(costs[-2], cost):
            break
    return Clustering(at, df, costs)


def soft_medians(df: DataFrame, k: int, shares: bool = False) -> np.ndarray:
    """(k, d) weighted medians by coordinate of points with responsibilities: row weights are weight * resp of the cluster."""
    from centrova.operators.centroids import weighted_median_frame

    own = df.select("id", "features", F.posexplode(F.transform("resp", lambda r: r * F.col("weight"))).alias("cid", "weight")).filter("weight > 0")
    found = {r["cid"]: r["features"] for r in weighted_median_frame(own, shares).collect()}  # k rows
    d = len(next(iter(found.values()))) if found else 0
    return np.array([found.get(i, [np.nan] * d) for i in range(k)], float)


def minibatch(points: DataFrame, centers: np.ndarray, batch: int, rounds: int = 20, check_every: int = 5, which="SQRL2", prior: float = 0.0, seed: int = 0, running_mean: bool = True, reseed_after: int | None = None) -> Clustering:
    """Recenter by seeded batches, check in against all points every few rounds, keep the best centers seen.

    running_mean: a batch moves a center by its share of the points that the center has seen; else centers become the batch's own.
    reseed_after: at a check-in, centers with at most so many points give way to rows drawn in proportion to cost.
    """
    at = np.asarray(centers, float)
    seen = np.zeros(len(at))
    best, best_cost, costs = at, np.inf, []
    share = measure(which).probability
    n = points.count()
    for r in range(rounds + 1):
        if r % check_every == 0 or r == rounds:
            here = saved(assign(points, at, which, prior)) if reseed_after is not None else assign(points, at, which, prior)
            cost = total_cost(here)
            costs.append(cost)
            if cost < best_cost:
                best, best_cost = at.copy(), cost
            if r == rounds:
                break
            if reseed_after is not None:
                filled = {x["cid"]: x["n"] for x in here.groupBy("cid").agg(F.count("*").alias("n")).collect()}  # k rows
                few = [i for i in range(len(at)) if filled.get(i, 0) <= reseed_after]
                if few and len(few) < len(at):
                    holes = at.copy()
                    holes[few] = np.nan
                    refilled, _ = _refill(points, holes, which, prior, 5000 + r, seed)
                    if len(refilled) == len(at):
                        at, seen = refilled, np.where(np.isin(np.arange(len(at)), few), 0.0, seen)
        part = points.filter(uniform(F.col("id"), r, seed) < F.lit(min(1.0, batch / max(n, 1))))
        own = assign(part, at, which, prior)
        if measure(which).centroid == "mean":
            from centrova.operators.centroids import sums

            s, w = sums(own, len(at), share)
            for i in np.flatnonzero(w > 0):
                seen[i] += w[i]
                rate = w[i] / seen[i] if running_mean else 1.0
                at[i] = (1 - rate) * at[i] + rate * s[i] / w[i]
        else:
            new = update(own, len(at), which, at)
            ok = ~np.isnan(new).any(axis=1)
            at = np.where(ok[:, None], new, at)
    assigned = saved(assign(points, best, which, prior))
    return Clustering(best, assigned, [*costs, total_cost(assigned)])


def coreset_minibatch(points: DataFrame, centers: np.ndarray, size: int, rounds: int = 5, steps: int = 5, which="SQRL2", prior: float = 0.0, seed: int = 0) -> Clustering:
    """Per round: an importance sample of the points under the centers, a few weighted steps on it, and one look at all points."""
    from centrova.operators.coreset import materialise, sample, sensitivities

    at = np.asarray(centers, float)
    assigned = saved(assign(points, at, which, prior))
    costs, best = [total_cost(assigned)], (at, assigned)
    for r in range(rounds):
        method = "VX" if measure(which).centroid in ("l1_median", "geo_median") else "LBK"
        s = sensitivities(assigned.select("id", "cid", "cost", "weight"), method, len(at))
        core = saved(materialise(points, sample(s, size, seed + r)))
        at = hard(core, at, which, prior, max_iterations=steps, seed=seed, weighted=True).centers
        assigned = saved(assign(points, at, which, prior))
        costs.append(total_cost(assigned))
        if costs[-1] < min(costs[:-1]):
            best = at, assigned
    return Clustering(*best, [*costs, min(costs)])


def cluster(points: DataFrame, options: ClusterOptions) -> Clustering:
    """Seeds, then soft clusters if the temperature is above 0, else hard ones; on a coreset first if a size is given."""
    o = options
    seeds = best_of(points, o.k, 1 + o.extra_tries, o.measure, o.prior, o.seed, o.candidates)
    if o.local_search_rounds:
        seeds = local_search_swaps(points, seeds, o.local_search_rounds, o.measure, o.prior, o.seed)
    if o.temperature > 0:
        return soft(points, seeds.centers, o.measure, o.prior, o.temperature, o.epsilon, o.max_iterations)
    if o.coreset_size:
        return coreset_minibatch(points, seeds.centers, o.coreset_size, which=o.measure, prior=o.prior, seed=o.seed)
    return hard(points, seeds.centers, o.measure, o.prior, o.epsilon, o.max_iterations, o.seed)


def hierarchical(points: DataFrame, radix: int, which="SQRL2", prior: float = 0.0, seed: int = 0) -> DataFrame:
    """node_path array<int>, depth, id: clusters are split into radix parts until each has at most radix rows or cannot be split."""
    from centrova.operators.tree import leaves

    return leaves(points, radix, which, prior, seed)


def assignment_histogram(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cid").agg(F.count("*").alias("n"))


def mixture_scores(points: DataFrame, means: np.ndarray, covariances: np.ndarray, weights: np.ndarray) -> DataFrame:
    """id, log_density, comp of every point under a Gaussian mixture: log sum of weighted densities, and the likeliest component."""
    means, weights = np.asarray(means, float), np.asarray(weights, float)
    inverse = np.linalg.inv(covariances)
    logdet = np.linalg.slogdet(covariances)[1]
    sent = points.sparkSession.sparkContext.broadcast((means, inverse, np.log(weights) - 0.5 * (logdet + means.shape[1] * np.log(2 * np.pi))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mu, inv, base = sent.value
        for b in batches:
            if b.num_rows:
                x = matrix_of(b.column(1))
                z = np.stack([base[c] - 0.5 * np.einsum("ni,ij,nj->n", x - mu[c], inv[c], x - mu[c]) for c in range(len(mu))], axis=1)
                top = z.max(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(top + np.log(np.exp(z - top[:, None]).sum(axis=1))), pa.array(z.argmax(axis=1).astype(np.int32))], ["id", "log_density", "comp"])

    return points.select("id", "features").mapInArrow(run, "id long, log_density double, comp int")
