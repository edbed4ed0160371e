"""Front ends: one call per task over points (id, features, weight), with the keyword names that users of such libraries know.

``centers`` arguments are ids of rows, a list of arrays or a 2-d array; results are dicts whose tables stay DataFrames.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centrova.operators import clustering, seeding
from centrova.operators.pairwise import assign
from centrova.options import ClusterOptions


def weighted(matrix: DataFrame, weights: str | Column | None = None) -> DataFrame:
    """The points with a weight: that of their own or 1, unless one is given."""
    if weights is not None:
        return matrix.withColumn("weight", (F.col(weights) if isinstance(weights, str) else weights).cast("double"))
    return matrix if "weight" in matrix.columns else matrix.withColumn("weight", F.lit(1.0))


def centers(matrix: DataFrame, given) -> np.ndarray:
    """Centers as an array: rows of these ids, or what was given."""
    if isinstance(given, np.ndarray) and given.ndim == 2:
        return given.astype(float)
    given = list(given)
    if given and isinstance(given[0], (int, np.integer)):
        return seeding.rows_of(matrix, [int(i) for i in given])
    return np.array([np.asarray(c, float) for c in given])


def kmeanspp(matrix: DataFrame, k: int, *, msr="SQRL2", prior: float = 0.0, seed: int = 0, ntimes: int = 1, lspp: int = 0, n_local_trials: int = 1, weights=None) -> dict:
    """ids, centers, asn (points with cid and cost) and cost of the best of ntimes seedings, after lspp swaps."""
    p = weighted(matrix, weights)
    s = seeding.best_of(p, k, ntimes, msr, prior, seed, n_local_trials)
    if lspp:
        s = seeding.local_search_swaps(p, s, lspp, msr, prior, seed)
    return {"ids": s.ids, "centers": s.centers, "asn": assign(p, s.centers, msr, prior), "cost": s.cost}


def d2_select(matrix: DataFrame, options: ClusterOptions, weights=None) -> dict:
    """``kmeanspp`` by options: extra tries and swaps."""
    return kmeanspp(matrix, options.k, msr=options.measure, prior=options.prior, seed=options.seed, ntimes=1 + options.extra_tries, lspp=options.local_search_rounds, n_local_trials=options.candidates, weights=weights)


def greedy_select(matrix: DataFrame, k: int, *, msr="L2", prior: float = 0.0, seed: int = 0, outlier_fraction: float = 0.0, ntimes: int = 1, first: int | None = None) -> dict:
    """ids, centers and the greatest cost of farthest-point selection; with outliers it passes over so many of the farthest rows."""
    p = weighted(matrix)
    s = seeding.best_kcenter(p, k, ntimes, which=msr, prior=prior, seed=seed, outliers=outlier_fraction, first=first)
    return {"ids": s.ids, "centers": s.centers, "cost": s.cost}


def _result(c: clustering.Clustering) -> dict:
    return {"initcost": c.costs[0], "finalcost": c.cost, "numiter": len(c.costs) - 1, "centers": c.centers, "asn": c.assigned}


def hcluster(matrix: DataFrame, given, *, msr="SQRL2", prior: float = 0.0, weights=None, eps: float = 1e-10, maxiter: int = 1000, mbsize: int = -1, ncheckins: int = -1, reseed_after: int | None = None, coreset_size: int = 0, seed: int = 0) -> dict:
    """Hard clusters from centers: all points, or minibatches of mbsize, or coresets."""
    p = weighted(matrix, weights)
    c = centers(p, given)
    if coreset_size:
        return _result(clustering.coreset_minibatch(p, c, coreset_size, which=msr, prior=prior, seed=seed))
    if mbsize > 0:
        every = max(1, maxiter // ncheckins) if ncheckins > 0 else 5
        return _result(clustering.minibatch(p, c, mbsize, min(maxiter, 100), every, msr, prior, seed, running_mean=False, reseed_after=reseed_after))
    return _result(clustering.hard(p, c, msr, prior, eps, maxiter, seed))


def scluster(matrix: DataFrame, given, *, msr="SQRL2", prior: float = 0.0, temp: float = 1.0, weights=None, eps: float = 1e-10, maxiter: int = 1000, savepref: str | None = None) -> dict:
    """Soft clusters from centers; savepref: also write costs and responsibilities as a Parquet table of that name."""
    p = weighted(matrix, weights)
    r = _result(clustering.soft(p, centers(p, given), msr, prior, temp, eps, maxiter))
    if savepref:
        r["asn"].select("id", "costs", "resp").write.mode("overwrite").parquet(savepref)
    return r


def cluster(matrix: DataFrame, *, k: int, msr="SQRL2", prior: float = 0.0, temp: float = 0.0, seed: int = 0, eps: float = 1e-4, maxiter: int = 50, weights=None, **seeding_options) -> dict:
    """Seeds, then soft clusters if temp is above 0, else hard ones."""
    p = weighted(matrix, weights)
    s = kmeanspp(p, k, msr=msr, prior=prior, seed=seed, **seeding_options)
    if temp > 0:
        return scluster(p, s["centers"], msr=msr, prior=prior, temp=temp, eps=eps, maxiter=maxiter)
    return hcluster(p, s["centers"], msr=msr, prior=prior, eps=eps, maxiter=maxiter, seed=seed)


@contextmanager
def timed(report: dict[str, float], stage: str) -> Iterator[None]:
    """Add the seconds of a stage to a report."""
    began = time.perf_counter()
    try:
        yield
    finally:
        report[stage] = report.get(stage, 0.0) + time.perf_counter() - began


def center_hits(assigned: DataFrame) -> DataFrame:
    """place, share: what part of all weight the place + 1 largest clusters hold; k rows."""
    from pyspark.sql import Window as W

    n = assigned.groupBy("cid").agg(F.sum("weight").alias("w"))
    by = W.partitionBy(F.lit(0)).orderBy(F.desc("w"), "cid")
    return n.select((F.row_number().over(by) - 1).alias("place"), (F.sum("w").over(by.rowsBetween(W.unboundedPreceding, 0)) / F.sum("w").over(W.partitionBy(F.lit(0)))).alias("share"))
