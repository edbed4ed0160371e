"""Coresets: sensitivities of points under a clustering, importance samples, and what they are worth.

Input to ``sensitivities`` is (id, cid, cost, weight); output (id, prob, weight) with probs that sum to 1.  A draw of id from a
sample of m draws weighs weight / (m * prob).  Cluster sums are one aggregation of k rows that joins back.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centrova.functions.draws import race, uniform
from centrova.operators.pairwise import assign
from centrova.operators.sampling import draw_independent
from centrova.options import CORESET_METHODS


def sensitivities(costed: DataFrame, method: str = "BFL", k: int | None = None) -> DataFrame:
    """id, prob, weight; methods: BFL, VX, LBK, FL, LFKF."""
    method = {"BTW": "VX"}.get(method.upper(), method.upper())
    if method not in CORESET_METHODS:
        raise ValueError(f"no such coreset method: {method}")
    f = F.col("cost") * F.col("cost") if method == "LFKF" else F.col("cost")
    base = costed.select("id", "cid", "weight", f.alias("f"))
    c = base.groupBy("cid").agg(F.count("*").cast("double").alias("n_c"), F.sum("weight").alias("w_c"), F.sum(F.col("weight") * F.col("f")).alias("f_c"))
    all = c.agg(F.sum("n_c").alias("n"), F.sum("w_c").alias("w"), F.sum("f_c").alias("f"), F.count("*").alias("k")).first()
    if not all["n"]:
        return base.select("id", F.lit(None).cast("double").alias("prob"), "weight")
    k = all["k"] if k is None else k
    own = base.join(c, "cid")
    wf, W, total = F.col("weight") * F.col("f"), float(all["w"]), float(all["f"])
    share = wf / F.lit(total) if total > 0 else F.col("weight") / F.lit(W)
    if method == "BFL":
        s = (share + F.col("weight") / (F.col("w_c") * F.col("n_c"))) / 2
    elif method == "VX":
        s = share + 1 / F.col("n_c")
    elif method == "FL":
        s = share
    else:
        alpha, phi = 16 * math.log(max(k, 2)) + 32, max(total / W, 1e-300)
        if method == "LBK":
            s = alpha * F.col("f") / phi + 2 * alpha * F.col("f_c") / (F.col("w_c") * phi) + 4 * W / F.col("w_c")
        else:
            s = alpha * F.col("weight") * (F.col("f") + F.col("f_c") / F.col("w_c")) + 2 * total / F.col("w_c")
    own = own.select("id", "weight", s.alias("s"))
    mass = own.agg(F.sum("s").alias("t")).first()["t"]
    return own.select("id", (F.col("s") / F.lit(float(mass))).alias("prob"), "weight")


def sample(probs: DataFrame, m: int, seed: int = 0, unique: bool = False) -> DataFrame:
    """id, weight of m draws with replacement, those of one row added up; unique: of m distinct rows."""
    if unique:
        drawn = probs.filter("prob > 0").withColumn("r", race(F.col("prob"), uniform(F.col("id"), 1, seed))).orderBy(F.desc("r"), "id").limit(m)
        return drawn.select("id", (F.col("weight") / (F.col("prob") * m)).alias("weight"))
    drawn = draw_independent(probs, "prob", m, seed).groupBy("id").agg(F.count("*").alias("times"))
    return drawn.join(probs, "id").select("id", (F.col("times") * F.col("weight") / (F.col("prob") * m)).alias("weight"))


def compact(core: DataFrame) -> DataFrame:
    """id, weight with the weights of one id added up."""
    return core.groupBy("id").agg(F.sum("weight").alias("weight"))


def merge(*cores: DataFrame) -> DataFrame:
    """The union of coresets of disjoint parts."""
    out = cores[0]
    for c in cores[1:]:
        out = out.unionByName(c)
    return compact(out)


def with_centers(core: DataFrame, costed: DataFrame, eps: float, b: float = 1.0) -> DataFrame:
    """cid, weight of the center rows that complete an FL sample: max((1 + 10 eps) * b * W_c - weights sampled from c, 0)."""
    sampled = core.select("id", F.col("weight").alias("s")).join(costed.select("id", "cid"), "id").groupBy("cid").agg(F.sum("s").alias("s"))
    own = costed.groupBy("cid").agg(F.sum("weight").alias("w"))
    return own.join(sampled, "cid", "left").select("cid", F.greatest((1 + 10 * eps) * b * F.col("w") - F.coalesce("s", F.lit(0.0)), F.lit(0.0)).alias("weight"))


def top_outliers(probs: DataFrame, n: int) -> DataFrame:
    """id, weight of the n likeliest rows."""
    return probs.orderBy(F.desc("prob"), "id").limit(n).select("id", (F.col("weight") / (F.col("prob") * n)).alias("weight"))


def materialise(points: DataFrame, core: DataFrame) -> DataFrame:
    """The points of a coreset with its weights."""
    return points.drop("weight").join(core, "id")


def kmeans_coreset(points: DataFrame, k: int, m: int, which="SQRL2", prior: float = 0.0, seed: int = 0, method: str = "BFL") -> DataFrame:
    """Seeds, sensitivities, sample, rows: a weighted set of about m points."""
    from centrova.operators.seeding import kmeanspp

    seeds = kmeanspp(points, k, which, prior, seed)
    costed = assign(points, seeds.centers, which, prior).select("id", "cid", "cost", "weight")
    return materialise(points, sample(sensitivities(costed, method, k), m, seed))


def kcenter_coreset(points: DataFrame, k: int, mu: float, rho: float, gamma: float, eta: float = 0.1, which="L2", prior: float = 0.0, seed: int = 0) -> DataFrame:
    """id, weight: outliers with weight 1 and centers with the number of rows they stand for, outliers not among them."""
    from centrova.operators.seeding import kcenter_bicriteria

    size = math.ceil((2 / mu) ** rho * k)
    rounds = math.ceil((size + math.sqrt(size)) / (1 - eta))
    b = kcenter_bicriteria(points, gamma, rounds, eta, which=which, prior=prior, seed=seed)
    ids = points.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(b.seeds.ids)], "cid int, id long")
    out = b.outliers.select("id", F.lit(1.0).alias("weight"))
    own = b.assigned.join(b.outliers.select("id"), "id", "left_anti").groupBy("cid").agg(F.sum("weight").alias("weight"))
    return own.join(ids, "cid").select("id", "weight").union(out)


def distortion(points: DataFrame, core: DataFrame, center_sets: list[np.ndarray], which="SQRL2", prior: float = 0.0) -> DataFrame:
    """set, full, estimate, distortion: |estimate / full - 1| of the cost of each center set."""
    rows = []
    weighted = materialise(points, core)
    for i, centers in enumerate(center_sets):
        cost = [assign(p, centers, which, prior).agg(F.sum(F.col("weight") * F.col("cost")).alias("c")).first()["c"] or 0.0 for p in (points, weighted)]
        rows.append((i, cost[0], cost[1], abs(cost[1] / cost[0] - 1) if cost[0] else 0.0))
    return points.sparkSession.createDataFrame(rows, "set int, full double, estimate double, distortion double")


def caratheodory(points: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices, weights) of at most d + 1 points with the same weighted sum and total weight; for small arrays."""
    p, w, at = np.asarray(points, float), np.asarray(weights, float).copy(), np.arange(len(points))
    d = p.shape[1]
    while len(at) > d + 1:
        a = (p[at[1:]] - p[at[0]]).T
        v = np.linalg.svd(a)[2][-1]
        v = np.concatenate([[-v.sum()], v])
        pos = v > 1e-12
        step = (w[at][pos] / v[pos]).min()
        w[at] -= step * v
        keep = w[at] > 1e-12
        if keep.all():
            keep[np.argmin(w[at])] = False
        at = at[keep]
    return at, w[at]
