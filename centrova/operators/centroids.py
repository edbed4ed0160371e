"""Centers of clusters: means, medians by coordinate, and geometric medians, over (cid, id, features, weight)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from centrova.functions.measures import distribution, measure
from centrova.operators.pairwise import matrix_of


def _long(members: DataFrame) -> DataFrame:
    return members.select("cid", "id", "weight", F.posexplode("features").alias("feature", "value"))


def _gathered(long: DataFrame, value: str) -> DataFrame:
    g = long.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("feature", F.col(value).alias("v")))).alias("e"))
    return g.select("cid", F.col("e.v").cast("array<double>").alias("features"))


def sums(members: DataFrame, k: int, shares: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(weighted sums (k, d), weights (k)) of the clusters 0 .. k - 1, by partial sums per batch; shares: of rows over their sum."""
    own = members.select("cid", "weight", distribution(F.col("features")).alias("features") if shares else F.col("features"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = w_acc = None
        for b in batches:
            if not b.num_rows:
                continue
            x, w, c = matrix_of(b.column(2)), b.column(1).to_numpy(), b.column(0).to_numpy()
            if acc is None:
                acc, w_acc = np.zeros((k, x.shape[1])), np.zeros(k)
            np.add.at(acc, c, x * w[:, None])
            w_acc += np.bincount(c, w, minlength=k)
        if acc is not None:
            used = np.flatnonzero(w_acc)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(w_acc[used]), pa.array(list(acc[used]), pa.list_(pa.float64()))], ["cid", "w", "s"])

    found = added(own.mapInArrow(run, "cid int, w double, s array<double>"))
    d = max((len(v) for _, v in found.values()), default=0)
    s, w = np.zeros((k, d)), np.zeros(k)
    for cid, (own_w, own_s) in found.items():
        s[cid], w[cid] = own_s, own_w
    return s, w


def added(parts: DataFrame) -> dict[int, tuple[float, np.ndarray]]:
    """{cid: (weight, sums)} of partial rows (cid, w, s): added up by place before k rows come to the driver."""
    one = parts.select("cid", "w", F.posexplode("s").alias("f", "v")).groupBy("cid", "f").agg(F.sum("v").alias("v"), F.sum("w").alias("w"))
    rows = one.groupBy("cid").agg(F.max("w").alias("w"), F.sort_array(F.collect_list(F.struct("f", "v"))).alias("e")).collect()
    return {r["cid"]: (r["w"], np.array([e["v"] for e in r["e"]])) for r in rows}


def means(members: DataFrame, k: int, shares: bool = False) -> np.ndarray:
    """(k, d) weighted means; rows of NaN for empty clusters."""
    s, w = sums(members, k, shares)
    with np.errstate(invalid="ignore", divide="ignore"):
        return s / w[:, None]


def mean_frame(members: DataFrame) -> DataFrame:
    """cid, features: weighted means, as a DataFrame."""
    m = _long(members).groupBy("cid", "feature").agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("value"))
    return _gathered(m, "value")


def median_frame(members: DataFrame, shares: bool = False) -> DataFrame:
    """cid, features: medians by coordinate, the mean of the two middle values for an even number; weights are not looked at.

    Equal values are one row before any sort, and the running count over a coordinate's values can spill; no group is held in memory.
    """
    own = members.withColumn("features", distribution(F.col("features"))) if shares else members
    v = _long(own).groupBy("cid", "feature", "value").agg(F.count("*").alias("n"))
    by = W.partitionBy("cid", "feature")
    v = v.select("cid", "feature", "value", F.sum("n").over(by.orderBy("value").rowsBetween(W.unboundedPreceding, 0)).alias("cum"), F.sum("n").over(by).alias("all"))
    # places of the middle values, from 0
    low, high = (F.min(F.when(F.col("cum") > place, F.col("value"))) for place in (F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)))
    return _gathered(v.groupBy("cid", "feature").agg(((low + high) / 2).alias("value")), "value")


def weighted_median_frame(members: DataFrame, shares: bool = False) -> DataFrame:
    """cid, features: the least value at which the weights of values up to it reach half of all."""
    own = members.withColumn("features", distribution(F.col("features"))) if shares else members
    v = _long(own).groupBy("cid", "feature", "value").agg(F.sum("weight").alias("w"))
    run = W.partitionBy("cid", "feature").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    all = W.partitionBy("cid", "feature")
    v = v.select("cid", "feature", "value", F.sum("w").over(run).alias("cum"), F.sum("w").over(all).alias("all"))
    m = v.filter(F.col("cum") >= F.col("all") / 2).groupBy("cid", "feature").agg(F.min("value").alias("value"))
    return _gathered(m, "value")


def geometric_medians(members: DataFrame, start: np.ndarray, eps: float = 1e-6, max_iterations: int = 100, floor: float = 1e-30) -> np.ndarray:
    """(k, d) geometric medians by Weiszfeld steps from start; each step is one pass with partial sums."""
    centers, before = np.array(start, float), np.inf
    k = len(centers)
    for _ in range(max_iterations):
        sent = members.sparkSession.sparkContext.broadcast(centers)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c0, acc, w_acc, cost = sent.value, np.zeros_like(sent.value), np.zeros(k), np.zeros(k)
            for b in batches:
                if not b.num_rows:
                    continue
                c, w, x = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix_of(b.column(2))
                dist = np.linalg.norm(x - c0[c], axis=1)
                cost += np.bincount(c, w * dist, minlength=k)
                v = w / np.maximum(dist, floor)
                np.add.at(acc, c, x * v[:, None])
                w_acc += np.bincount(c, v, minlength=k)
            # the cost is one more place of the sums
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(w_acc), pa.array([[*r, c] for r, c in zip(acc, cost, strict=True)], pa.list_(pa.float64()))], ["cid", "w", "s"])

        found = added(members.select("cid", "weight", "features").mapInArrow(run, "cid int, w double, s array<double>"))
        cost, new = 0.0, centers.copy()
        for cid, (w, s) in sorted(found.items()):
            cost += s[-1]
            if w > 0:
                new[cid] = s[:-1] / w
        if before - cost <= eps * max(cost, 1e-300) and before < np.inf:
            break
        centers, before = new, cost
    return centers


def update(members: DataFrame, k: int, which, start: np.ndarray, weighted: bool = False) -> np.ndarray:
    """(k, d) new centers under the measure's policy; rows of NaN for empty clusters."""
    m = measure(which)
    if m.centroid == "mean":
        return means(members, k, shares=m.probability)
    if m.centroid == "geo_median":
        own = members.withColumn("features", distribution(F.col("features"))) if m.probability else members
        out = geometric_medians(own, start)
        filled = {r["cid"] for r in members.select("cid").distinct().collect()}
        out[[i for i in range(k) if i not in filled]] = np.nan
        return out
    f = weighted_median_frame if weighted else median_frame
    out = np.full(np.shape(start), np.nan)
    for r in f(members, shares=m.centroid == "tvd_median").collect():  # k rows
        out[r["cid"]] = r["features"]
    return out
