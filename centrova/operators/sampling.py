"""Weighted and uniform draws of rows, repeatable for a seed whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from centrova.functions.draws import race, uniform
from centrova.plans.iterate import saved


def farthest(costs: DataFrame, n: int) -> DataFrame:
    """The n rows (id, cost) of the greatest cost; ties to the lower id."""
    return costs.orderBy(F.desc("cost"), "id").limit(n)


def draw_one(df: DataFrame, weight: str, round: int, seed: int) -> int | None:
    """The id of one draw in proportion to weight; None if no weight is above 0."""
    key = F.struct(race(F.col(weight), uniform(F.col("id"), round, seed)).alias("r"), (-F.col("id")).alias("i"))
    r = df.filter(F.col(weight) > 0).agg(F.max(key)["i"].alias("i")).first()
    return None if r["i"] is None else -r["i"]


def draw_distinct(df: DataFrame, weight: str, n: int, round: int = 0, seed: int = 0) -> DataFrame:
    """n rows drawn one after the other without replacement."""
    key = race(F.col(weight), uniform(F.col("id"), round, seed))
    return df.filter(F.col(weight) > 0).withColumn("__r", key).orderBy(F.desc("__r"), "id").limit(n).drop("__r")


def cumulative(df: DataFrame, value: str, into: str = "cum", buckets: int = 256) -> DataFrame:
    """Running sum of value by id, this row included, without one task for all: sums of id ranges, then sums within a range."""
    ranged = saved(df.repartitionByRange(buckets, "id").withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.sum(value).alias("__s"))
    before = sizes.select("__p", F.coalesce(F.sum("__s").over(W.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("__b"))
    own = F.sum(value).over(W.partitionBy("__p").orderBy("id").rowsBetween(W.unboundedPreceding, 0))
    return ranged.join(before, "__p").withColumn(into, F.col("__b") + own).drop("__b")


def draw_independent(df: DataFrame, prob: str, n: int, seed: int = 0) -> DataFrame:
    """n independent draws in proportion to prob: draw, id, by the place of n uniforms in the running sum.

    Draws and rows meet by range: each draw finds the range of ids that holds it from one row per range, then its row there.
    """
    c = saved(cumulative(df.select("id", F.col(prob).cast("double").alias("p")).filter("p > 0"), "p"))
    ranges = c.groupBy("__p").agg(F.min(F.col("cum") - F.col("p")).alias("lo"), F.max("cum").alias("hi"))
    all = c.agg(F.max("cum").alias("t")).first()["t"]
    if all is None:
        return df.sparkSession.createDataFrame([], "draw long, id long")
    u = df.sparkSession.range(n).select(F.col("id").alias("draw"), (uniform(F.col("id"), 1, seed) * F.lit(float(all))).alias("u"))
    placed = u.join(F.broadcast(ranges), (F.col("u") > F.col("lo")) & (F.col("u") <= F.col("hi")))
    hit = placed.join(c.withColumnRenamed("__p", "q"), (F.col("__p") == F.col("q")) & (F.col("u") <= F.col("cum")) & (F.col("u") > F.col("cum") - F.col("p")))
    return hit.groupBy("draw").agg(F.min("id").alias("id"))


def uniform_coreset(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """id, weight of n distinct rows, each standing for rows / n of them."""
    total = df.count()
    n = min(n, total)
    return draw_distinct(df.select("id").withColumn("w", F.lit(1.0)), "w", n, 0, seed).select("id", F.lit(total / max(n, 1)).alias("weight"))


def stratified(df: DataFrame, keep: Column, seed: int = 0) -> DataFrame:
    """Rows kept with probability ``keep``."""
    return df.filter(uniform(F.col("id"), 0, seed) < keep)
