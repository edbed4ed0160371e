"""The forms a matrix takes, and how to go from one to another.

dense: ``id long, features array<double>[, weight double]``; sparse: ``id long, idx array<int>, val array<double>, dim int``;
long: ``id long, feature int, value double`` with only entries that are not zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centrova.functions.vectors import to_dense, to_sparse


def points(df: DataFrame, id: str = "id", features: str = "features", weight: str | Column | None = None) -> DataFrame:
    """id, features as doubles, weight (1 unless given), whatever their names and number types were."""
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    return df.select(F.col(id).cast("long").alias("id"), F.col(features).cast("array<double>").alias("features"), w.cast("double").alias("weight"))


def checked(df: DataFrame, dim: int, probability: bool = False) -> DataFrame:
    """The points, with an error for a row of another length, a weight that is not above 0 or, for distributions, a negative value."""
    ok = (F.size("features") == dim) & (F.col("weight") > 0)
    if probability:
        ok = ok & F.forall("features", lambda v: v >= 0)
    return df.withColumn("features", F.when(ok, F.col("features")).otherwise(F.raise_error(F.concat(F.lit("not a valid point: id "), F.col("id").cast("string"))).cast("array<double>")))


def dimension(df: DataFrame) -> int:
    """The length of the points; an error if there are two."""
    r = df.agg(F.min(F.size("features")).alias("lo"), F.max(F.size("features")).alias("hi")).first()
    if r["lo"] != r["hi"]:
        raise ValueError(f"points have from {r['lo']} to {r['hi']} values")
    return r["lo"] or 0


def dense_to_long(df: DataFrame) -> DataFrame:
    return df.select("id", F.posexplode("features").alias("feature", "value")).filter("value != 0")


def dense_to_sparse(df: DataFrame) -> DataFrame:
    return df.select("id", to_sparse(F.col("features")).alias("s")).select("id", "s.idx", "s.val", "s.dim")


def sparse_to_dense(df: DataFrame) -> DataFrame:
    return df.select("id", to_dense(F.col("idx"), F.col("val"), F.col("dim")).alias("features"))


def sparse_to_long(df: DataFrame) -> DataFrame:
    return df.select("id", F.explode(F.arrays_zip("idx", "val")).alias("e")).select("id", F.col("e.idx").alias("feature"), F.col("e.val").alias("value")).filter("value != 0")


def long_to_sparse(df: DataFrame, dim: int) -> DataFrame:
    """Rows without entries are not there; entries of one place are summed."""
    one = df.groupBy("id", "feature").agg(F.sum("value").alias("value"))
    g = one.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("feature", "value"))).alias("e"))
    return g.select("id", F.col("e.feature").cast("array<int>").alias("idx"), F.col("e.value").cast("array<double>").alias("val"), F.lit(dim).alias("dim"))


def long_to_dense(df: DataFrame, dim: int) -> DataFrame:
    return sparse_to_dense(long_to_sparse(df, dim))


def counts(df: DataFrame, row: str, feature: str, value: Column | None = None) -> DataFrame:
    """Long form of a table of facts: how often, or how much of value, each row has of each feature, features numbered by name.

    The numbering is one row per distinct feature.
    """
    names = df.select(F.col(feature).alias("name")).distinct().groupBy().agg(F.sort_array(F.collect_set("name")).alias("names"))
    named = names.select(F.posexplode("names").alias("feature", "name"))
    v = F.count("*") if value is None else F.sum(value)
    g = df.groupBy(F.col(row).cast("long").alias("id"), F.col(feature).alias("name")).agg(v.cast("double").alias("value"))
    return g.join(named, "name").select("id", "feature", "value")
