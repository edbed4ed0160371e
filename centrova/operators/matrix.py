"""Selection, reshaping and statistics of matrices in long or dense form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from centrova.functions.measures import total
from centrova.functions.vectors import l2_normalised, nnz

# Selection.


def select_rows(df: DataFrame, ids: list[int]) -> DataFrame:
    """The rows of these ids, in their order and as often as they are named, with ``place``."""
    spark = df.sparkSession
    want = spark.range(1).select(F.posexplode(F.array(*[F.lit(int(i)) for i in ids])).alias("place", "__id"))
    return want.join(df, F.col("__id") == F.col("id")).drop("__id")


def submatrix(df: DataFrame, rows: list[int] | None = None, columns: list[int] | None = None) -> DataFrame:
    """Dense rows and columns by index; duplicates and order are kept."""
    out = select_rows(df, rows) if rows is not None else df
    if columns is not None:
        out = out.withColumn("features", F.transform(F.array(*[F.lit(int(c)) for c in columns]), lambda c: F.get(F.col("features"), c)))
    return out


def rows_if(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def columns_if(long: DataFrame, condition: Column) -> DataFrame:
    """Long form restricted to the features whose aggregate (a boolean over their entries) holds."""
    keep = long.groupBy("feature").agg(condition.alias("__ok")).filter("__ok").select("feature")
    return long.join(keep, "feature", "left_semi")


def at_least_nnz(sparse: DataFrame, m: int, n: int | None = None) -> DataFrame:
    """Sparse rows with m entries or more; the first n by id if n is given."""
    out = sparse.filter(F.size("idx") >= m)
    return out if n is None else out.orderBy("id").limit(n)


def _numbered(df: DataFrame, key: str, to: str) -> DataFrame:
    """key and its place among the distinct keys, without bringing them to one task: places within ranges plus the sizes of the ranges before."""
    keys = df.select(key).distinct()
    n = max(1, df.sparkSession.sparkContext.defaultParallelism)
    ranged = keys.repartitionByRange(n, key).sortWithinPartitions(key).withColumn("__p", F.spark_partition_id())
    from centrova.plans.iterate import saved

    ranged = saved(ranged)
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(W.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return ranged.join(before, "__p").select(key, (F.col("__before") + F.row_number().over(W.partitionBy("__p").orderBy(key)) - 1).alias(to))


def erase_empty(long: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Long form without rows and columns that sum to nothing, renumbered; and (id, new_id), (feature, new_feature) of what was kept."""
    rows = long.groupBy("id").agg(F.sum(F.abs("value")).alias("s")).filter("s > 0").select("id")
    kept = long.join(rows, "id", "left_semi")
    cols = kept.groupBy("feature").agg(F.sum(F.abs("value")).alias("s")).filter("s > 0").select("feature")
    ids, features = _numbered(rows, "id", "new_id"), _numbered(cols, "feature", "new_feature")
    out = kept.join(ids, "id").join(features, "feature").select(F.col("new_id").alias("id"), F.col("new_feature").alias("feature"), "value")
    return out, ids, features


def concat(parts: list[DataFrame]) -> DataFrame:
    """Long forms one below the other: part number, then id within it, as (part, id, feature, value); an error if read matrices differ in columns."""
    widths = {p.schema["value"].metadata["columns"] for p in parts if "columns" in p.schema["value"].metadata}
    if len(widths) > 1:
        raise ValueError(f"matrices of {sorted(widths)} columns cannot stand one below the other")
    out = None
    for i, p in enumerate(parts):
        own = p.select(F.lit(i).alias("part"), "id", "feature", "value")
        out = own if out is None else out.unionByName(own)
    return out


def transpose(long: DataFrame) -> DataFrame:
    return long.select(F.col("feature").cast("long").alias("id"), F.col("id").alias("feature"), "value")


# Scaling.


def normalise_rows(df: DataFrame) -> DataFrame:
    """Rows over their 2-norm; rows of zeros as they are."""
    return df.withColumn("features", l2_normalised(F.col("features")))


def normalise_columns(long: DataFrame) -> DataFrame:
    norms = long.groupBy("feature").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("n"))
    return long.join(norms, "feature").select("id", "feature", F.when(F.col("n") > 0, F.col("value") / F.col("n")).otherwise(F.col("value")).alias("value"))


def row_shares(df: DataFrame) -> DataFrame:
    """Rows over their sum."""
    s = total(F.col("features"))
    return df.withColumn("features", F.when(s != 0, F.transform("features", lambda v: v / s)).otherwise(F.col("features")))


def mirror(pairs: DataFrame) -> DataFrame:
    """(i, j, dist) of an upper triangle as a full symmetric matrix with a zero diagonal."""
    both = pairs.select("i", "j", "dist").union(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist"))
    ids = both.select("i").distinct()
    return both.filter("i != j").union(ids.select("i", F.col("i").alias("j"), F.lit(0.0).alias("dist")))


def powered(distances: DataFrame, z: float) -> DataFrame:
    return distances.withColumn("dist", F.pow(F.abs("dist"), F.lit(float(z))))


def client_weighted(distances: DataFrame, weights: DataFrame) -> DataFrame:
    """(facility, client, dist) times each client's weight (client, weight)."""
    return distances.join(weights, "client").select("facility", "client", (F.col("dist") * F.col("weight")).alias("dist"))


# Statistics.


def row_sums(df: DataFrame) -> DataFrame:
    return df.select("id", total(F.col("features")).alias("total"))


def column_sums(long: DataFrame) -> DataFrame:
    return long.groupBy("feature").agg(F.sum("value").alias("total"))


def total_sum(long: DataFrame) -> DataFrame:
    return long.agg(F.sum("value").alias("total"))


def column_variance(long: DataFrame, n_rows: int | Column, ddof: int = 0) -> DataFrame:
    """Variance of each feature over n_rows rows; rows without an entry count as zeros."""
    n = F.lit(float(n_rows)) if isinstance(n_rows, int) else n_rows
    s, q = F.sum("value"), F.sum(F.col("value") * F.col("value"))
    return long.groupBy("feature").agg(((q - s * s / n) / (n - ddof)).alias("variance"))


def row_variance(df: DataFrame, ddof: int = 0) -> DataFrame:
    x = F.col("features")
    n = F.size(x).cast("double")
    mean = total(x) / n
    return df.select("id", (total(F.transform(x, lambda v: (v - mean) * (v - mean))) / (n - ddof)).alias("variance"))


def total_variance(long: DataFrame, cells: int, ddof: int = 0) -> DataFrame:
    s, q = F.sum("value"), F.sum(F.col("value") * F.col("value"))
    return long.agg(((q - s * s / cells) / (cells - ddof)).alias("variance"))


def count_nnz(df: DataFrame) -> DataFrame:
    return df.select("id", nnz(F.col("features")).cast("long").alias("nnz"))


def total_nnz(long: DataFrame) -> DataFrame:
    return long.agg(F.sum((F.col("value") != 0).cast("long")).alias("nnz"))


def most_variable(long: DataFrame, n_rows: int, n: int = 500) -> DataFrame:
    """feature, variance of the n features of the greatest variance (ties: lower feature first)."""
    return column_variance(long, n_rows).orderBy(F.desc("variance"), "feature").limit(n)


def shape(sparse: DataFrame) -> DataFrame:
    """One row: rows, columns, nnz."""
    return sparse.agg(F.count("*").alias("rows"), F.max("dim").cast("long").alias("columns"), F.sum(F.size("idx")).alias("nnz"))


def positions_by_value(df: DataFrame, value: str = "value", position: str = "position") -> DataFrame:
    """value, positions (sorted)."""
    return df.groupBy(F.col(value).alias("value")).agg(F.sort_array(F.collect_list(position)).alias("positions"))


def row_mode(df: DataFrame) -> DataFrame:
    """id, mode: the commonest value of each row's array; ties: the lowest value."""
    g = df.select("id", F.explode("features").alias("v")).groupBy("id", "v").agg(F.count("*").alias("n"))
    return g.groupBy("id").agg(F.max(F.struct("n", -F.col("v")))["col2"].alias("v")).select("id", (-F.col("v")).alias("mode"))


def unique_shared_features(named: DataFrame, least: int) -> DataFrame:
    """(file, feature) rows whose feature is unique in its file and found so in at least ``least`` files, with a common number."""
    once = named.groupBy("file", "feature").agg(F.count("*").alias("n")).filter("n = 1").select("file", "feature")
    shared = once.groupBy("feature").agg(F.count("*").alias("files")).filter(F.col("files") >= least).select("feature")
    return once.join(_numbered(shared, "feature", "number"), "feature").select("file", "feature", "number")


def box_sample(vertices: DataFrame, south: float, west: float, north: float, east: float, p_in: float = 0.99, p_out: float = 0.01, seed: int = 1) -> DataFrame:
    """Vertices (id, lat, lon) kept with one probability inside a box and another outside."""
    from centrova.functions.draws import uniform

    inside = F.col("lat").between(south, north) & F.col("lon").between(west, east)
    return vertices.filter(uniform(F.col("id"), 0, seed) < F.when(inside, p_in).otherwise(p_out))


def box_costs(costs: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """One row: shares of cost inside and outside a box, over (id, lat, lon, cost)."""
    inside = F.col("lat").between(south, north) & F.col("lon").between(west, east)
    s = F.sum("cost")
    return costs.agg((F.sum(F.when(inside, F.col("cost")).otherwise(0.0)) / s).alias("inside"), (F.sum(F.when(inside, 0.0).otherwise(F.col("cost"))) / s).alias("outside"))
