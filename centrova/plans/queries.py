"""The driver's queries: every operator on whole tables, with results that do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centrova import schema
from centrova.functions.measures import MEASURES
from centrova.operators import centroids, clustering, coreset, graph, lsh, matrix, metric, pairwise, sampling, seeding
from centrova.streaming import facility

Query = Callable[[SparkSession, str], DataFrame]
K = 5
SEED = 11


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return schema.points(_read(spark, sf, "embeddings"), "vec_id", "embedding")


def _centers(points: DataFrame, k: int = K) -> np.ndarray:
    """The rows of the ids 0 .. k - 1."""
    rows = points.filter(F.col("id") < k).orderBy("id").select("features").collect()
    return np.array([r["features"] for r in rows], float)


def priority_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of each priority by nation of the customer, as points."""
    facts = _read(spark, sf, "customer").join(_read(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    long = schema.counts(facts, "c_nationkey", "o_orderpriority")
    return schema.long_to_dense(long, 5).withColumn("weight", F.lit(1.0))


def part_supplier(spark: SparkSession, sf: str) -> DataFrame:
    """Long form of quantities: supplier by return flag and line status."""
    facts = _read(spark, sf, "lineitem").withColumn("kind", F.concat("l_returnflag", "l_linestatus"))
    return schema.counts(facts, "l_suppkey", "kind", F.col("l_quantity"))


def r6(c) -> F.Column:
    return F.round(c, 6)


def assign(which: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        p = embeddings(spark, sf)
        return pairwise.assign(p, _centers(p), which).select("id", F.col("cid").cast("long").alias("cid"), r6("cost").alias("cost"))

    return query


def pairs(which: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return pairwise.self_pairs(priority_counts(spark, sf), which, 1.0).select("i", "j", r6("dist").alias("dist"))

    return query


def compare_centers(spark: SparkSession, sf: str) -> DataFrame:
    p = embeddings(spark, sf)
    return pairwise.compare(p, p.filter(F.col("id") < K), "L1").select("i", "j", r6("dist").alias("dist"))


def lloyd_step(spark: SparkSession, sf: str) -> DataFrame:
    p = embeddings(spark, sf)
    m = centroids.mean_frame(pairwise.assign(p, _centers(p)))
    return m.select(F.col("cid").cast("long").alias("cid"), F.posexplode("features").alias("feature", "value")).select("cid", F.col("feature").cast("long").alias("feature"), r6("value").alias("value"))


def lloyd_two(spark: SparkSession, sf: str) -> DataFrame:
    p = embeddings(spark, sf)
    h = clustering.hard(p, _centers(p), eps=0.0, max_iterations=2)
    return h.assigned.groupBy(F.col("cid").cast("long").alias("cid")).agg(F.count("*").alias("n"), F.round(F.sum("cost"), 4).alias("cost"))


def knn(spark: SparkSession, sf: str) -> DataFrame:
    n = pairwise.neighbours(embeddings(spark, sf), 5)
    return n.select("id", "neighbour", F.col("rank").cast("long").alias("rank"), r6("dist").alias("dist"))


def row_sum(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.row_sums(embeddings(spark, sf)).select("id", r6("total").alias("total"))


def col_sum(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.column_sums(part_supplier(spark, sf)).select(F.col("feature").cast("long").alias("feature"), r6("total").alias("total"))


def col_var(spark: SparkSession, sf: str) -> DataFrame:
    long = part_supplier(spark, sf)
    n = long.select("id").distinct().count()
    return matrix.column_variance(long, n).select(F.col("feature").cast("long").alias("feature"), F.round("variance", 2).alias("variance"))


def row_var(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.row_variance(embeddings(spark, sf)).select("id", r6("variance").alias("variance"))


def hvg_topn(spark: SparkSession, sf: str) -> DataFrame:
    p = embeddings(spark, sf)
    top = matrix.most_variable(schema.dense_to_long(p), p.count(), 10)
    return top.select(F.col("feature").cast("long").alias("feature"), r6("variance").alias("variance"))


def nnz_per_row(spark: SparkSession, sf: str) -> DataFrame:
    return part_supplier(spark, sf).groupBy("id").agg(F.sum((F.col("value") != 0).cast("long")).alias("nnz"))


def counthist(spark: SparkSession, sf: str) -> DataFrame:
    h = matrix.positions_by_value(_read(spark, sf, "part"), "p_size", "p_partkey")
    return h.select(F.col("value").cast("long").alias("value"), F.size("positions").cast("long").alias("n"), F.element_at("positions", 1).alias("first"), F.element_at("positions", -1).alias("last"))


def argmaxcount(spark: SparkSession, sf: str) -> DataFrame:
    facts = _read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.col("l_linenumber").cast("double") % 3).alias("features"))
    return matrix.row_mode(facts)


def medians(kind: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        if kind == "tvd":
            members = priority_counts(spark, sf).withColumn("cid", (F.col("id") % 3).cast("int"))
            out = centroids.median_frame(members, shares=True)
        else:
            members = embeddings(spark, sf).withColumn("cid", (F.col("id") % 3).cast("int")).withColumn("weight", (F.col("id") % 7 + 1).cast("double"))
            out = centroids.weighted_median_frame(members) if kind == "weighted" else centroids.median_frame(members)
        return out.select(F.col("cid").cast("long").alias("cid"), F.posexplode("features").alias("feature", "value")).select("cid", F.col("feature").cast("long").alias("feature"), r6("value").alias("value"))

    return query


def geomedian(spark: SparkSession, sf: str) -> DataFrame:
    p = embeddings(spark, sf).withColumn("cid", F.lit(0))
    c = centroids.geometric_medians(p, centroids.means(p, 1), eps=0.0, max_iterations=3)
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(c[0])], "feature long, value double")


def _costed(spark: SparkSession, sf: str) -> DataFrame:
    p = embeddings(spark, sf).withColumn("weight", (F.col("id") % 4 + 1).cast("double"))
    return pairwise.assign(p, _centers(p)).select("id", "cid", "cost", "weight")


def coreset_probs(method: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return coreset.sensitivities(_costed(spark, sf), method, K).select("id", F.round("prob", 9).alias("prob"))

    return query


def coreset_sample(spark: SparkSession, sf: str) -> DataFrame:
    probs = coreset.sensitivities(_costed(spark, sf), "BFL", K)
    return coreset.sample(probs, 50, SEED, unique=True).select("id", F.round("weight", 4).alias("weight"))


def uniform_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.uniform_coreset(_read(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), 100, SEED).select("id", r6("weight").alias("weight"))


def _ids(spark: SparkSession, ids: list[int]) -> DataFrame:
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "place long, id long")


def kmeanspp(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(spark, seeding.kmeanspp(embeddings(spark, sf), 3, seed=SEED).ids)


def kcenter(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(spark, seeding.kcenter(embeddings(spark, sf), 4, first=0).ids)


def localsearch_delta(spark: SparkSession, sf: str) -> DataFrame:
    p = embeddings(spark, sf)
    costed = pairwise.assign(p, _centers(p), second=True)
    row = np.array([p.filter("id = 17").first()["features"]], float)
    change = seeding.swap_changes(costed, row, "SQRL2", 0.0)
    gain = sum(change["gain"])
    return spark.createDataFrame([(i, round(gain + loss, 4)) for i, loss in enumerate(change["loss"])], "cid long, delta double")


def soft_responsibilities(spark: SparkSession, sf: str) -> DataFrame:
    p = embeddings(spark, sf)
    s = clustering.responsibilities(p, _centers(p), temperature=2.0)
    return s.select("id", F.posexplode("resp").alias("cid", "resp")).select("id", F.col("cid").cast("long").alias("cid"), r6("resp").alias("resp"))


def distortion(spark: SparkSession, sf: str) -> DataFrame:
    p = embeddings(spark, sf)
    core = coreset.sample(coreset.sensitivities(_costed(spark, sf), "BFL", K), 50, SEED, unique=True)
    d = coreset.distortion(p.withColumn("weight", (F.col("id") % 4 + 1).cast("double")), core, [_centers(p)])
    return d.select(F.round("full", 3).alias("full_cost"), F.round("estimate", 3).alias("estimate"))


def erase_empty(spark: SparkSession, sf: str) -> DataFrame:
    long = part_supplier(spark, sf).withColumn("value", F.greatest(F.col("value") - 1000, F.lit(0.0)))
    out, _, _ = matrix.erase_empty(long)
    return out.select("id", F.col("feature").cast("long").alias("feature"), r6("value").alias("value"))


def submatrix(spark: SparkSession, sf: str) -> DataFrame:
    s = matrix.submatrix(embeddings(spark, sf), [3, 1, 3], [0, 5, 5])
    return s.select(F.col("place").cast("long").alias("place"), F.posexplode("features").alias("feature", "value")).select("place", F.col("feature").cast("long").alias("feature"), r6("value").alias("value"))


def concat(spark: SparkSession, sf: str) -> DataFrame:
    long = part_supplier(spark, sf)
    c = matrix.concat([long, matrix.transpose(long).select("id", F.col("feature").cast("int").alias("feature"), "value")])
    return c.groupBy(F.col("part").cast("long").alias("part")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def normalised_columns(spark: SparkSession, sf: str) -> DataFrame:
    n = matrix.normalise_columns(part_supplier(spark, sf))
    return n.groupBy(F.col("feature").cast("long").alias("feature")).agg(r6(F.sum("value")).alias("total"))


def place_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges: customers to nations (weight 1), nations to regions (weight 2)."""
    c, n = _read(spark, sf, "customer"), _read(spark, sf, "nation")
    e = c.select((F.col("c_custkey") + 1000).alias("src"), (F.col("c_nationkey").cast("long") + 100).alias("dst"), F.lit(1.0).alias("weight"))
    e = e.union(n.select((F.col("n_nationkey").cast("long") + 100), F.col("n_regionkey").cast("long"), F.lit(2.0)))
    v = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return v, graph.both_ways(e)


def components(spark: SparkSession, sf: str) -> DataFrame:
    v, e = place_graph(spark, sf)
    return graph.components(e, v)


def sssp(spark: SparkSession, sf: str) -> DataFrame:
    v, e = place_graph(spark, sf)
    return graph.shortest_paths(e, v.filter(F.col("id").isin(0, 1))).select("id", r6("dist").alias("dist"), "source")


def spanning_tree(spark: SparkSession, sf: str) -> DataFrame:
    e = pairwise.self_pairs(priority_counts(spark, sf), "L1").select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("dist").alias("weight"))
    return pairwise.spanning_forest(e)


def lsh_candidates(spark: SparkSession, sf: str) -> DataFrame:
    p = embeddings(spark, sf)
    base = lsh.index(p, lsh.Tables(64, 4, 8, "L2", 1.0, seed=SEED))
    return lsh.top_candidates(base, base, 3)


def kmedian_exhaustive(spark: SparkSession, sf: str) -> DataFrame:
    d = pairwise.compare(priority_counts(spark, sf), priority_counts(spark, sf), "TVD", 1.0).select(F.col("i").alias("facility"), F.col("j").alias("client"), "dist")
    return spark.createDataFrame([(round(metric.solve(d, 2, "exhaustive").cost, 6),)], "cost double")


def minibatch(spark: SparkSession, sf: str) -> DataFrame:
    p = embeddings(spark, sf)
    return clustering.minibatch(p, _centers(p), 200, rounds=4, check_every=2, seed=SEED).assigned.select("id", F.col("cid").cast("long").alias("cid"))


def hierarchical(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.hierarchical(embeddings(spark, sf), 4, seed=SEED)


def streaming_ofl(spark: SparkSession, sf: str) -> DataFrame:
    return facility.facilities(embeddings(spark, sf), facility.kmeans_stream(4, n=10_000, seed=SEED), 4).select("shard", "facility", "weight")


def thorup_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(spark, seeding.thorup(embeddings(spark, sf), 2, seed=SEED)[0].ids)


def kcenter_coreset(spark: SparkSession, sf: str) -> DataFrame:
    return coreset.kcenter_coreset(embeddings(spark, sf), 3, 1.0, 1.0, 0.02, seed=SEED)


def measure_registry(spark: SparkSession, sf: str) -> DataFrame:
    from centrova.functions.measures import registry

    return registry(spark)


PAIR_MEASURES = tuple(MEASURES)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {f"assign_{m.lower()}": assign(m) for m in ("SQRL2", "L1", "L2", "COSINE_DISTANCE")}
    out |= {f"pairwise_{m.lower()}": pairs(m) for m in PAIR_MEASURES}
    out |= {f"coreset_probs_{m.lower()}": coreset_probs(m) for m in ("BFL", "VX", "LBK", "FL", "LFKF")}
    out |= {"l1_median": medians("l1"), "weighted_median": medians("weighted"), "tvd_median": medians("tvd"), "geomedian_3_steps": geomedian}
    out |= {"compare_l1": compare_centers, "lloyd_step": lloyd_step, "lloyd_2_iter": lloyd_two, "knn_k5": knn, "row_sum": row_sum, "col_sum": col_sum, "col_var": col_var, "row_var": row_var, "hvg_topn": hvg_topn, "nnz_per_row": nnz_per_row}
    out |= {"counthist": counthist, "argmaxcount": argmaxcount, "coreset_sample_parity": coreset_sample, "uniform_coreset": uniform_sample, "kmeanspp_parity": kmeanspp, "kcenter_greedy": kcenter, "localsearchpp_delta": localsearch_delta}
    out |= {"soft_responsibilities": soft_responsibilities, "distortion": distortion, "erase_empty": erase_empty, "submatrix": submatrix, "concat": concat, "normalised_columns": normalised_columns, "components": components, "sssp": sssp, "spanning_tree": spanning_tree}
    out |= {"lsh_candidates": lsh_candidates, "kmedian_exhaustive": kmedian_exhaustive, "minibatch": minibatch, "hierarchical": hierarchical, "streaming_ofl": streaming_ofl}
    out |= {"thorup_sample": thorup_sample, "kcenter_coreset": kcenter_coreset, "measure_registry": measure_registry}
    from centrova.plans import more

    return out | more.queries()
