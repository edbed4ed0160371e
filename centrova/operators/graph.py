"""Shortest paths, components and graph sampling over (src, dst, weight) edges, both directions present for undirected graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centrova.plans.iterate import saved


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst", "weight").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return e.groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """id, component: the least vertex that can be reached, edges taken both ways."""
    e = saved(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src != dst").distinct())
    label = saved(vertices.select("id", F.col("id").alias("component")).distinct())
    while True:
        near = e.join(label.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("m"))
        fell = label.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("component"))
        over = label.select(F.col("id").alias("component"), F.col("component").alias("further"))
        fell = saved(fell.join(over, "component").select("id", "old", F.least("component", "further").alias("component")))
        label = fell.select("id", "component")
        if fell.filter("old != component").limit(1).count() == 0:
            return label


def largest_component(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices and edges of the largest component (ties: least vertex), renumbered from 0; and (id, new_id)."""
    from centrova.operators.matrix import _numbered

    label = saved(components(edges, vertices))
    top = label.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    ids = _numbered(label.join(top, "component", "left_semi"), "id", "new_id")
    v = vertices.join(ids, "id").drop("id").withColumnRenamed("new_id", "id")
    e = edges.join(ids.select(F.col("id").alias("src"), F.col("new_id").alias("s")), "src").join(ids.select(F.col("id").alias("dst"), F.col("new_id").alias("d")), "dst")
    return v, e.select(F.col("s").alias("src"), F.col("d").alias("dst"), "weight"), ids


#: Rounds of relaxation after which what has fallen is merged into the known distances.
MERGE_EVERY = 6


def shortest_paths(edges: DataFrame, sources: DataFrame, by_source: bool = False, within: float | None = None) -> DataFrame:
    """id, dist, source of the nearest source (ties: least source), or with by_source a row per source and vertex it reaches.

    Rounds relax the edges out of the vertices that fell in the round before; only these move, and only these are written.  Every
    ``MERGE_EVERY`` rounds they are merged into the distances known, which is when those are written anew.
    """
    keys = ["id", "source"] if by_source else ["id"]
    least = F.min(F.struct("dist", "source")).alias("n")

    def merged(parts: list[DataFrame]) -> DataFrame:
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        best = every.groupBy(*keys).agg(least)
        return best.select("id", "n.dist", "n.source") if not by_source else best.select("id", F.col("n.dist").alias("dist"), "source")

    known = front = saved(sources.select("id", F.lit(0.0).alias("dist"), F.col("id").alias("source")).distinct())
    recent: list[DataFrame] = []
    while True:
        step = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id"), (F.col("dist") + F.col("weight")).alias("dist"), "source")
        if within is not None:
            step = step.filter(F.col("dist") <= within)
        own = merged([step])
        for i, seen in enumerate([known, merged(recent)] if recent else [known]):
            old = seen.select(*keys, F.struct("dist", "source").alias(f"old{i}"))
            own = own.join(old, keys, "left").filter(F.col(f"old{i}").isNull() | (F.struct("dist", "source") < F.col(f"old{i}"))).drop(f"old{i}")
        front = saved(own.select("id", "dist", "source"))
        if front.limit(1).count() == 0:
            return merged([known, *recent]) if recent else known
        recent.append(front)
        if len(recent) >= MERGE_EVERY:
            known, recent = saved(merged([known, *recent])), []


def distance_rows(edges: DataFrame, sources: DataFrame, only_sources: bool = False) -> DataFrame:
    """facility, client, dist from every source, to all vertices or to sources only."""
    d = shortest_paths(edges, sources, by_source=True).select(F.col("source").alias("facility"), F.col("id").alias("client"), "dist")
    return d.join(sources.select(F.col("id").alias("client")), "client", "left_semi").select("facility", "client", "dist") if only_sources else d


def thorup_graph(vertices: DataFrame, edges: DataFrame, k: int, seed: int = 0, eps: float = 0.5, rounds: int | None = None, weights: DataFrame | None = None) -> DataFrame:
    """id of sampled centers: batches of vertices, then those no farther than a random pivot are dropped.

    weights (id, weight): vertices are drawn in proportion to them, and W is their sum; else each counts once.
    """
    import math

    from centrova.operators.seeding import _draw

    own = vertices.select("id") if weights is None else vertices.select("id").join(weights, "id")
    left = saved(own.withColumn("weight", F.lit(1.0)) if weights is None else own.select("id", "weight"))
    n = max(left.agg(F.sum("weight").alias("w")).first()["w"] or 0.0, 2.0)
    batch = max(1, math.ceil(21 * k * math.log(n) / eps))
    rounds = math.ceil(3 * math.log(n)) if rounds is None else rounds
    spark, ids = vertices.sparkSession, []
    for r in range(rounds):
        if left.limit(batch + 1).count() <= batch:
            ids += [x["id"] for x in left.select("id").collect()]  # at most a batch
            break
        ids += _draw(left, F.col("weight"), batch, r, seed)
        chosen = spark.createDataFrame([(int(i),) for i in dict.fromkeys(ids)], "id long")
        dist = saved(left.join(shortest_paths(edges, chosen).select("id", "dist"), "id", "left").fillna(float("inf"), ["dist"]))
        pivot = _draw(dist, F.col("weight"), 1, 7000 + r, seed)[0]
        at = dist.filter(F.col("id") == pivot).first()["dist"]
        left = saved(dist.filter(F.col("dist") > at).select("id", "weight"))
        if left.limit(1).count() == 0:
            break
    return spark.createDataFrame([(int(i),) for i in dict.fromkeys(ids)], "id long")


def thorup_union(vertices: DataFrame, edges: DataFrame, k: int, times: int, seed: int = 0, **more) -> DataFrame:
    """id of the centers of any of several samples."""
    out = thorup_graph(vertices, edges, k, seed, **more)
    for t in range(1, times):
        out = out.union(thorup_graph(vertices, edges, k, seed + 101 * t, **more))
    return out.distinct()


def total_distance(vertices: DataFrame, edges: DataFrame, centers: DataFrame, weights: DataFrame | None = None) -> float:
    """The summed (weighted) distance of all vertices to their nearest center; infinite if one cannot be reached."""
    near = vertices.select("id").join(shortest_paths(edges, centers).select("id", "dist"), "id", "left").fillna(float("inf"), ["dist"])
    w = near.withColumn("weight", F.lit(1.0)) if weights is None else near.join(weights, "id")
    return w.agg(F.sum(F.col("weight") * F.col("dist")).alias("c")).first()["c"] or 0.0


def thorup_cheapest(vertices: DataFrame, edges: DataFrame, k: int, tries: int, seed: int = 0, **more) -> tuple[DataFrame, float]:
    """(centers, cost) of the sample that leaves the least summed distance."""
    found = [thorup_graph(vertices, edges, k, seed + 101 * t, **more) for t in range(max(1, tries))]
    costs = [total_distance(vertices, edges, c, more.get("weights")) for c in found]
    best = min(range(len(found)), key=costs.__getitem__)
    return found[best], costs[best]


def thorup_iterated(vertices: DataFrame, edges: DataFrame, k: int, iterations: int = 2, tries: int = 1, seed: int = 0, **more) -> DataFrame:
    """id, weight: samples of the sample, each center weighed by the vertices that it stands for, while the sample shrinks."""
    weights, at = None, vertices.select("id")
    size = at.count()
    for it in range(iterations):
        centers, _ = thorup_cheapest(at, edges, k, tries, seed + 1009 * it, weights=weights, **more)
        n = centers.count()
        if it and n >= size:
            break
        near = shortest_paths(edges, centers).join(at if weights is None else weights, "id")
        w = F.lit(1.0) if weights is None else F.col("weight")
        weights, size = saved(near.groupBy(F.col("source").alias("id")).agg(F.sum(w).alias("weight"))), n
        at = weights.select("id")
    return weights
