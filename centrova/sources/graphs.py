"""Readers of graphs: (src, dst, weight) edges and (id[, lat, lon]) vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from centrova.functions.draws import uniform
from centrova.functions.vectors import haversine


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """n, v: the lines of one file in order, n from 0; a file of lines is read by one task per split, numbered within and across."""
    from centrova.operators.matrix import _numbered

    from centrova.plans.iterate import saved

    raw = saved(spark.read.text(path).select(F.monotonically_increasing_id().alias("m"), F.trim("value").alias("v")))  # numbers are given once
    return raw.join(_numbered(raw, "m", "n"), "m").select("n", "v")


def read_adjacency(spark: SparkSession, path: str, random_weights: bool = False, seed: int = 0) -> DataFrame:
    """Edges of an adjacency file: header ``vertices edges [format]``, then the neighbours of vertex 1, 2, ... per line.

    Format 1 has a weight after every neighbour; else weights are 1, or 1 / u with random_weights.  An edge that both of its lines
    name is there in both directions once.
    """
    lines = _numbered_lines(spark, path).filter(~F.col("v").startswith("%"))
    first = lines.agg(F.min(F.struct("n", "v"))["v"].alias("v"), F.min("n").alias("n")).first()
    head = (first["v"] or "").split()
    if len(head) < 2 or (len(head) == 2 and head[1] == "0"):
        raise ValueError(f"{path}: the header does not give vertices and edges")
    n, weighted = int(head[0]), len(head) > 2 and head[2].endswith("1")
    body = lines.filter(F.col("n") > first["n"]).select((F.col("n") - first["n"] - 1).alias("src"), F.split("v", r"\s+").cast("array<double>").alias("t")).filter(F.col("src") < n)
    if weighted:
        pairs = F.transform(F.sequence(F.lit(0), (F.floor(F.size("t") / 2) - 1).cast("int")), lambda i: F.struct(F.get("t", i * 2).alias("d"), F.get("t", i * 2 + 1).alias("w")))
        e = body.filter(F.size("t") >= 2).select("src", F.explode(pairs).alias("p")).select("src", (F.col("p.d").cast("long") - 1).alias("dst"), F.col("p.w").alias("weight"))
    else:
        e = body.select("src", F.explode("t").alias("d")).filter("d is not null").select("src", (F.col("d").cast("long") - 1).alias("dst"), F.lit(1.0).alias("weight"))
    if random_weights:
        e = e.withColumn("weight", 1 / uniform(F.least("src", "dst") * 1_000_003 + F.greatest("src", "dst"), 0, seed))
    return e.groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def read_gr(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a shortest-path file: ``a src dst weight`` lines count from 1; an error for lines of unknown kind."""
    v = spark.read.text(path).select(F.trim("value").alias("v")).filter("v != ''")
    kind = F.substring("v", 1, 1)
    p = F.split("v", r"\s+")
    ok = F.when(kind.isin("a", "c", "p"), kind).otherwise(F.raise_error(F.concat(F.lit("unknown line: "), F.col("v"))))
    return v.filter(ok == "a").select((p[1].cast("long") - 1).alias("src"), (p[2].cast("long") - 1).alias("dst"), p[3].cast("double").alias("weight"))


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """id, lat, lon of comments ``c name->id lat lon``."""
    v = spark.read.text(path).select("value")
    g = [F.regexp_extract("value", r"->\s*(\d+)\s+(-?[\d.]+)\s+(-?[\d.]+)", i) for i in (1, 2, 3)]
    return v.filter(g[0] != "").select((g[0].cast("long") - 1).alias("id"), g[1].cast("double").alias("lat"), g[2].cast("double").alias("lon"))


def read_city_distances(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices id, state, place; edges) of a CSV of state1, place1, miles, state2, place2; a vertex is a (state, place)."""
    from centrova.operators.matrix import _numbered

    t = spark.read.csv(path, header=True)
    s1, p1, d, s2, p2 = t.columns[:5]
    key = lambda s, p: F.concat_ws("\t", F.col(s), F.col(p))
    e = t.select(key(s1, p1).alias("a"), key(s2, p2).alias("b"), F.col(d).cast("double").alias("weight"))
    ids = _numbered(e.select(F.col("a").alias("k")).union(e.select("b")), "k", "id")
    out = e.join(ids.select(F.col("k").alias("a"), F.col("id").alias("src")), "a").join(ids.select(F.col("k").alias("b"), F.col("id").alias("dst")), "b")
    part = F.split("k", "\t")
    return ids.select("id", part[0].alias("state"), part[1].alias("place")), out.select("src", "dst", "weight")


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges by the kind of file that the name says."""
    if path.endswith((".csv", ".csv.gz")):
        return read_city_distances(spark, path)[1]
    return read_gr(spark, path) if ".gr" in path and not path.endswith(".graph") else read_adjacency(spark, path)


def write_gr(vertices: int, edges: DataFrame, path: str) -> None:
    """A shortest-path file as a folder of text parts."""
    n = edges.count()
    head = edges.sparkSession.createDataFrame([(f"p sp {vertices} {n}",)], "value string").coalesce(1)
    head.union(edges.select(F.format_string("a %d %d %s", F.col("src") + 1, F.col("dst") + 1, F.col("weight").cast("string")).alias("value"))).write.text(path)


def write_adjacency(vertices: int, edges: DataFrame, path: str) -> None:
    """An adjacency file (format 1, weighted): a line per vertex in order, which one task writes."""
    spark = edges.sparkSession
    n = edges.filter("src < dst").count()
    entry = F.concat_ws(" ", (F.col("dst") + 1).cast("string"), F.col("weight").cast("string"))
    own = edges.withColumn("e", entry).groupBy("src").agg(F.concat_ws(" ", F.sort_array(F.collect_list(F.struct("dst", "e")))["e"]).alias("value"))
    lines = spark.range(vertices).withColumnRenamed("id", "src").join(own, "src", "left").select((F.col("src") + 1).alias("n"), F.coalesce("value", F.lit("")).alias("value"))
    head = spark.createDataFrame([(0, f"{vertices} {n} 1")], "n long, value string")
    head.union(lines).coalesce(1).sortWithinPartitions("n").select("value").write.text(path)


def read_osm(spark: SparkSession, path: str, highways: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes id, lat, lon; ways way, refs) of map files in XML: ways with a ``highway`` tag, of these kinds if given.

    A file is one task's, read element by element; split a large map into files.
    """
    from collections.abc import Iterator

    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import xml.etree.ElementTree as ET

        for g in frames:
            for content in g["content"]:
                rows = []
                for _, el in ET.iterparse(io.BytesIO(content)):
                    if el.tag == "node":
                        rows.append(("node", int(el.get("id")), float(el.get("lat")), float(el.get("lon")), None))
                        el.clear()
                    elif el.tag == "way":
                        kind = next((t.get("v") for t in el.iter("tag") if t.get("k") == "highway"), None)
                        if kind is not None and (highways is None or kind in highways):
                            rows.append(("way", int(el.get("id")), None, None, [int(r.get("ref")) for r in el.iter("nd")]))
                        el.clear()
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=["kind", "id", "lat", "lon", "refs"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["kind", "id", "lat", "lon", "refs"])

    found = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "kind string, id long, lat double, lon double, refs array<long>")
    return found.filter("kind = 'node'").select("id", "lat", "lon"), found.filter("kind = 'way'").select(F.col("id").alias("way"), "refs")


def read_stars(spark: SparkSession, path: str) -> DataFrame:
    """id, x, y, z of a star catalogue in CSV with a header, whatever its other columns."""
    t = spark.read.csv(path, header=True)
    return t.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z")]).filter("id is not null and x is not null and y is not null and z is not null")


def ways_to_edges(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Edges in metres between consecutive located nodes of ways: nodes (id, lat, lon), ways (way, refs)."""
    r = ways.select("way", F.posexplode("refs").alias("at", "id")).join(nodes, "id")
    w = W.partitionBy("way").orderBy("at")
    r = r.select("id", "lat", "lon", *[F.lag(c).over(w).alias(f"p_{c}") for c in ("id", "lat", "lon")]).filter("p_id is not null")
    e = r.select(F.col("p_id").alias("src"), F.col("id").alias("dst"), haversine(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")).alias("weight"))
    return e.groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def star_graph(stars: DataFrame, k: int) -> DataFrame:
    """Edges to the k nearest stars in space; stars (id, x, y, z)."""
    from centrova.operators.pairwise import neighbour_graph, neighbours

    return neighbour_graph(neighbours(stars.select("id", F.array("x", "y", "z").alias("features")), k, "L2"))


def spliced(city: DataFrame, roads: DataFrame, shift: int, anchors: DataFrame, miles: bool = True) -> DataFrame:
    """Road edges, their ids moved up by shift, joined to city edges (in miles) by anchor edges (src, dst, weight)."""
    scale = 1609.344 if miles else 1.0
    own = city.withColumn("weight", F.col("weight") * scale)
    moved = roads.select((F.col("src") + shift).alias("src"), (F.col("dst") + shift).alias("dst"), "weight")
    return own.select("src", "dst", "weight").union(moved).union(anchors.select("src", "dst", "weight"))
