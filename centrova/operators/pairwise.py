"""Distances between rows: all pairs, nearest centers, nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centrova.functions import screens
from centrova.functions.measures import block_distance, distance, measure
from centrova.plans.iterate import CENTER_VALUES, saved

#: Rows of one side that a block of a blocked pair operator holds.
BLOCK_ROWS = 4096
#: Values and rows of one side that a group of ``neighbours`` holds, and the parts that a side has at least if it has so many blocks.
NEAR_VALUES, NEAR_ROWS, NEAR_PARTS = 4_000_000, 65_536, 8


def matrix_of(column: pa.Array) -> np.ndarray:
    """A list array of equal lengths as a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 0))


def compare(matrix: DataFrame, data: DataFrame, which="SQRL2", prior: float = 0.0, reverse: bool = False) -> DataFrame:
    """i, j, dist of every row i of matrix and j of data: measure(data_j, matrix_i), or the other way round if reverse.

    The result has as many rows as pairs, so this is for a large side against a stated small one.  A side of up to ``BLOCK_ROWS`` rows
    goes to every task over the other; above that both sides are cut in blocks, and a pair of blocks meets in one tile.
    """
    m = measure(which)
    side = data.select(F.col("id").alias("j"), F.col("features").alias("y"))
    x, y = (F.col("x"), F.col("y")) if reverse else (F.col("y"), F.col("x"))
    left = matrix.select(F.col("id").alias("i"), F.col("features").alias("x"))
    if m.block is None:
        return left.join(side).select("i", "j", distance(m, x, y, prior).alias("dist"))
    if data.limit(BLOCK_ROWS + 1).count() <= BLOCK_ROWS:
        return _against_few(matrix, data, m, prior, reverse, False)
    tiles = blocks_of(matrix, "l").join(blocks_of(data, "r"))
    return tiles.mapInArrow(_tile(m, prior, reverse, False), "i long, j long, dist double")


def blocks_of(df: DataFrame, name: str) -> DataFrame:
    """A row per block of about ``BLOCK_ROWS`` rows: its number, ids and features, under names that begin with ``name``."""
    n = -(-df.count() // BLOCK_ROWS)
    block = F.pmod(F.xxhash64("id"), F.lit(max(n, 1))).alias(f"{name}b")
    both = F.sort_array(F.collect_list(F.struct("id", "features"))).alias("rows")
    return df.groupBy(block).agg(both).select(f"{name}b", F.col("rows.id").alias(f"{name}ids"), F.col("rows.features").alias(f"{name}rows"))


def _against_few(matrix: DataFrame, data: DataFrame, m, prior: float, reverse: bool, upper: bool) -> DataFrame:
    """``compare`` with a broadcast side; upper: pairs i < j only."""
    rows = data.select("id", "features").orderBy("id").collect()  # bounded by BLOCK_ROWS
    left = matrix.select(F.col("id").alias("i"), F.col("features").alias("x"))
    if not rows:
        return left.select("i").withColumn("j", F.lit(None).cast("long")).withColumn("dist", F.lit(None).cast("double")).limit(0)
    sent = matrix.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in rows]), np.array([r["features"] for r in rows], float)))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        jj, c = sent.value
        for b in batches:
            step = max(1, 1_000_000 // len(jj))
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                yield from _pairs_of(m, prior, reverse, upper, part.column(0).to_numpy(), matrix_of(part.column(1)), jj, c)

    return left.mapInArrow(near, "i long, j long, dist double")


def _pairs_of(m, prior: float, reverse: bool, upper: bool, ii: np.ndarray, a: np.ndarray, jj: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
    if upper and len(ii):
        c, jj = c[jj > ii.min()], jj[jj > ii.min()]
    if not len(ii) or not len(jj):
        return
    d = block_distance(m, a, c, prior) if reverse else block_distance(m, c, a, prior).T
    i, j, d = np.repeat(ii, len(jj)), np.tile(jj, len(ii)), d.ravel()
    keep = i < j if upper else slice(None)
    yield pa.RecordBatch.from_arrays([pa.array(i[keep]), pa.array(j[keep]), pa.array(d[keep])], ["i", "j", "dist"])


def _tile(m, prior: float, reverse: bool, upper: bool):
    """Pairs of a tile (lb, lids, lrows, rb, rids, rrows), some rows of the left block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in range(b.num_rows):
                ii, a, jj, c = b.column(1)[t].values.to_numpy(), matrix_of(b.column(2)[t].values), b.column(4)[t].values.to_numpy(), matrix_of(b.column(5)[t].values)
                sides = [(ii, a, jj, c)]
                if upper and b.column(0)[t].as_py() != b.column(3)[t].as_py():
                    sides.append((jj, c, ii, a))  # each pair the way round in which i < j
                for ii, a, jj, c in sides:
                    step = max(1, 1_000_000 // len(jj))
                    for lo in range(0, len(ii), step):
                        yield from _pairs_of(m, prior, reverse, upper, ii[lo : lo + step], a[lo : lo + step], jj, c)

    return run


def self_pairs(matrix: DataFrame, which="SQRL2", prior: float = 0.0) -> DataFrame:
    """i, j, dist for i < j: measure(row_i, row_j); of two blocks of rows one tile is looked at, not both."""
    m = measure(which)
    if m.block is None:
        return compare(matrix, matrix, which, prior, reverse=True).filter("i < j")
    if matrix.limit(BLOCK_ROWS + 1).count() <= BLOCK_ROWS:
        return _against_few(matrix, matrix, m, prior, True, True)
    tiles = blocks_of(matrix, "l").join(blocks_of(matrix, "r"), F.col("lb") <= F.col("rb"))
    return tiles.mapInArrow(_tile(m, prior, True, True), "i long, j long, dist double")


def condensed_position(i: str, j: str, n: int):
    """The place of (i, j), i < j < n, in the vector of self pairs."""
    return F.col(i) * n - F.col(i) * (F.col(i) + 1) / 2 + F.col(j) - F.col(i) - 1


def distance_matrix(matrix: DataFrame, which="SQRL2", prior: float = 0.0, symmetric: bool = False) -> DataFrame:
    """i, j, dist of all pairs; symmetric: both ways from the pairs i < j."""
    from centrova.operators.matrix import mirror

    return mirror(self_pairs(matrix, which, prior)) if symmetric else compare(matrix, matrix, which, prior, reverse=True)


def assign(points: DataFrame, centers: np.ndarray, which="SQRL2", prior: float = 0.0, second: bool = False) -> DataFrame:
    """All columns of points, and cid, cost of the nearest center: measure(point, center), ties to the lowest cid.

    second: also cid2, cost2 of the next nearest.  One pass without a join or shuffle; centers go to every worker.  More than
    ``CENTER_VALUES`` values of centers go in blocks, one pass after the other over what the blocks before have found.
    """
    m, centers = measure(which), np.asarray(centers, float)
    if m.block is None:
        return _assign_by_column(points, centers, m, prior, second)
    rows = max(1, CENTER_VALUES // max(1, centers.shape[1] if centers.ndim > 1 else 1))
    out = _assign_block(points, centers[:rows], 0, m, prior, second, False)
    for at in range(rows, len(centers), rows):
        out = _assign_block(saved(out), centers[at : at + rows], at, m, prior, second, True)
    return out


def _assign_block(points: DataFrame, centers: np.ndarray, first: int, m, prior: float, second: bool, more: bool) -> DataFrame:
    """Nearest centers among a block that begins with cid ``first``; more: beside those that points already name."""
    sign = -1.0 if m.similarity else 1.0
    sent = points.sparkSession.sparkContext.broadcast(centers)
    found = ["cid", "cost", *(["cid2", "cost2"] if second else [])]
    names = [c for c in points.columns if not (more and c in found)]
    at = names.index("features")
    own = points.select(*names, *found) if more else points

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        step = max(1, 2_000_000 // max(1, c.size // max(1, len(c)), len(c)))
        for b in batches:
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                x = matrix_of(part.column(at))
                d = sign * block_distance(m, x, c, prior)
                d = np.where(np.isnan(d), np.inf, d)
                cid = np.broadcast_to(np.arange(first, first + len(c)), d.shape)
                if more:
                    before = [i for i, name in enumerate(found) if name.startswith("cid")]
                    d = np.concatenate([np.stack([sign * part.column(len(names) + i + 1).to_numpy() for i in before], axis=1), d], axis=1)
                    cid = np.concatenate([np.stack([part.column(len(names) + i).to_numpy() for i in before], axis=1), cid], axis=1)
                    if second:  # the next nearest of few centers may be none
                        d[:, 1] = np.where(np.isnan(d[:, 1]), np.inf, d[:, 1])
                out, rows = [], np.arange(len(d))
                for _ in range(2 if second else 1):
                    best = d.argmin(axis=1)
                    out += [pa.array(cid[rows, best].astype(np.int32)), pa.array(sign * d[rows, best])]
                    d[rows, best] = np.inf
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *out], [*names, *found])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema if f.name in names) + ", cid int, cost double" + (", cid2 int, cost2 double" if second else "")
    return own.mapInArrow(run, schema)


def _assign_by_column(points: DataFrame, centers: np.ndarray, m, prior: float, second: bool) -> DataFrame:
    """The same for a measure given as a function of Columns: a block of centers is one array of structs beside every row."""
    from centrova.plans.iterate import center_frame

    rows = max(1, CENTER_VALUES // max(1, centers.shape[1] if centers.ndim > 1 else 1))
    out = points.withColumn("__best", F.array().cast("array<struct<cost:double,cid:int>>"))
    for at in range(0, len(centers), rows):
        out = out if at == 0 else saved(out)
        frame = center_frame(points.sparkSession, centers[at : at + rows]).withColumn("cid", F.col("cid") + at)
        c = frame.agg(F.collect_list(F.struct("cid", "features")).alias("__centers"))
        costs = F.transform("__centers", lambda c: F.struct(distance(m, F.col("features"), c["features"], prior).alias("cost"), c["cid"].alias("cid")))
        out = out.join(F.broadcast(c)).withColumn("__best", F.slice(F.array_sort(F.concat("__best", costs)), 1, 2)).drop("__centers")
    for i, (cid, cost) in enumerate([("cid", "cost"), ("cid2", "cost2")][: 2 if second else 1]):
        out = out.withColumn(cid, F.get("__best", F.lit(i))["cid"]).withColumn(cost, F.get("__best", F.lit(i))["cost"])
    return out.drop("__best")


def oracle_assign(distances: DataFrame) -> DataFrame:
    """client, facility, dist of the nearest facility of each client, ties to the lowest; over (facility, client, dist)."""
    best = distances.groupBy("client").agg(F.min(F.struct("dist", "facility")).alias("b"))
    return best.select("client", F.col("b.facility").alias("facility"), F.col("b.dist").alias("dist"))


def _parts(rows: DataFrame, wide: int) -> int:
    """Parts of one side of ``neighbours``: some for all cores, unless rows are few, and more where a part would be too large."""
    n = rows.count()
    return max(1, -(-n * wide // NEAR_VALUES), -(-n // NEAR_ROWS), min(NEAR_PARTS, -(-n // BLOCK_ROWS)))


def neighbours(points: DataFrame, k: int, which="SQRL2", prior: float = 0.0, queries: DataFrame | None = None) -> DataFrame:
    """id, neighbour, dist, rank (1 to k) of the k nearest other rows; ties to the lower id.

    The base is dealt to blocks and the queries to tiles; a block meets a tile in one group, where only the k best of each query leave
    the task, and they meet in one more selection.  A group holds up to ``NEAR_VALUES`` values of either side, so what is moved is
    both sides as often as the square root of the groups.  Euclidean distances are first bounded by a matrix product, see ``screens``.
    """
    q = points if queries is None else queries
    m = measure(which)
    sign = -1.0 if m.similarity else 1.0
    wide = points.select(F.max(F.size("features"))).first()[0] or 1
    n_blocks, n_tiles = _parts(points, wide), _parts(q, wide)
    base = points.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("b"), F.col("id"), "features")
    asked = q.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"), "id", "features")
    asked = asked.withColumn("t", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(n_tiles)).cast("int"))
    base = base.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))))

    def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
        qi, x = a.column("id").to_numpy(), matrix_of(a.column("features").combine_chunks())
        bi, y = b.column("id").to_numpy(), matrix_of(b.column("features").combine_chunks())
        row, near, dist = screens.k_nearest(m, prior, x, qi, y, bi, k)
        return pa.table({"id": pa.array(qi[row], pa.int64()), "neighbour": pa.array(near, pa.int64()), "dist": pa.array(sign * dist, pa.float64())})

    found = asked.groupBy("b", "t").cogroup(base.groupBy("b", "t")).applyInArrow(run, "id long, neighbour long, dist double")
    key = F.struct((F.lit(sign) * F.col("dist")).alias("s"), "neighbour", "dist")
    best = found.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(key)), 1, k).alias("best"))
    return best.select("id", F.posexplode("best").alias("rank", "b")).select("id", F.col("b.neighbour").alias("neighbour"), F.col("b.dist").alias("dist"), (F.col("rank") + 1).alias("rank"))


def neighbour_graph(knn: DataFrame) -> DataFrame:
    """src, dst, weight: an undirected edge, lower id first, per neighbour pair."""
    e = knn.select(F.least("id", "neighbour").alias("src"), F.greatest("id", "neighbour").alias("dst"), F.col("dist").alias("weight"))
    return e.groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """src, dst, weight of a minimum spanning forest (ties: by ends), by rounds in which every tree takes its lightest edge out.

    A tree then points to the one it took its edge to; following pointers until they end names the merged trees, so a round costs a
    few joins over trees, of which there are at most half as many after it.
    """
    label = saved(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().select("id", F.col("id").alias("c")))
    edges, tree = saved(edges), None
    while True:
        a, b = (label.select(F.col("id").alias(x), F.col("c").alias(f"c_{x}")) for x in ("src", "dst"))
        out = edges.join(a, "src").join(b, "dst").filter("c_src != c_dst")
        e = F.struct("weight", "src", "dst")
        both = out.select(F.col("c_src").alias("c"), F.col("c_dst").alias("to"), e.alias("e")).union(out.select(F.col("c_dst").alias("c"), F.col("c_src").alias("to"), e.alias("e")))
        took = saved(both.groupBy("c").agg(F.min(F.struct("e", "to")).alias("m")).select("c", "m.e.*", "m.to"))
        if took.limit(1).count() == 0:
            return tree if tree is not None else edges.limit(0).select("src", "dst", "weight")
        new = took.select("src", "dst", "weight").distinct()
        tree = saved(new if tree is None else tree.union(new))
        # Two trees that took the same edge point to each other; the lesser one is the end.
        back = took.select(F.col("c").alias("to"), F.col("to").alias("back"))
        at = took.join(back, "to").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to"))
        at = saved(at)
        while True:
            on = at.select(F.col("c").alias("to"), F.col("to").alias("further"))
            nxt = saved(at.join(on, "to").select("c", "to", "further"))
            at = nxt.select("c", F.col("further").alias("to"))
            if nxt.filter("to != further").limit(1).count() == 0:
                break
        label = saved(label.join(at, "c", "left").select("id", F.coalesce("to", "c").alias("c")))


def triangle_factor(points: DataFrame, which="SQRL2", prior: float = 0.0, triples: int = 1000, seed: int = 1) -> DataFrame:
    """One row, alpha: the greatest longest / (sum of the other two) over sampled triples of rows."""
    from centrova.functions.draws import uniform

    n = points.count()
    from centrova.operators.matrix import _numbered

    places = _numbered(points, "id", "place").join(points, "id").select("place", "features")
    draws = points.sparkSession.range(triples).select("id", *[F.floor(uniform(F.col("id"), r, seed) * n).alias(f"p{r}") for r in range(3)]).filter("p0 != p1 and p1 != p2 and p0 != p2")
    for r in range(3):
        draws = draws.join(places.select(F.col("place").alias(f"p{r}"), F.col("features").alias(f"x{r}")), f"p{r}")
    d = [distance(which, F.col(f"x{a}"), F.col(f"x{b}"), prior) for a, b in ((0, 1), (1, 2), (0, 2))]
    t = draws.select(*[v.alias(f"d{i}") for i, v in enumerate(d)])
    top = F.greatest("d0", "d1", "d2")
    rest = F.col("d0") + F.col("d1") + F.col("d2") - top
    return t.filter(rest > 0).agg(F.max(top / rest).alias("alpha"))
