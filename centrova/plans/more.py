"""Further queries, each beside its SQL: selection, reshaping, sparse operands, draws, readers and writers, front ends."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centrova import api, schema
from centrova.functions import measures, vectors
from centrova.functions.draws import uniform, uniform_sql
from centrova.operators import centroids, clustering, coreset, graph, matrix, metric, pairwise, sampling, seeding, sparse
from centrova.plans import oracles as o
from centrova.plans import queries as q
from centrova.plans.iterate import checkpoint_folder
from centrova.sources import graphs, matrices

K, SEED = q.K, q.SEED
r6 = q.r6
TABLE: dict[str, tuple[q.Query, str | None]] = {}


def query(sql: str | None = None):
    """Enter a query with its SQL; its name is the function's."""

    def enter(f: q.Query) -> q.Query:
        TABLE[f.__name__] = f, sql
        return f

    return enter


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/files/{uuid.uuid4().hex}"


def _long(df: DataFrame, *keys: str) -> DataFrame:
    """keys, feature, value of dense rows."""
    return df.select(*keys, F.posexplode("features").alias("feature", "value")).select(*keys, F.col("feature").cast("long").alias("feature"), r6("value").alias("value"))


def _supplier(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse rows: large quantities by supplier and kind of line."""
    return schema.long_to_sparse(q.part_supplier(spark, sf).filter("value > 2550"), 16).withColumn("weight", F.lit(1.0))


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return schema.dense_to_sparse(q.priority_counts(spark, sf))


def _tvd(spark: SparkSession, sf: str) -> DataFrame:
    p = q.priority_counts(spark, sf)
    return pairwise.compare(p, p, "TVD", 1.0).select(F.col("i").alias("facility"), F.col("j").alias("client"), "dist")


def _places(spark: SparkSession, sf: str) -> DataFrame:
    """id, lat, lon, cost of customers, placed by their keys."""
    c = q._read(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 90).cast("double").alias("lat"), (F.col("c_custkey") * 7 % 180).cast("double").alias("lon"), F.abs("c_acctbal").alias("cost"))


PLACED = "pl AS (SELECT c_custkey AS id, (c_custkey % 90)::DOUBLE AS lat, (c_custkey * 7 % 180)::DOUBLE AS lon, abs(c_acctbal) AS cost FROM customer)"
TVD_ALL = f"{o.COUNTS}, t AS (SELECT a.id AS i, b.id AS j, sum(abs(a.p - b.p)) / 2 AS d FROM pr a JOIN pr b USING (f) GROUP BY 1, 2)"
LARGE = f"{o.SUPPLIER}, x AS (SELECT id, f, v FROM l WHERE v > 2550), ids AS (SELECT DISTINCT id FROM x), full_x AS (SELECT i.id, c.f, coalesce(x.v, 0) AS v FROM ids i CROSS JOIN range(16) c(f) LEFT JOIN x ON x.id = i.id AND x.f = c.f)"
NEAREST = f"{o.EMB}, {o._dist('SQRL2')}, {o.BEST}"

# Selection and reshaping.


@query(f"WITH {o.EMB} SELECT id FROM e WHERE f = 0 AND v > 0")
def rows_if(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.rows_if(q.embeddings(spark, sf), F.col("features")[0] > 0).select("id")


@query(f"WITH {o.SUPPLIER}, k AS (SELECT f FROM l GROUP BY f HAVING max(v) > 2550) SELECT f::BIGINT AS feature, count(*) AS n, round(sum(v), 4) AS total FROM l WHERE f IN (SELECT f FROM k) GROUP BY f")
def columns_if(spark: SparkSession, sf: str) -> DataFrame:
    kept = matrix.columns_if(q.part_supplier(spark, sf), F.max("value") > 2550)
    return kept.groupBy(F.col("feature").cast("long").alias("feature")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {LARGE} SELECT p.place, x.f::BIGINT AS feature, round(x.v, 6) AS value FROM (VALUES (0::BIGINT, 5), (1, 3), (2, 5)) p(place, id) JOIN x USING (id)")
def sparse_rows(spark: SparkSession, sf: str) -> DataFrame:
    s = matrix.select_rows(_supplier(spark, sf), [5, 3, 5])
    return s.select(F.col("place").cast("long").alias("place"), F.explode(F.arrays_zip("idx", "val")).alias("e")).select("place", F.col("e.idx").cast("long").alias("feature"), r6("e.val").alias("value"))


@query(f"WITH {o.EMB}, n AS (SELECT id, sqrt(sum(v * v)) AS n FROM e GROUP BY id) SELECT id, f::BIGINT AS feature, round(v / n, 6) AS value FROM e JOIN n USING (id)")
def normalised_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _long(matrix.normalise_rows(q.embeddings(spark, sf)), "id")


@query(f"WITH {o.COUNTS} SELECT g.id, dense_rank() OVER (ORDER BY g.f) - 1 AS feature, round(g.v / s.s, 6) AS value FROM g JOIN s USING (id)")
def row_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _long(matrix.row_shares(q.priority_counts(spark, sf)), "id")


@query(f"WITH {o.COUNTS} SELECT g.id, dense_rank() OVER (ORDER BY g.f) - 1 AS feature, round(g.v * 2.5, 6) AS value FROM g")
def scaled(spark: SparkSession, sf: str) -> DataFrame:
    """Through the sparse form and back."""
    s = _counts(spark, sf).withColumn("val", vectors.scale(F.col("val"), 2.5))
    return _long(schema.sparse_to_dense(s), "id")


@query(f"WITH {o.COUNTS} SELECT a.id AS i, b.id AS j, round(sum(abs(a.v - b.v)), 6) AS dist FROM g a JOIN g b USING (f) GROUP BY 1, 2")
def distance_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return pairwise.distance_matrix(q.priority_counts(spark, sf), "L1", symmetric=True).select("i", "j", r6("dist").alias("dist"))


@query(f"WITH {TVD_ALL} SELECT i AS facility, j AS client, round(pow(d, 2) * (j % 3 + 1), 9) AS dist FROM t")
def weighted_powers(spark: SparkSession, sf: str) -> DataFrame:
    w = q.priority_counts(spark, sf).select(F.col("id").alias("client"), (F.col("id") % 3 + 1).cast("double").alias("weight"))
    return matrix.client_weighted(matrix.powered(_tvd(spark, sf), 2.0), w).select("facility", "client", F.round("dist", 9).alias("dist"))


@query(f"WITH {PLACED} SELECT id FROM pl WHERE {uniform_sql('id', 0, SEED)} < CASE WHEN lat BETWEEN 20 AND 50 AND lon BETWEEN 40 AND 120 THEN 0.9 ELSE 0.1 END")
def box_sample(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.box_sample(_places(spark, sf), 20, 40, 50, 120, 0.9, 0.1, SEED).select("id")


@query(f"WITH {PLACED} SELECT round(sum(cost) FILTER (lat BETWEEN 20 AND 50 AND lon BETWEEN 40 AND 120) / sum(cost), 9) AS inside, round(sum(cost) FILTER (NOT (lat BETWEEN 20 AND 50 AND lon BETWEEN 40 AND 120)) / sum(cost), 9) AS outside FROM pl")
def box_costs(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.box_costs(_places(spark, sf), 20, 40, 50, 120).select(F.round("inside", 9).alias("inside"), F.round("outside", 9).alias("outside"))


_COMPONENT = f"{o.PLACES}, r AS (SELECT DISTINCT a AS id, a AS c FROM be UNION SELECT be.b, r.c FROM r JOIN be ON be.a = r.id AND r.c < 100), c AS (SELECT id, min(c) AS c FROM r GROUP BY id)"


@query(f"WITH RECURSIVE {_COMPONENT}, top AS (SELECT c FROM c GROUP BY c ORDER BY count(*) DESC, c LIMIT 1) SELECT id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM c WHERE c IN (SELECT c FROM top)")
def largest_component(spark: SparkSession, sf: str) -> DataFrame:
    v, e = q.place_graph(spark, sf)
    return graph.largest_component(v, e)[2].select("id", F.col("new_id").cast("long").alias("new_id"))


@query(f"WITH {LARGE} SELECT id, count(*) AS n FROM x GROUP BY id HAVING count(*) >= 2 ORDER BY id LIMIT 20")
def least_nnz(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.at_least_nnz(_supplier(spark, sf), 2, 20).select("id", F.size("idx").cast("long").alias("n"))


@query(f"WITH {LARGE} SELECT count(DISTINCT id) AS rows, 16::BIGINT AS columns, count(*) AS nnz FROM x")
def shape(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.shape(_supplier(spark, sf)).select("rows", "columns", F.col("nnz").cast("long").alias("nnz"))


@query(f"WITH {o.SUPPLIER}, n AS (SELECT count(DISTINCT id) * count(DISTINCT f) AS n FROM l) SELECT round(sum(v), 2) AS total, count(*) FILTER (v <> 0) AS nnz, round((sum(v * v) - sum(v) * sum(v) / max(n)) / max(n), 2) AS variance FROM l, n")
def totals(spark: SparkSession, sf: str) -> DataFrame:
    long = q.part_supplier(spark, sf)
    cells = long.select(F.count_distinct("id") * F.count_distinct("feature")).first()[0]
    both = matrix.total_sum(long).crossJoin(matrix.total_nnz(long)).crossJoin(matrix.total_variance(long, cells))
    return both.select(F.round("total", 2).alias("total"), "nnz", F.round("variance", 2).alias("variance"))


@query("WITH u AS (SELECT o_orderpriority AS file, o_custkey AS feature FROM orders GROUP BY 1, 2 HAVING count(*) = 1), s AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS number FROM u GROUP BY feature HAVING count(*) >= 3) SELECT u.file, u.feature, s.number FROM u JOIN s USING (feature)")
def shared_features(spark: SparkSession, sf: str) -> DataFrame:
    named = q._read(spark, sf, "orders").select(F.col("o_orderpriority").alias("file"), F.col("o_custkey").alias("feature"))
    return matrix.unique_shared_features(named, 3).select("file", "feature", F.col("number").cast("long").alias("number"))


# Measures and pairs.


@query(f"WITH {o.COUNTS} SELECT i, j, round(pow(sum(pow(abs(x - y), 2.5)), 0.4), 6) AS dist FROM pair GROUP BY i, j")
def pairwise_p_norm(spark: SparkSession, sf: str) -> DataFrame:
    return pairwise.self_pairs(q.priority_counts(spark, sf), measures.minkowski(2.5)).select("i", "j", r6("dist").alias("dist"))


@query(f"WITH {o.COUNTS} SELECT i, j, round(sum((x + 1) * ln((x + 1) / (y + 1)) - x + y), 6) AS dist FROM pair GROUP BY i, j")
def pairwise_poisson(spark: SparkSession, sf: str) -> DataFrame:
    p = q.priority_counts(spark, sf).withColumn("features", F.transform("features", lambda v: v + 1))
    return pairwise.self_pairs(p, measures.POISSON).select("i", "j", r6("dist").alias("dist"))


@query(f"WITH {o.COUNTS} SELECT i, j, round(sqrt(sum((sqrt(p) - sqrt(q)) * (sqrt(p) - sqrt(q)))) * sqrt(0.5::DOUBLE), 6) AS dist FROM pair GROUP BY i, j")
def pairwise_scaled_hellinger(spark: SparkSession, sf: str) -> DataFrame:
    return pairwise.self_pairs(q.priority_counts(spark, sf), measures.hellinger(0.5**0.5), 1.0).select("i", "j", r6("dist").alias("dist"))


@query(f"WITH {TVD_ALL}, b AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY d, i) AS n FROM t WHERE i % 4 = 1) SELECT j AS client, i AS facility, round(d, 6) AS dist FROM b WHERE n = 1")
def oracle_assign(spark: SparkSession, sf: str) -> DataFrame:
    d = _tvd(spark, sf).filter("facility % 4 = 1")
    return pairwise.oracle_assign(d).select("client", "facility", r6("dist").alias("dist"))


@query(f"WITH {o.EMB}, {o._dist('L1')}, {o.BEST} SELECT id, cid, round(d, 6) AS cost FROM a")
def assign_by_function(spark: SparkSession, sf: str) -> DataFrame:
    """A measure given as a function of two array Columns."""
    p = q.embeddings(spark, sf)
    a = pairwise.assign(p, q._centers(p), lambda x, y: vectors.l1_norm(F.zip_with(x, y, lambda a, b: a - b)))
    return a.select("id", F.col("cid").cast("long").alias("cid"), r6("cost").alias("cost"))


_SPARSE_PAIRS = f"{LARGE}, sp AS (SELECT a.id AS i, b.id AS j, a.v AS x, b.v AS y FROM full_x a JOIN full_x b ON a.f = b.f AND a.id < b.id WHERE b.id <= 40)"


def _supplier_pairs(spark: SparkSession, sf: str) -> DataFrame:
    s = _supplier(spark, sf).filter("id <= 40")
    a, b = (s.select(F.col("id").alias(i), F.col("idx").alias(f"{n}_idx"), F.col("val").alias(f"{n}_val"), "dim") for i, n in (("i", "x"), ("j", "y")))
    return a.join(b.drop("dim"), F.col("i") < F.col("j"))


@query(f"WITH {_SPARSE_PAIRS} SELECT i, j, round(sum(x * y), 4) AS dot, round(sum(abs(x - y)), 6) AS l1, round(sqrt(sum((x - y) * (x - y))), 6) AS l2 FROM sp GROUP BY i, j")
def sparse_norms(spark: SparkSession, sf: str) -> DataFrame:
    e = [F.col(c) for c in ("x_idx", "x_val", "y_idx", "y_val")]
    return _supplier_pairs(spark, sf).select("i", "j", F.round(vectors.sparse_dot(*e), 4).alias("dot"), r6(vectors.sparse_l1(*e)).alias("l1"), r6(vectors.sparse_l2(*e)).alias("l2"))


@query(f"WITH {_SPARSE_PAIRS} SELECT i, j, count(*) FILTER (x <> 0 AND y <> 0) AS shared, count(*) FILTER (x <> 0 AND y = 0) AS left_only, count(*) FILTER (x = 0 AND y <> 0) AS right_only, count(*) FILTER (x = 0 AND y = 0) AS zeros FROM sp GROUP BY i, j")
def merge_by_case(spark: SparkSession, sf: str) -> DataFrame:
    e = [F.col(c) for c in ("x_idx", "x_val", "y_idx", "y_val")]
    cases = vectors.merge_cases(*e, lambda a, b: F.lit(0), lambda a: F.lit(1), lambda b: F.lit(2))
    n = lambda k: F.size(F.filter("cases", lambda v: v == k)).cast("long")
    p = _supplier_pairs(spark, sf).withColumn("cases", cases)
    return p.select("i", "j", n(0).alias("shared"), n(1).alias("left_only"), n(2).alias("right_only"), vectors.shared_zeros(F.col("x_idx"), F.col("y_idx"), F.col("dim")).cast("long").alias("zeros"))


@query(f"WITH {o.COUNTS} SELECT a.id AS i, b.id AS j, round(sum(b.p * ln(b.p / a.p)), 6) AS dist FROM pr a JOIN pr b USING (f) WHERE b.id < 5 GROUP BY 1, 2")
def cmp_sparse(spark: SparkSession, sf: str) -> DataFrame:
    s = _counts(spark, sf)
    return sparse.compare(s, s.filter("id < 5"), "MKL", 1.0).select("i", "j", r6("dist").alias("dist"))


@query(f"WITH {o.COUNTS} SELECT i, j, round({o.PAIR['JSD']}, 6) AS dist FROM pair GROUP BY i, j")
def pcmp_sparse(spark: SparkSession, sf: str) -> DataFrame:
    return sparse.self_pairs(_counts(spark, sf), "JSD", 1.0).select("i", "j", r6("dist").alias("dist"))


@query(f"WITH {LARGE}, d AS (SELECT p.id, c.id AS k, sum(abs(p.v - c.v)) AS d FROM full_x p JOIN full_x c USING (f) WHERE c.id IN (SELECT id FROM ids ORDER BY id LIMIT 3) GROUP BY 1, 2), n AS (SELECT *, dense_rank() OVER (ORDER BY k) - 1 AS cid FROM d), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cid) AS r FROM n) SELECT id, cid, round(d, 6) AS cost FROM b WHERE r = 1")
def assign_sparse(spark: SparkSession, sf: str) -> DataFrame:
    s = _supplier(spark, sf)
    c = np.array([r["features"] for r in schema.sparse_to_dense(s.orderBy("id").limit(3)).orderBy("id").collect()])
    return sparse.assign(s, c, "L1").select("id", F.col("cid").cast("long").alias("cid"), r6("cost").alias("cost"))


@query(f"WITH {o.EMB}, s AS (SELECT id, abs(v) AS u, row_number() OVER (PARTITION BY id ORDER BY abs(v) DESC) AS n, sum(abs(v)) OVER (PARTITION BY id ORDER BY abs(v) DESC ROWS UNBOUNDED PRECEDING) AS c FROM e), t AS (SELECT id, greatest(0, max((c - 1) / n)) AS t FROM s GROUP BY id) SELECT id, f::BIGINT AS feature, round(sign(v) * greatest(abs(v) - t, 0), 6) + 0.0 AS value FROM e JOIN t USING (id)")
def l1_ball(spark: SparkSession, sf: str) -> DataFrame:
    p = q.embeddings(spark, sf).withColumn("features", vectors.on_l1_ball(F.col("features"), 1.0))
    return _long(p, "id").withColumn("value", F.col("value") + 0.0)


@query(f"WITH {o.COUNTS}, x AS (SELECT id, f, exp(v / 100 - max(v / 100) OVER (PARTITION BY id)) AS x FROM g) SELECT id, dense_rank() OVER (ORDER BY f) - 1 AS feature, round(x / sum(x) OVER (PARTITION BY id), 6) AS value FROM x")
def softmax(spark: SparkSession, sf: str) -> DataFrame:
    p = q.priority_counts(spark, sf).withColumn("features", vectors.softmax(F.transform("features", lambda v: v / 100)))
    return _long(p, "id")


@query(f"WITH {o.EMB}, n AS (SELECT count(*) AS n FROM embeddings), pl AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings), "
       + "dr AS MATERIALIZED (SELECT i AS t, " + ", ".join(f"CAST(floor({uniform_sql('i', r, SEED)} * n) AS BIGINT) AS p{r}" for r in range(3)) + " FROM range(1000) x(i), n), "
       + "ok AS MATERIALIZED (SELECT t, x.id AS a, y.id AS b, z.id AS c FROM dr JOIN pl x ON x.place = p0 JOIN pl y ON y.place = p1 JOIN pl z ON z.place = p2 WHERE p0 <> p1 AND p1 <> p2 AND p0 <> p2), "
       + "x1 AS MATERIALIZED (SELECT t, b, c, f, v AS x FROM ok JOIN e ON e.id = a), x2 AS MATERIALIZED (SELECT t, c, x1.f, x, v AS y FROM x1 JOIN e ON e.id = b AND e.f = x1.f), "
       + "d AS (SELECT t, sum(pow(x - y, 2)) AS ab, sum(pow(y - v, 2)) AS bc, sum(pow(x - v, 2)) AS ac FROM x2 JOIN e ON e.id = c AND e.f = x2.f GROUP BY t) "
       + "SELECT round(max(greatest(ab, bc, ac) / (ab + bc + ac - greatest(ab, bc, ac))), 6) AS alpha FROM d")
def triangle_factor(spark: SparkSession, sf: str) -> DataFrame:
    return pairwise.triangle_factor(q.embeddings(spark, sf), triples=1000, seed=SEED).select(r6("alpha").alias("alpha"))


@query(f"WITH {o.EMB}, d AS (SELECT p.id, c.id AS nb, sum((p.v - c.v) * (p.v - c.v)) AS d FROM e p JOIN e c ON p.f = c.f AND p.id <> c.id GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nb) AS n FROM d) SELECT least(id, nb) AS src, greatest(id, nb) AS dst, round(min(d), 6) AS weight FROM r WHERE n <= 3 GROUP BY 1, 2")
def knn_graph(spark: SparkSession, sf: str) -> DataFrame:
    return pairwise.neighbour_graph(pairwise.neighbours(q.embeddings(spark, sf), 3)).select("src", "dst", r6("weight").alias("weight"))


# Centers.


def _by_place(c: np.ndarray, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, f, round(float(v), 6)) for i, r in enumerate(c) for f, v in enumerate(r)], "cid long, feature long, value double")


def _weiszfeld(rows: str, steps: int) -> str:
    """Of rows x(id, f, v): the mean, then steps."""
    sql = f"{rows}, c0 AS (SELECT f, avg(v) AS c FROM x GROUP BY f)"
    for i in range(1, steps + 1):
        sql += f", w{i} AS (SELECT x.id, 1 / greatest(sqrt(sum((v - c) * (v - c))), 1e-30) AS w FROM x JOIN c{i - 1} USING (f) GROUP BY x.id), c{i} AS (SELECT f, sum(v * w) / sum(w) AS c FROM x JOIN w{i} USING (id) GROUP BY f)"
    return f"WITH {sql}"


GEOMEDIAN = _weiszfeld(f"{o.EMB}, x AS (SELECT * FROM e)", 3) + " SELECT f::BIGINT AS feature, round(c, 6) AS value FROM c3"


@query(_weiszfeld(f"{o.COUNTS}, x AS (SELECT id, dense_rank() OVER (ORDER BY f) - 1 AS f, v FROM g)", 3) + " SELECT 0::BIGINT AS cid, f::BIGINT AS feature, round(c, 6) AS value FROM c3")
def sparse_geomedian(spark: SparkSession, sf: str) -> DataFrame:
    p = q.priority_counts(spark, sf).withColumn("cid", F.lit(0))
    start = centroids.means(p, 1)
    s = _counts(spark, sf).withColumn("cid", F.lit(0)).withColumn("weight", F.lit(1.0))
    return _by_place(sparse.geometric_medians(s, start, eps=0.0, max_iterations=3), spark)


@query(f"WITH {LARGE} SELECT id % 3 AS cid, f::BIGINT AS feature, round(median(v), 6) AS value FROM full_x GROUP BY 1, 2 HAVING median(v) <> 0")
def sparse_median(spark: SparkSession, sf: str) -> DataFrame:
    m = sparse.medians(_supplier(spark, sf).withColumn("cid", F.col("id") % 3))
    return m.select("cid", F.col("feature").cast("long").alias("feature"), r6("value").alias("value"))


@query(f"WITH {LARGE}, y AS (SELECT id % 3 AS cid, f, v, sum((id % 5 + 1)::DOUBLE) AS w FROM full_x GROUP BY 1, 2, 3), z AS (SELECT cid, f, v, sum(w) OVER (PARTITION BY cid, f ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY cid, f) AS tot FROM y) SELECT cid, f::BIGINT AS feature, round(min(v), 6) AS value FROM z WHERE cum >= tot / 2 GROUP BY cid, f HAVING min(v) <> 0")
def sparse_weighted_median(spark: SparkSession, sf: str) -> DataFrame:
    own = _supplier(spark, sf).withColumn("cid", F.col("id") % 3).withColumn("weight", (F.col("id") % 5 + 1).cast("double"))
    return sparse.medians(own, weighted=True).select("cid", F.col("feature").cast("long").alias("feature"), r6("value").alias("value"))


@query(o._medians("tvd"))
def policy_centers(spark: SparkSession, sf: str) -> DataFrame:
    p = q.priority_counts(spark, sf).withColumn("cid", (F.col("id") % 3).cast("int"))
    return _by_place(centroids.update(p, 3, "TVD", np.zeros((3, 5))), spark)


_RESP = "x AS (SELECT id, cid, exp(-{t} * d) AS x FROM d), s AS (SELECT id, cid, x / sum(x) OVER (PARTITION BY id) AS r FROM x)"


@query(f"WITH {o.EMB}, {o._dist('SQRL2')}, {_RESP.replace('{t}', '2')} SELECT cid, f::BIGINT AS feature, round(sum(r * v) / sum(r), 6) AS value FROM s JOIN e USING (id) GROUP BY 1, 2")
def soft_step(spark: SparkSession, sf: str) -> DataFrame:
    p = q.embeddings(spark, sf)
    return _by_place(clustering.soft(p, q._centers(p), temperature=2.0, max_iterations=1).centers, spark)


@query(f"WITH {o.EMB}, {o._dist('L1')}, {_RESP.replace('{t}', '0.5')}, y AS (SELECT cid, f, v, sum(r) AS w FROM s JOIN e USING (id) GROUP BY 1, 2, 3), z AS (SELECT cid, f, v, sum(w) OVER (PARTITION BY cid, f ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY cid, f) AS tot FROM y) SELECT cid, f::BIGINT AS feature, round(min(v), 6) AS value FROM z WHERE cum >= tot / 2 GROUP BY cid, f")
def soft_median_step(spark: SparkSession, sf: str) -> DataFrame:
    p = q.embeddings(spark, sf)
    return _by_place(clustering.soft_medians(clustering.responsibilities(p, q._centers(p), "L1", temperature=0.5), K), spark)


@query(f"WITH {NEAREST} SELECT cid, count(*) AS n FROM a GROUP BY cid")
def assignment_histogram(spark: SparkSession, sf: str) -> DataFrame:
    p = q.embeddings(spark, sf)
    return clustering.assignment_histogram(pairwise.assign(p, q._centers(p))).select(F.col("cid").cast("long").alias("cid"), "n")


_LOG = "ln({w}) - 0.5 * (64 * ln({s}) + 64 * ln(2 * pi())) - 0.5 * sum((p.v - c.v) * (p.v - c.v)) / {s}"


@query(f"WITH {o.EMB}, z AS (SELECT p.id, c.id AS comp, CASE c.id WHEN 0 THEN {_LOG.format(w=0.25, s=0.5)} ELSE {_LOG.format(w=0.75, s=2.0)} END AS z FROM e p JOIN e c ON p.f = c.f WHERE c.id < 2 GROUP BY 1, 2), t AS (SELECT id, max(z) AS top, arg_max(comp, z) AS comp FROM z GROUP BY id) SELECT z.id, round(max(top) + ln(sum(exp(z - top))), 6) AS log_density, max(t.comp) AS comp FROM z JOIN t ON t.id = z.id GROUP BY z.id")
def mixture_scores(spark: SparkSession, sf: str) -> DataFrame:
    p = q.embeddings(spark, sf)
    c = q._centers(p, 2)
    m = clustering.mixture_scores(p, c, np.stack([np.eye(c.shape[1]) * 0.5, np.eye(c.shape[1]) * 2.0]), np.array([0.25, 0.75]))
    return m.select("id", r6("log_density").alias("log_density"), F.col("comp").cast("long").alias("comp"))


# Seeding.

_ALL_IDS = f"{o.EMB}, ids AS (SELECT DISTINCT id FROM e), pd AS (SELECT p.id, c.id AS c, sum((p.v - c.v) * (p.v - c.v)) AS d FROM e p JOIN e c ON p.f = c.f GROUP BY 1, 2)"


@query(f"WITH {_ALL_IDS}, c0 AS (SELECT id FROM ids ORDER BY ln({uniform_sql('id', 0, SEED)}) DESC, id LIMIT 1), m0 AS (SELECT id, d FROM pd WHERE c IN (SELECT id FROM c0)), "
       + f"k AS (SELECT id, row_number() OVER (ORDER BY ln({uniform_sql('id', 1, SEED)}) / d DESC, id) AS n FROM m0 WHERE d > 0 QUALIFY n <= 3), s AS (SELECT k.id, k.n, sum(least(m0.d, pd.d)) AS s FROM k JOIN pd ON pd.c = k.id JOIN m0 ON m0.id = pd.id GROUP BY 1, 2) "
       + "SELECT 0::BIGINT AS place, id FROM c0 UNION ALL SELECT 1, (SELECT id FROM s ORDER BY s, n LIMIT 1)")
def kmeanspp_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return q._ids(spark, seeding.kmeanspp(q.embeddings(spark, sf), 2, seed=SEED, candidates=3).ids)


@query(f"WITH {_ALL_IDS}, f AS (" + " UNION ALL ".join(f"(SELECT {t} AS t, id FROM ids ORDER BY ln({uniform_sql('id', 0, SEED + 7919 * t)}) DESC, id LIMIT 1)" for t in range(4)) + "), s AS (SELECT f.t, f.id, sum(pd.d) AS s FROM f JOIN pd ON pd.c = f.id GROUP BY 1, 2) SELECT id, round(s, 4) AS cost FROM s ORDER BY s, t LIMIT 1")
def best_of_seedings(spark: SparkSession, sf: str) -> DataFrame:
    s = seeding.best_of(q.embeddings(spark, sf), 1, 4, seed=SEED)
    return spark.createDataFrame([(int(s.ids[0]), round(s.cost, 4))], "id long, cost double")


@query(f"""WITH {o.EMB}, {o._dist('SQRL2')}, o AS (SELECT id, cid, d, row_number() OVER (PARTITION BY id ORDER BY d, cid) AS r FROM d),
b AS (SELECT x.id, x.cid, x.d AS d1, y.d AS d2 FROM o x JOIN o y ON x.id = y.id WHERE x.r = 1 AND y.r = 2),
w AS (SELECT id FROM b WHERE id >= {K} AND d1 > 0 ORDER BY ln({uniform_sql('id', 10_000, SEED)}) / d1 DESC, id LIMIT 1),
z AS (SELECT p.id, sum((p.v - c.v) * (p.v - c.v)) AS d FROM e p JOIN e c ON p.f = c.f WHERE c.id IN (SELECT id FROM w) GROUP BY p.id),
g AS (SELECT sum(least(z.d - b.d1, 0)) AS g FROM b JOIN z USING (id)),
t AS (SELECT max(g) + sum(least(z.d, d2) - least(z.d, d1)) AS delta FROM b JOIN z USING (id), g GROUP BY cid)
SELECT round((SELECT sum(d1) FROM b) + least(0, (SELECT min(delta) FROM t)), 3) AS cost""")
def local_search_swap(spark: SparkSession, sf: str) -> DataFrame:
    p = q.embeddings(spark, sf)
    s = seeding.local_search_swaps(p, seeding.Seeds(list(range(K)), q._centers(p), 0.0), 1, seed=SEED)
    return spark.createDataFrame([(round(s.cost, 3),)], "cost double")


def _outlier_kcenter(k: int) -> str:
    sql, chosen = f"WITH {_ALL_IDS}, n AS (SELECT CAST(ceil(2.5 * 0.02 * count(*)) AS BIGINT) AS pool FROM ids), c0 AS (SELECT 0::BIGINT AS id)", "SELECT id FROM c0"
    for r in range(1, k):
        sql += f", m{r} AS (SELECT id, sqrt(min(d)) AS d FROM pd WHERE c IN ({chosen}) GROUP BY id), p{r} AS (SELECT id, row_number() OVER (ORDER BY d DESC, id) AS n FROM m{r} WHERE id NOT IN ({chosen})), c{r} AS (SELECT id FROM p{r}, n WHERE p{r}.n <= pool ORDER BY ln({uniform_sql('id', r, SEED)}) DESC, id LIMIT 1)"
        chosen += f" UNION ALL SELECT id FROM c{r}"
    return sql + " " + " UNION ALL ".join(f"SELECT {r}::BIGINT AS place, id FROM c{r}" for r in range(k))


@query(_outlier_kcenter(4))
def kcenter_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return q._ids(spark, seeding.kcenter(q.embeddings(spark, sf), 4, seed=SEED, outliers=0.02, first=0).ids)


@query(f"WITH {_ALL_IDS}, f AS (" + " UNION ALL ".join(f"(SELECT {t} AS t, id FROM ids ORDER BY ln({uniform_sql('id', 0, SEED + 7919 * t)}) DESC, id LIMIT 1)" for t in range(3)) + "), g AS (SELECT t, f.id AS a, arg_max(pd.id, (d, -pd.id)) AS b FROM f JOIN pd ON pd.c = f.id WHERE pd.id <> f.id GROUP BY 1, 2), w AS (SELECT t, x.id, least(x.d, y.d) AS d FROM g JOIN pd x ON x.c = a JOIN pd y ON y.c = b AND y.id = x.id) SELECT round(min(m), 6) AS radius FROM (SELECT t, sqrt(max(d)) AS m FROM w GROUP BY t)")
def best_kcenter(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(round(seeding.best_kcenter(q.embeddings(spark, sf), 2, 3, seed=SEED).cost, 6),)], "radius double")


# Draws and coresets.


@query(f"SELECT vec_id AS id, round({uniform_sql('vec_id', 3, SEED)}, 9) AS u FROM embeddings")
def uniform_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return q.embeddings(spark, sf).select("id", F.round(uniform(F.col("id"), 3, SEED), 9).alias("u"))


@query("SELECT c_custkey AS id, c_acctbal AS cost FROM customer ORDER BY cost DESC, id LIMIT 10")
def farthest(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.farthest(q._read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("cost")), 10)


@query(f"WITH w AS (SELECT vec_id AS id, (vec_id % 7 + 1)::DOUBLE AS w FROM embeddings), c AS (SELECT id, w, sum(w) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS cum FROM w), u AS (SELECT i AS draw, {uniform_sql('i', 1, SEED)} * (SELECT sum(w) FROM w) AS u FROM range(60) x(i)) SELECT draw, id FROM u JOIN c ON u <= cum AND u > cum - w")
def draw_independent(spark: SparkSession, sf: str) -> DataFrame:
    p = q.embeddings(spark, sf).select("id", (F.col("id") % 7 + 1).cast("double").alias("w"))
    return sampling.draw_independent(p, "w", 60, SEED)


@query(f"SELECT vec_id AS id FROM embeddings ORDER BY ln({uniform_sql('vec_id', 5, SEED)}) / (vec_id % 7 + 1) DESC, id LIMIT 1")
def draw_one(spark: SparkSession, sf: str) -> DataFrame:
    p = q.embeddings(spark, sf).select("id", (F.col("id") % 7 + 1).cast("double").alias("w"))
    return spark.createDataFrame([(sampling.draw_one(p, "w", 5, SEED),)], "id long")


def _half(odd: int) -> str:
    return f"(SELECT o_orderkey AS id, (SELECT count(*) FROM orders WHERE o_orderkey % 2 = {odd}) / 40.0e0 AS w FROM orders WHERE o_orderkey % 2 = {odd} ORDER BY ln({uniform_sql('o_orderkey', 0, SEED)}) DESC, id LIMIT 40)"


@query(f"SELECT id, round(sum(w), 6) AS weight FROM ({_half(0)} UNION ALL {_half(1)} UNION ALL {_half(1)}) GROUP BY id")
def merged_coresets(spark: SparkSession, sf: str) -> DataFrame:
    keys = q._read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    even, odd = (sampling.uniform_coreset(keys.filter(F.col("id") % 2 == r), 40, SEED) for r in (0, 1))
    return coreset.merge(even, odd, odd).select("id", r6("weight").alias("weight"))


@query(f"{o._core('BFL')} SELECT id, round(w / (prob * 10), 4) AS weight FROM pr ORDER BY round(prob, 12) DESC, id LIMIT 10")
def top_outliers(spark: SparkSession, sf: str) -> DataFrame:
    probs = coreset.sensitivities(q._costed(spark, sf), "BFL", K).withColumn("prob", F.round("prob", 12))
    return coreset.top_outliers(probs, 10).select("id", F.round("weight", 4).alias("weight"))


@query(f"{o._core('FL')}, k AS (SELECT id, w / (prob * 50) AS kw FROM pr WHERE prob > 0 ORDER BY {o._RACE} DESC, id LIMIT 50), z AS (SELECT cid, sum(kw) AS s FROM k JOIN w USING (id) GROUP BY cid) SELECT c.cid, round(greatest(2.0::DOUBLE * w_c - coalesce(z.s, 0), 0), 4) AS weight FROM c LEFT JOIN z USING (cid)")
def bicriteria_weights(spark: SparkSession, sf: str) -> DataFrame:
    costed = q._costed(spark, sf)
    core = coreset.sample(coreset.sensitivities(costed, "FL", K), 50, SEED, unique=True)
    return coreset.with_centers(core, costed, 0.1).select(F.col("cid").cast("long").alias("cid"), F.round("weight", 4).alias("weight"))


# Graphs.


@query(f"WITH RECURSIVE {o.PLACES}, r AS (SELECT v::BIGINT AS id, 0.0::DOUBLE AS d, v::BIGINT AS s FROM (VALUES (0), (1)) t(v) UNION SELECT be.b, r.d + be.w, r.s FROM r JOIN be ON be.a = r.id WHERE r.d < 10) SELECT s AS facility, id AS client, round(min(d), 6) AS dist FROM r GROUP BY 1, 2")
def distance_rows(spark: SparkSession, sf: str) -> DataFrame:
    v, e = q.place_graph(spark, sf)
    return graph.distance_rows(e, v.filter(F.col("id").isin(0, 1))).select("facility", "client", r6("dist").alias("dist"))


@query(f"WITH {o.PLACES} SELECT a AS id, count(*) AS n, round(sum(w), 4) AS weight FROM be GROUP BY a")
def degrees(spark: SparkSession, sf: str) -> DataFrame:
    return q.place_graph(spark, sf)[1].groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


SPANNING_TREE = f"""WITH RECURSIVE {o.COUNTS}, e AS (SELECT *, row_number() OVER (ORDER BY weight, src, dst) AS k FROM (SELECT i AS src, j AS dst, sum(abs(x - y)) AS weight FROM pair GROUP BY i, j)),
r AS (SELECT k, src AS v FROM e UNION SELECT r.k, CASE WHEN x.src = r.v THEN x.dst ELSE x.src END FROM r JOIN e x ON (x.src = r.v OR x.dst = r.v) AND x.k < r.k)
SELECT src, dst, weight FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = e.k AND r.v = e.dst)"""


def _kmedian(k: int) -> str:
    """The least cost of k facilities, over all sets of k."""
    sets = ", ".join(f"f{i}.id AS a{i}" for i in range(k))
    joins = " ".join(f"JOIN s f{i} ON f{i}.id > f{i - 1}.id" for i in range(1, k))
    near = "least(" + ", ".join(f"t{i}.d" for i in range(k)) + ")"
    dist = " ".join(f"JOIN t t{i} ON t{i}.i = a{i}" + (" AND t{i}.j = t0.j".replace("{i}", str(i)) if i else "") for i in range(k))
    by = ", ".join(f"a{i}" for i in range(k))
    return f"WITH {TVD_ALL}, z AS (SELECT {sets} FROM s f0 {joins}), c AS (SELECT {by}, sum({near}) AS cost FROM z {dist} GROUP BY {by}) SELECT round(min(cost), 6) AS cost FROM c"


@query(_kmedian(3))
def kmedian_local_search(spark: SparkSession, sf: str) -> DataFrame:
    """Local search with swaps of one and two centers; on these tables it ends at the optimum."""
    return spark.createDataFrame([(round(metric.solve(_tvd(spark, sf), 3, "local_search", swaps=2).cost, 6),)], "cost double")


@query(f"WITH best AS ({_kmedian(4)}) SELECT true AS within_bound, 4::BIGINT AS facilities FROM best")
def jv_kmedian(spark: SparkSession, sf: str) -> DataFrame:
    """The primal-dual search opens as many facilities as asked for, at no more than six times the cost that local search reaches."""
    d = _tvd(spark, sf)
    s, best = metric.solve(d, 4, "primal_dual"), metric.solve(d, 4, "local_search", swaps=2)
    return spark.createDataFrame([(bool(s.cost <= 6 * best.cost), len(s.facilities))], "within_bound boolean, facilities long")


# Readers and writers, as round trips.


@query(f"WITH {LARGE} SELECT id, f::BIGINT AS feature, round(v, 6) AS value FROM x")
def matrix_market(spark: SparkSession, sf: str) -> DataFrame:
    path, long = _folder(spark), schema.sparse_to_long(_supplier(spark, sf))
    matrices.write_matrix_market(long, 20_000, 16, path)
    return matrices.read_matrix_market(spark, path).select("id", F.col("feature").cast("long").alias("feature"), r6("value").alias("value"))


@query(f"WITH {LARGE} SELECT f::BIGINT AS id, id AS feature, round(v, 6) AS value FROM x")
def matrix_market_transposed(spark: SparkSession, sf: str) -> DataFrame:
    path, long = _folder(spark), schema.sparse_to_long(_supplier(spark, sf))
    matrices.write_matrix_market(long, 20_000, 16, path, compression="gzip")
    return matrices.read_matrix_market(spark, path, transpose=True).select("id", F.col("feature").cast("long").alias("feature"), r6("value").alias("value"))


@query(f"WITH {o.COUNTS} SELECT id, dense_rank() OVER (ORDER BY f) - 1 AS feature, v AS value FROM g WHERE v <> 0")
def csr_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    data, indices, indptr, size = matrices.to_csr(_counts(spark, sf))
    return schema.sparse_to_long(matrices.from_csr(spark, data, indices, indptr, size)).select("id", F.col("feature").cast("long").alias("feature"), "value")


@query(f"{o._core('VX')} SELECT id, round(prob, 9) AS prob, 'VX' AS method FROM pr")
def sampler_on_disk(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    matrices.write_table(coreset.sensitivities(q._costed(spark, sf), "VX", K), path, method="VX", seed=SEED)
    back = matrices.read_table(spark, path)
    return back.select("id", F.round("prob", 9).alias("prob"), F.lit(matrices.properties(back)["method"]).alias("method"))


@query(f"WITH {o.EMB} SELECT c.cid, e.f::BIGINT AS feature, round(e.v, 6) AS value FROM (VALUES (0::BIGINT, 7), (1, 3), (2, 11)) c(cid, id) JOIN e USING (id)")
def centers_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return _by_place(api.centers(q.embeddings(spark, sf), [7, 3, 11]), spark)


@query(f"WITH {o.PLACES} SELECT a AS src, b AS dst, w AS weight FROM be")
def shortest_path_file(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark) + ".gr"
    graphs.write_gr(100_000, q.place_graph(spark, sf)[1], path)
    return graphs.read_graph(spark, path)


@query("WITH e AS (SELECT n_nationkey::BIGINT AS a, n_regionkey::BIGINT + 25 AS b FROM nation) SELECT a AS src, b AS dst, 1.0::DOUBLE AS weight FROM e UNION ALL SELECT b, a, 1.0 FROM e")
def adjacency_file(spark: SparkSession, sf: str) -> DataFrame:
    e = q._read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey").cast("long") + 25).alias("dst"), F.lit(1.0).alias("weight"))
    path = _folder(spark) + ".graph"
    graphs.write_adjacency(30, graph.both_ways(e), path)
    return graphs.read_graph(spark, path)


@query("SELECT r_name AS state, n_name AS place, 0::BIGINT + 2 AS n FROM nation JOIN region ON r_regionkey = n_regionkey")
def city_file(spark: SparkSession, sf: str) -> DataFrame:
    """Cities of a ring through all nations: each has two edges' ends."""
    n = q._read(spark, sf, "nation").join(q._read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("s"), F.col("n_name").alias("p"))
    m = n.select(((F.col("n_nationkey") + 24) % 25).alias("n_nationkey"), F.col("s").alias("s2"), F.col("p").alias("p2"))
    path = _folder(spark)
    n.join(m, "n_nationkey").select(F.col("s").alias("state1"), F.col("p").alias("place1"), F.lit(5).alias("miles"), F.col("s2").alias("state2"), F.col("p2").alias("place2")).write.option("header", True).csv(path)
    v, e = graphs.read_city_distances(spark, path)
    ends = e.select(F.col("src").alias("id")).union(e.select("dst"))
    return ends.join(v, "id").groupBy("state", "place").agg(F.count("*").alias("n"))


@query(f"WITH {PLACED} SELECT id - 1 AS id, lat, lon FROM pl")
def coordinate_comments(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    _places(spark, sf).select(F.format_string("c x->%d %s %s", "id", F.col("lat").cast("string"), F.col("lon").cast("string")).alias("value")).write.text(path)
    return graphs.read_coordinates(spark, path)


_HAVERSINE = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query(f"WITH {PLACED}, w AS (SELECT id, lat, lon, lag(id) OVER (PARTITION BY id % 13 ORDER BY id) AS p FROM pl) SELECT a.id AS src, b.id AS dst, round({_HAVERSINE}, 3) AS weight FROM w b JOIN pl a ON a.id = b.p")
def road_ways(spark: SparkSession, sf: str) -> DataFrame:
    p = _places(spark, sf).select("id", "lat", "lon")
    ways = p.groupBy((F.col("id") % 13).alias("way")).agg(F.sort_array(F.collect_list("id")).alias("refs"))
    return graphs.ways_to_edges(p, ways).select("src", "dst", F.round("weight", 3).alias("weight"))


@query("WITH s AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), d AS (SELECT a.id, b.id AS nb, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d FROM s a JOIN s b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nb) AS n FROM d) SELECT least(id, nb) AS src, greatest(id, nb) AS dst, round(min(d), 6) AS weight FROM r WHERE n <= 4 GROUP BY 1, 2")
def star_graph(spark: SparkSession, sf: str) -> DataFrame:
    p = q.embeddings(spark, sf)
    path = _folder(spark)
    p.select("id", F.col("features")[0].alias("x"), F.col("features")[1].alias("y"), F.col("features")[2].alias("z"), F.lit("a star").alias("proper")).write.option("header", True).csv(path)
    return graphs.star_graph(graphs.read_stars(spark, path), 4).select("src", "dst", r6("weight").alias("weight"))


@query(f"WITH {o.PLACES} SELECT a AS src, b AS dst, round(w * 1609.344, 6) AS weight FROM pe UNION ALL SELECT a + 1000000, b + 1000000, w FROM pe UNION ALL SELECT 0, 1000000, 7.0")
def spliced(spark: SparkSession, sf: str) -> DataFrame:
    e = q.place_graph(spark, sf)[1].filter("src > dst")
    anchors = spark.createDataFrame([(0, 1_000_000, 7.0)], "src long, dst long, weight double")
    return graphs.spliced(e, e, 1_000_000, anchors).select("src", "dst", r6("weight").alias("weight"))


# Front ends.


@query(o.oracle_sql()["lloyd_2_iter"])
def hcluster(spark: SparkSession, sf: str) -> DataFrame:
    r = api.hcluster(q.embeddings(spark, sf), list(range(K)), msr="SQRL2", eps=0.0, maxiter=2)
    return r["asn"].groupBy(F.col("cid").cast("long").alias("cid")).agg(F.count("*").alias("n"), F.round(F.sum("cost"), 4).alias("cost"))


@query(o.oracle_sql()["soft_responsibilities"])
def scluster(spark: SparkSession, sf: str) -> DataFrame:
    r = api.scluster(q.embeddings(spark, sf), list(range(K)), msr="SQRL2", temp=2.0, maxiter=0)
    return r["asn"].select("id", F.posexplode("resp").alias("cid", "resp")).select("id", F.col("cid").cast("long").alias("cid"), r6("resp").alias("resp"))


@query(o._kmeanspp())
def kmeanspp_front(spark: SparkSession, sf: str) -> DataFrame:
    return q._ids(spark, api.kmeanspp(q.embeddings(spark, sf), 3, seed=SEED)["ids"])


@query(o._kcenter())
def greedy_select(spark: SparkSession, sf: str) -> DataFrame:
    return q._ids(spark, api.greedy_select(q.embeddings(spark, sf), 4, msr="L2", first=0)["ids"])


def _minibatch_sql(rounds: int = 4, batch: int = 200, every: int = 2) -> str:
    """Rounds of ``clustering.minibatch`` with running means, the cheapest check-in, and the assignment to its centers."""
    sql = f"WITH {o.EMB}, n AS (SELECT count(*) AS n FROM embeddings), c0 AS (SELECT id AS cid, f, v FROM e WHERE id < {K}), seen0 AS (SELECT DISTINCT cid, 0.0::DOUBLE AS n FROM c0)"
    for r in range(rounds):
        sql += f""", p{r} AS (SELECT e.id, e.f, e.v FROM e, n WHERE {uniform_sql('id', r, SEED)} < least(1.0::DOUBLE, {batch}.0::DOUBLE / n)),
d{r} AS (SELECT p.id, c.cid, sum((p.v - c.v) * (p.v - c.v)) AS d FROM p{r} p JOIN c{r} c USING (f) GROUP BY 1, 2),
a{r} AS (SELECT id, cid FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cid) AS k FROM d{r}) WHERE k = 1),
w{r} AS (SELECT cid, count(*)::DOUBLE AS w FROM a{r} GROUP BY cid), s{r} AS (SELECT cid, f, sum(v) AS s FROM a{r} JOIN p{r} USING (id) GROUP BY 1, 2),
seen{r + 1} AS (SELECT b.cid, b.n + coalesce(w.w, 0) AS n FROM seen{r} b LEFT JOIN w{r} w USING (cid)),
c{r + 1} AS (SELECT c.cid, c.f, CASE WHEN w.w > 0 THEN (1 - w.w / b.n) * c.v + w.w / b.n * s.s / w.w ELSE c.v END AS v FROM c{r} c JOIN seen{r + 1} b USING (cid) LEFT JOIN w{r} w USING (cid) LEFT JOIN s{r} s ON s.cid = c.cid AND s.f = c.f)"""
    checks = [r for r in range(rounds + 1) if r % every == 0 or r == rounds]
    for r in checks:
        sql += f", x{r} AS (SELECT e.id, c.cid, sum((e.v - c.v) * (e.v - c.v)) AS d FROM e JOIN c{r} c USING (f) GROUP BY 1, 2)"
    sql += ", z AS (" + " UNION ALL ".join(f"SELECT {r} AS r, id, cid, d FROM x{r}" for r in checks) + "), near AS (SELECT *, row_number() OVER (PARTITION BY r, id ORDER BY d, cid) AS k FROM z)"
    return sql + ", best AS (SELECT r FROM near WHERE k = 1 GROUP BY r ORDER BY sum(d), r LIMIT 1) SELECT id, cid FROM near WHERE k = 1 AND r IN (SELECT r FROM best)"


def _kcenter_coreset_sql(size: int = 6, rounds: int = 10, per_round: int = 3) -> str:
    """``coreset.kcenter_coreset`` with k 3, mu 1, rho 1, gamma 0.02, eta 0.1: rounds of farthest rows, then outliers and weighed centers."""
    sql = f"WITH {_ALL_IDS}, n AS (SELECT CAST(ceil(1.5 * 0.02 * count(*)) AS BIGINT) AS pool FROM ids), r0 AS (SELECT id, row_number() OVER (ORDER BY ln({uniform_sql('id', 0, SEED)}) DESC, id) - 1 AS place FROM ids QUALIFY place < {per_round})"
    chosen = "SELECT id, place FROM r0"
    for r in range(1, rounds + 1):
        sql += f""", m{r} AS (SELECT pd.id, sqrt(min(d)) AS d FROM pd JOIN ({chosen}) ch ON ch.id = pd.c GROUP BY pd.id), p{r} AS (SELECT id, row_number() OVER (ORDER BY d DESC, id) AS k FROM m{r} WHERE id NOT IN (SELECT id FROM ({chosen}))),
r{r} AS (SELECT id, {r * per_round} + row_number() OVER (ORDER BY ln({uniform_sql('id', r, SEED)}) DESC, id) - 1 AS place FROM p{r}, n WHERE p{r}.k <= pool QUALIFY place < {(r + 1) * per_round})"""
        chosen += f" UNION ALL SELECT id, place FROM r{r}"
    sql += f", ch AS ({chosen}), a AS (SELECT id, c, d FROM (SELECT pd.id, ch.id AS c, sqrt(d) AS d, row_number() OVER (PARTITION BY pd.id ORDER BY sqrt(d), place) AS k FROM pd JOIN ch ON ch.id = pd.c) WHERE k = 1)"
    return sql + ", out AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY d DESC, id) AS k FROM a), n WHERE k <= pool) SELECT id, 1.0::DOUBLE AS weight FROM out UNION ALL SELECT c, count(*)::DOUBLE FROM a WHERE id NOT IN (SELECT id FROM out) GROUP BY c"


def queries() -> dict[str, q.Query]:
    return {k: f for k, (f, _) in TABLE.items()}


def oracle_sql() -> dict[str, str]:
    registry = ", ".join(f"('{m.name}', {'NULL' if m.number is None else m.number}::INT, '{m.text.replace(chr(39), chr(39) * 2)}')" for m in measures.MEASURES.values())
    late = {"measure_registry": f"SELECT * FROM (VALUES {registry}) t(name, number, text)", "geomedian_3_steps": GEOMEDIAN, "spanning_tree": SPANNING_TREE, "minibatch": _minibatch_sql(), "kcenter_coreset": _kcenter_coreset_sql()}
    return {k: s for k, (_, s) in TABLE.items() if s is not None} | late
