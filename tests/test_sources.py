import numpy as np
import pytest

from centrova.sources import graphs, matrices
from centrova.streaming import facility


def test_matrix_market(spark, tmp_path):
    p = tmp_path / "m.mtx"
    p.write_text("%%MatrixMarket matrix coordinate real general\n% note\n2 3 3\n1 1 5\n2 3 1.5\n1 2 2\n")
    got = sorted(map(tuple, matrices.read_matrix_market(spark, str(p)).collect()))
    assert got == [(0, 0, 5.0), (0, 1, 2.0), (1, 2, 1.5)]
    assert (2, 1, 1.5) in set(map(tuple, matrices.read_matrix_market(spark, str(p), transpose=True).collect()))
    p.write_text("2 3 4\n1 1 5\n")
    with pytest.raises(ValueError):
        matrices.read_matrix_market(spark, str(p))


def test_raw_columns_and_csr(spark, tmp_path):
    for name, v in (("indptr", np.array([0, 2, 2, 3], np.uint64)), ("indices", np.array([4, 1, 0], np.uint32)), ("data", np.array([1, 2, 3], np.float32)), ("shape", np.array([5, 3], np.uint32))):
        v.tofile(tmp_path / f"{name}.file")
    rows = {r["id"]: (r["idx"], r["val"]) for r in matrices.read_raw_columns(spark, str(tmp_path)).collect()}
    assert rows == {0: ([1, 4], [2.0, 1.0]), 1: ([], []), 2: ([0], [3.0])}
    assert matrices.read_raw_columns(spark, str(tmp_path), skip_empty=True).count() == 2
    data, indices, indptr, shape = matrices.to_csr(matrices.from_csr(spark, [1.0, 2.0], [0, 3], [0, 1, 2], (2, 4)))
    assert (data.tolist(), indices.tolist(), indptr.tolist(), shape) == ([1.0, 2.0], [0, 3], [0, 1, 2], (2, 4))


def test_tables_keep_their_properties(spark, tmp_path):
    matrices.write_table(spark.range(3), str(tmp_path / "t"), seed=7, method="BFL")
    assert matrices.properties(matrices.read_table(spark, str(tmp_path / "t"))) == {"seed": 7, "method": "BFL"}


def test_graph_files(spark, tmp_path):
    g = tmp_path / "a.graph"
    g.write_text("3 2 0\n2 3\n1\n1\n")
    assert sorted(map(tuple, graphs.read_graph(spark, str(g)).collect())) == [(0, 1, 1.0), (0, 2, 1.0), (1, 0, 1.0), (2, 0, 1.0)]
    g.write_text("2 1 1\n2 7\n1 7\n")
    assert sorted(map(tuple, graphs.read_graph(spark, str(g)).collect())) == [(0, 1, 7.0), (1, 0, 7.0)]
    g.write_text("4532025 0\n2\n1\n")
    with pytest.raises(ValueError):
        graphs.read_graph(spark, str(g))
    r = tmp_path / "b.gr"
    r.write_text("c x->1 2.5 -3.5\np sp 2 1\na 1 2 9\n")
    assert graphs.read_graph(spark, str(r)).collect() == [(0, 1, 9.0)]
    assert graphs.read_coordinates(spark, str(r)).collect() == [(0, 2.5, -3.5)]


def test_blobs_and_stream(spark):
    b = matrices.blobs(spark, 40, 3, 2, seed=1)
    assert b.count() == 40
    from pyspark.sql import functions as F

    f = facility.facilities(b.withColumn("weight", F.lit(1.0)), facility.kmeans_stream(2, n=40), 2)
    assert f.agg(F.sum("weight")).first()[0] == 40
    st = facility.FacilityState(facility.kmedian_stream(2, n=100))
    for x in np.random.default_rng(0).normal(0, 1, (100, 2)):
        st.add(list(x))
    assert sum(st.weights) == 100


def test_streaming_query_keeps_all_weight(spark, tmp_path):
    from pyspark.sql import functions as F

    src = tmp_path / "in"
    for i in range(2):
        spark.range(i * 10, i * 10 + 10).select("id", F.array(F.col("id").cast("double"), F.lit(0.0)).alias("features"), F.lit(1.0).alias("weight")).write.mode("append").parquet(str(src))
    s = spark.readStream.schema("id long, features array<double>, weight double").option("maxFilesPerTrigger", 2).parquet(str(src))
    q = facility.stream_facilities(s, facility.kmedian_stream(2, n=100), 1).writeStream.outputMode("update").format("memory").queryName("fac").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("select * from fac").collect()
    last = {}
    for r in rows:
        last[r["facility"]] = max(last.get(r["facility"], 0), r["weight"])
    assert sum(last.values()) == 20


@pytest.mark.parametrize("settings", [facility.kmeans_stream(1, n=3, seed=5), facility.kmedian_stream(1, n=3, seed=5)])
def test_shards_of_many_facilities_take_distances_in_batches(settings, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (700, 3)), np.round(rng.normal(0, 40, (700, 3)))])
    w = [float(v) for v in rng.integers(1, 4, len(x))]
    calls = []
    monkeypatch.setattr(facility.screens, "nearest", lambda *a, f=facility.screens.nearest: calls.append(1) or f(*a))
    many, one = facility.FacilityState(settings), facility.FacilityState(settings)
    many.extend(x, w)
    in_batches = len(calls)
    for row, weight in zip(x, w, strict=True):
        one.add(list(row), weight)
    assert in_batches < 100
    assert np.array_equal(many.rows, one.rows) and many.weights == one.weights
    assert (many.bound, many.cost, many.seen) == (one.bound, one.cost, one.seen)
