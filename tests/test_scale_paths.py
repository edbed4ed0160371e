"""What small tables take one way and large ones another must give the same rows; and operators that have no SQL."""

import lzma

import numpy as np
import pytest
from pyspark.sql import functions as F

from centrova import api, schema
from centrova.functions import measures, screens
from centrova.operators import centroids, clustering, coreset, graph, metric, pairwise, seeding, sparse
from centrova.sources import graphs, matrices


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(v) for v in rng.poisson(1.0, 6) + rng.integers(0, 3) * np.array([5, 0, 0, 0, 0, 5])], float(i % 3 + 1)) for i in range(90)]
    return spark.createDataFrame(rows, "id long, features array<double>, weight double")


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("which", ["L1", "MKL"])
def test_tiles_match_a_broadcast_side(points, which, monkeypatch):
    few = rows(pairwise.compare(points, points, which, 1.0)), rows(pairwise.self_pairs(points, which, 1.0))
    s = schema.dense_to_sparse(points)
    few_sparse = rows(sparse.compare(s, s, which, 1.0))
    assert few_sparse == few[0]
    monkeypatch.setattr(pairwise, "BLOCK_ROWS", 16)
    monkeypatch.setattr(sparse, "BLOCK_ROWS", 16)
    assert (rows(pairwise.compare(points, points, which, 1.0)), rows(pairwise.self_pairs(points, which, 1.0))) == few
    assert rows(sparse.compare(s, s, which, 1.0)) == few_sparse


@pytest.mark.parametrize("second", [False, True])
def test_centers_in_blocks(points, second, monkeypatch):
    c = np.array([r["features"] for r in points.orderBy("id").limit(7).collect()]) + 0.25
    keep = ["id", "cid", "cost", *(["cid2", "cost2"] if second else [])]
    want = rows(pairwise.assign(points, c, "L1", second=second).select(*keep))
    monkeypatch.setattr(pairwise, "CENTER_VALUES", 12)  # two centers a block
    assert rows(pairwise.assign(points, c, "L1", second=second).select(*keep)) == want
    by_column = pairwise.assign(points, c, lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, v: a + v), second=second)
    assert rows(by_column.select(*keep)) == want


def test_incremental_seeding_saves_costs_on_the_way(points, monkeypatch):
    want = seeding.kmeanspp(points, 12, seed=4), seeding.kcenter(points, 9, seed=4, outliers=0.05)
    monkeypatch.setattr(seeding, "EVERY", 2)
    got = seeding.kmeanspp(points, 12, seed=4), seeding.kcenter(points, 9, seed=4, outliers=0.05)
    assert [s.ids for s in got] == [s.ids for s in want]
    assert [s.cost for s in got] == pytest.approx([s.cost for s in want])
    assert len(set(got[0].ids)) == 12
    assert got[0].cost == pytest.approx(seeding.total_cost(pairwise.assign(points, got[0].centers)))


def test_kmc2_and_iterated_samples(points):
    s = seeding.kmc2(points, 4, seed=2)
    assert len(set(s.ids)) == 4
    seeds, weighed = seeding.thorup_iterated(points, 2, iterations=2, tries=2, eps=40.0)
    assert weighed.agg(F.sum("weight")).first()[0] == pytest.approx(points.agg(F.sum("weight")).first()[0])
    assert set(seeds.ids) == {r["id"] for r in weighed.collect()}
    assert seeding.union_of_samples(points, 1, 2, eps=60.0, rounds=2).count() > 0


@pytest.mark.parametrize("which", sorted(measures.MEASURES))
def test_sparse_measures_match_dense_ones(which):
    rng = np.random.default_rng(1)
    x, y = rng.poisson(0.6, (9, 14)).astype(float), rng.poisson(0.6, (6, 14)).astype(float)
    x[3] = y[2] = 0
    for prior in (0.0, 1.0, -1):
        dense = measures.block_distance(which, x, y, prior)
        assert sparse.block_distance(which, sparse.Rows.of_dense(x), sparse.Rows.of_dense(y), prior) == pytest.approx(dense, abs=1e-7, nan_ok=True)


def test_sparse_clusters_match_dense_ones(points):
    c = np.array([r["features"] for r in points.orderBy("id").limit(3).collect()])
    s = schema.dense_to_sparse(points).join(points.select("id", "weight"), "id")
    for which in ("SQRL2", "L1"):
        want = clustering.hard(points, c, which, max_iterations=3)
        centers, assigned, costs = sparse.hard(s, c, which, max_iterations=3)
        assert costs == pytest.approx(want.costs)
        assert centers == pytest.approx(want.centers)
        assert rows(assigned.select("id", "cid")) == rows(want.assigned.select("id", "cid"))


def test_sparse_medians_of_both_signs(spark):
    vals = [[-2.0, 0.0, 3.0], [0.0, 0.0, 1.0], [-1.0, 0.0, 0.0], [4.0, 0.0, 2.0]]
    p = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vals)], "id long, features array<double>, cid int")
    s = schema.dense_to_sparse(p).withColumn("cid", F.lit(0)).withColumn("weight", F.lit(1.0))
    got = {r["feature"]: r["value"] for r in sparse.medians(s).collect()}
    assert [got.get(i, 0.0) for i in range(3)] == np.median(np.array(vals), axis=0).tolist()


def test_front_ends(points):
    s = api.kmeanspp(points, 3, seed=1, ntimes=2, lspp=2)
    assert len(s["ids"]) == 3 and s["cost"] == pytest.approx(seeding.total_cost(s["asn"]))
    h = api.hcluster(points, s["ids"], maxiter=20)
    assert h["finalcost"] <= h["initcost"]
    assert api.hcluster(points, s["centers"], mbsize=30, maxiter=6, reseed_after=2)["asn"].count() == 90
    assert api.hcluster(points, s["centers"], coreset_size=40)["finalcost"] <= s["cost"] + 1e-9
    soft = api.scluster(points, [c for c in s["centers"]], temp=0.5, maxiter=5)
    assert soft["finalcost"] <= soft["initcost"]
    assert api.scluster(points, s["centers"], msr="L1", temp=0.5, maxiter=3)["asn"].count() == 90
    assert len(api.greedy_select(points, 4, outlier_fraction=0.05, ntimes=2)["ids"]) == 4
    assert api.cluster(points, k=3, msr="L1", seed=1)["asn"].count() == 90
    hits = api.center_hits(h["asn"]).orderBy("place").collect()
    assert hits[-1]["share"] == pytest.approx(1.0)


def test_minibatch_fills_centers_that_hold_little(points):
    far = np.array([[0.0] * 6, [1e6] * 6])
    got = clustering.minibatch(points, far, 40, rounds=4, check_every=2, seed=1, reseed_after=0)
    assert got.assigned.select("cid").distinct().count() == 2


@pytest.fixture(scope="module")
def ring(spark):
    e = spark.createDataFrame([(i, (i + 1) % 40, 1.0 + i % 3) for i in range(40)], "src long, dst long, weight double")
    return spark.range(40), graph.both_ways(e)


def test_graph_samples(spark, ring):
    v, e = ring
    some = graph.thorup_graph(v, e, 1, seed=1, eps=30.0, rounds=2)
    assert 0 < some.count() <= 40
    best, cost = graph.thorup_cheapest(v, e, 1, 3, seed=1, eps=30.0, rounds=2)
    assert cost == pytest.approx(graph.total_distance(v, e, best))
    assert graph.thorup_union(v, e, 1, 2, seed=1, eps=30.0, rounds=2).count() >= some.count()
    w = graph.thorup_iterated(v, e, 1, iterations=2, seed=1, eps=30.0, rounds=2)
    assert w.agg(F.sum("weight")).first()[0] == pytest.approx(40.0)


def test_search_on_a_coreset_and_its_distortion(spark, ring):
    v, e = ring
    r = metric.kz_clustering(v, e, 2, sizes=(10, 40), sets=5)
    assert r["restricted"][40] >= r["solution"].cost - 1e-9
    table = {x["size"]: x for x in r["distortion"].collect()}
    assert 0 <= table[40]["mean"] <= table[40]["most"]
    d = graph.distance_rows(e, v)
    every = v.withColumn("weight", F.lit(1.0))
    full = metric.solve(d, 3)
    s, cost = metric.restricted_search(d, every, 3)
    assert cost == pytest.approx(full.cost) == pytest.approx(s.cost)
    assert len(metric.primal_dual_on_graph(e, v.filter("id % 4 = 0"), 2).facilities) == 2
    assert metric.thorup_matrix(d, 1, seed=1, eps=30.0, rounds=2).count() > 0


def test_weighted_geometric_medians_move_toward_weight(spark):
    p = spark.createDataFrame([(0, 0, [0.0, 0.0], 5.0), (1, 0, [1.0, 0.0], 1.0), (2, 0, [0.0, 1.0], 1.0)], "id long, cid int, features array<double>, weight double")
    assert centroids.geometric_medians(p, centroids.means(p, 1), eps=1e-12, max_iterations=200)[0] == pytest.approx([0.0, 0.0], abs=1e-3)


def test_compressed_lines_and_maps(spark, tmp_path):
    (tmp_path / "m.xz").write_bytes(lzma.compress(b"one\ntwo\n"))
    assert sorted(r["value"] for r in matrices.read_xz_lines(spark, str(tmp_path / "m.xz")).collect()) == ["one", "two"]
    (tmp_path / "map.osm").write_text("""<osm><node id="1" lat="0.0" lon="0.0"/><node id="2" lat="0.0" lon="1.0"/><node id="3" lat="0.0" lon="2.0"/>
<way id="9"><nd ref="1"/><nd ref="2"/><tag k="highway" v="road"/></way><way id="10"><nd ref="2"/><nd ref="3"/><tag k="building" v="yes"/></way></osm>""")
    nodes, ways = graphs.read_osm(spark, str(tmp_path / "map.osm"))
    assert nodes.count() == 3
    e = graphs.ways_to_edges(nodes, ways).collect()
    assert [(r["src"], r["dst"]) for r in e] == [(1, 2)]
    assert e[0]["weight"] == pytest.approx(111_194.9, rel=1e-4)
    with pytest.raises((RuntimeError, OSError)):
        matrices.read_h5_group(str(tmp_path / "none.h5"), "mm10", spark)


def test_matrices_of_different_width_do_not_concat(spark, tmp_path):
    from centrova.operators.matrix import concat

    long = spark.createDataFrame([(0, 1, 2.0)], "id long, feature int, value double")
    read = []
    for n in (4, 5):
        matrices.write_matrix_market(long, 2, n, str(tmp_path / str(n)))
        read.append(matrices.read_matrix_market(spark, str(tmp_path / str(n))))
    with pytest.raises(ValueError, match="columns"):
        concat(read)


def test_coreset_weights_of_equal_ids_add_up(spark):
    core = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 1.0)], "id long, weight double")
    assert rows(coreset.compact(core)) == [(1, 5.0), (2, 1.0)]


@pytest.mark.parametrize("which", ["SQRL2", "L2", "L1"])
@pytest.mark.parametrize("equal", [0, 150])
def test_neighbours_in_pieces_match_all_distances(which, equal, monkeypatch):
    rng = np.random.default_rng(6)
    y = np.round(rng.normal(0, 2, (400, 3)), 1)
    y[:equal] = y[0]
    ids = rng.permutation(2000)[:400]
    taken = []
    monkeypatch.setattr(screens, "LEFT", 32)
    monkeypatch.setattr(screens, "RIGHT", 40)
    monkeypatch.setattr(screens, "own", lambda m, a, b, f=screens.own: taken.append(len(a)) or f(m, a, b))
    row, near, dist = screens.k_nearest(measures.measure(which), 0.0, y, ids, y, ids, 4)
    d = measures.block_distance(which, y, y)
    np.fill_diagonal(d, np.inf)
    want = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :4]
    assert np.array_equal(near[np.argsort(row, kind="stable")].reshape(-1, 4), ids[want])
    assert np.array_equal(dist[np.argsort(row, kind="stable")].reshape(-1, 4), np.take_along_axis(d, want, axis=1))
    assert sum(taken) < 400 * 400 / 4  # of few pairs their own distance


def test_neighbours_in_parts(spark, points, monkeypatch):
    want = rows(pairwise.neighbours(points, 3))
    monkeypatch.setattr(pairwise, "NEAR_VALUES", 120)  # 20 rows a side
    assert rows(pairwise.neighbours(points, 3)) == want
