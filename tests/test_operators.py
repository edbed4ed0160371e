import numpy as np
import pytest
from pyspark.sql import functions as F

from centrova import schema
from centrova.operators import centroids, clustering, coreset, graph, lsh, matrix, metric, pairwise, sampling, seeding, tree
from centrova.options import ClusterOptions


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    centers = np.array([[0, 0], [20, 0], [0, 20.0]])
    return np.concatenate([c + rng.normal(0, 1, (20, 2)) for c in centers])


@pytest.fixture(scope="module")
def points(spark, rows):
    df = spark.createDataFrame([(i, [float(v) for v in r], 1.0) for i, r in enumerate(rows)], "id long, features array<double>, weight double").repartition(3)
    return df.cache()


def test_assign_takes_the_lowest_of_equal_centers(spark, rows, points):
    c = np.array([rows[0], rows[0], rows[30]])
    got = {r["id"]: r for r in pairwise.assign(points, c, second=True).collect()}
    d = ((rows[:, None] - c[None]) ** 2).sum(axis=2)
    for i, r in got.items():
        assert r["cid"] == d[i].argmin() != 1
        assert r["cost"] == pytest.approx(d[i].min())
        assert r["cost2"] == pytest.approx(np.sort(d[i])[1])


def test_pairs_and_neighbours(rows, points):
    d = np.linalg.norm(rows[:, None] - rows[None], axis=2)
    pairs = pairwise.self_pairs(points, "L2").collect()
    assert len(pairs) == 60 * 59 // 2
    assert all(r["dist"] == pytest.approx(d[r["i"], r["j"]]) for r in pairs)
    knn = pairwise.neighbours(points, 2, "L2").collect()
    np.fill_diagonal(d, np.inf)
    assert all(r["neighbour"] == np.argsort(d[r["id"]], kind="stable")[r["rank"] - 1] for r in knn)


def test_spanning_forest_of_a_connected_graph(spark, points):
    e = pairwise.self_pairs(points.filter("id < 12"), "L2").select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("dist").alias("weight"))
    tree = pairwise.spanning_forest(e).collect()
    assert len(tree) == 11
    left = sorted((r["weight"], r["src"], r["dst"]) for r in e.collect())
    at, want = {i: i for i in range(12)}, 0.0
    for w, a, b in left:
        if at[a] != at[b]:
            want += w
            at = {k: at[a] if v == at[b] else v for k, v in at.items()}
    assert sum(r["weight"] for r in tree) == pytest.approx(want)


def test_seeds_cover_the_groups(points):
    a, b = (seeding.kmeanspp(points.repartition(n), 3, seed=4) for n in (2, 5))
    assert a.ids == b.ids
    assert len({i // 20 for i in seeding.kcenter(points, 3, first=0).ids}) == 3
    assert seeding.kmeanspp(points.limit(2), 5).centers.shape[0] == 2
    assert seeding.local_search_swaps(points, a, 3).cost <= a.cost + 1e-9


def test_hard_and_soft_find_the_groups(rows, points):
    start = rows[[0, 25, 45]]
    h = clustering.hard(points, start)
    assert all(x >= y for x, y in zip(h.costs, h.costs[1:], strict=False))
    assert sorted(r["n"] for r in clustering.assignment_histogram(h.assigned).collect()) == [20, 20, 20]
    s = clustering.soft(points, start, max_iterations=5)
    assert np.allclose(np.sort(s.centers.sum(axis=1)), np.sort(h.centers.sum(axis=1)), atol=0.5)
    assert clustering.hard(points, start, "L1", max_iterations=2).cost > 0


def test_one_call(points):
    c = clustering.cluster(points, ClusterOptions(k=3, extra_tries=1, seed=2, max_iterations=3))
    assert c.centers.shape == (3, 2)
    with pytest.raises(ValueError):
        ClusterOptions(coreset_method="none")


def test_empty_clusters_are_refilled(rows, points):
    far = np.array([rows[0], rows[25], [1e6, 1e6]])
    c = clustering.hard(points, far, max_iterations=4)
    assert c.assigned.select("cid").distinct().count() == 3


def test_centroids(spark):
    members = spark.createDataFrame([(0, 1, 1.0, [1.0, 0.0]), (0, 2, 1.0, [3.0, 0.0]), (0, 3, 5.0, [9.0, 4.0]), (1, 4, 1.0, [2.0, 2.0])], "cid int, id long, weight double, features array<double>")
    mean = {r["cid"]: r["features"] for r in centroids.mean_frame(members).collect()}
    assert mean[0] == pytest.approx([49 / 7, 20 / 7])
    assert centroids.means(members, 2)[0] == pytest.approx(mean[0])
    assert {r["cid"]: r["features"] for r in centroids.median_frame(members).collect()}[0] == [3.0, 0.0]
    assert {r["cid"]: r["features"] for r in centroids.weighted_median_frame(members).collect()}[0] == [9.0, 4.0]
    g = centroids.geometric_medians(members.filter("cid = 0"), np.array([[4.0, 1.0]]))
    assert g[0] == pytest.approx([9.0, 4.0], abs=1e-2)


def test_coresets(points, rows):
    costed = pairwise.assign(points, rows[[0, 25, 45]]).select("id", "cid", "cost", "weight")
    for m in ("BFL", "VX", "LBK", "FL", "LFKF"):
        assert coreset.sensitivities(costed, m).agg(F.sum("prob")).first()[0] == pytest.approx(1.0)
    s = coreset.sample(coreset.sensitivities(costed), 200, 3)
    assert s.agg(F.sum("weight")).first()[0] == pytest.approx(60, rel=0.35)
    assert coreset.sample(coreset.sensitivities(costed), 10, 3, unique=True).count() == 10
    assert coreset.merge(s, s).count() == s.count()
    k = coreset.kcenter_coreset(points, 2, 1.0, 1.0, 0.05)
    assert k.agg(F.sum("weight")).first()[0] == pytest.approx(60)
    at, w = coreset.caratheodory(rows, np.ones(60))
    assert len(at) <= 3
    assert rows[at].T @ w == pytest.approx(rows.sum(axis=0))
    assert sampling.uniform_coreset(points, 6, 1).agg(F.sum("weight")).first()[0] == pytest.approx(60)


def recursive(points, radix, seed, path=()):
    """(path, id) of the leaves, by the operators over one node at a time."""
    seeds = seeding.kmeanspp(points, radix, seed=seed + 31 * (len(path) + 1) + sum(path))
    own = clustering.hard(points, seeds.centers, max_iterations=10, seed=seed).assigned
    found = own.select("cid", "id").collect()
    out = set()
    for c in {r["cid"] for r in found}:
        ids = [r["id"] for r in found if r["cid"] == c]
        if len(ids) > radix and len(ids) < len(found):
            out |= recursive(points.filter(F.col("id").isin(ids)), radix, seed, (*path, c))
        else:
            out |= {((*path, c), i) for i in ids}
    return out


def test_hierarchical_matches_a_recursive_version(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = [*rng.normal(0, 1, (16, 2)).tolist(), *[[9.0, 9.0]] * 6]
    points = spark.createDataFrame([(i, v, 1.0) for i, v in enumerate(x)], "id long, features array<double>, weight double").coalesce(2).cache()
    want = recursive(points, 2, 3)
    assert len({p for p, i in want if i >= 16}) == 1  # six equal rows cannot be split
    for local_values in (tree.LOCAL_VALUES, 20, 0):
        monkeypatch.setattr(tree, "LOCAL_VALUES", local_values)
        got = clustering.hierarchical(points, 2, seed=3).collect()
        assert all(r["depth"] == len(r["node_path"]) for r in got)
        assert sorted((tuple(r["node_path"]), r["id"]) for r in got) == sorted(want)


def test_hierarchical_goes_on_below_any_depth(spark):
    points = spark.createDataFrame([(i, [3.0**i], 1.0) for i in range(30)], "id long, features array<double>, weight double")
    got = clustering.hierarchical(points, 2).collect()
    sizes = {}
    for r in got:
        sizes[tuple(r["node_path"])] = sizes.get(tuple(r["node_path"]), 0) + 1
    assert sum(sizes.values()) == 30
    assert max(sizes.values()) <= 2
    assert max(r["depth"] for r in got) > 8


def test_kcenter_coreset_runs_all_rounds(points):
    # L = 4, so ceil((4 + 2) / 0.9) = 7 rounds of 3 rows after the first 3, and 5 outliers
    core = coreset.kcenter_coreset(points, 2, 1.0, 1.0, 0.05)
    assert core.count() == 3 + 7 * 3 + 5


def test_graph(spark):
    e = graph.both_ways(spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 5.0), (0, 3, 2.0), (7, 8, 1.0)], "src long, dst long, weight double"))
    v = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 7, 8, 9)], "id long")
    assert {r["id"]: r["component"] for r in graph.components(e, v).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 7: 7, 8: 7, 9: 9}
    d = {r["id"]: (r["dist"], r["source"]) for r in graph.shortest_paths(e, v.filter("id in (0, 7)")).collect()}
    assert d == {0: (0.0, 0), 1: (1.0, 0), 2: (2.0, 0), 3: (2.0, 0), 7: (0.0, 7), 8: (1.0, 7)}
    rows = {(r["facility"], r["client"]): r["dist"] for r in graph.distance_rows(e, v.filter("id in (0, 2)")).collect()}
    assert rows[2, 3] == 4.0
    vs, es, ids = graph.largest_component(v, e)
    assert (vs.count(), es.count(), ids.count()) == (4, 8, 4)


def test_metric_search_against_all_subsets():
    rng = np.random.default_rng(5)
    for _ in range(5):
        p = rng.random((14, 2))
        m = np.linalg.norm(p[:, None] - p[None], axis=2)
        best = metric.exhaustive(m, 3)[1]
        assert metric.local_search(m, 3, swaps=2)[1] <= 1.1 * best
        chosen, cost = metric.primal_dual_kmedian(m, 3)
        assert len(chosen) == 3
        assert cost <= 3 * best


def test_lsh_finds_each_row_itself(points):
    base = lsh.index(points, lsh.Tables(2, 2, 5, "L2", 4.0))
    own = lsh.candidates(base, base).filter("qid = id").collect()
    assert len(own) == 60
    assert all(r["matches"] == 5 for r in own)
    for family in lsh.FAMILIES:
        assert lsh.hash_matrix(np.ones((2, 2)), lsh.Tables(2, 2, 2, family), *lsh.projections(lsh.Tables(2, 2, 2, family))).shape == (2, 4)


def test_matrix(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0, 2.0]), (1, [0.0, 0.0, 0.0]), (2, [3.0, 0.0, 0.0])], "id long, features array<double>")
    long = schema.dense_to_long(df)
    out, ids, cols = matrix.erase_empty(long)
    assert sorted(map(tuple, out.collect())) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0)]
    assert [tuple(r) for r in matrix.column_variance(long, 3).orderBy("feature").collect()] == [(0, pytest.approx(np.var([1, 0, 3]))), (2, pytest.approx(np.var([2, 0, 0])))]
    assert [r["features"] for r in matrix.submatrix(df, [2, 0, 2], [2, 0]).orderBy("place").collect()] == [[0.0, 3.0], [2.0, 1.0], [0.0, 3.0]]
    assert schema.sparse_to_dense(schema.dense_to_sparse(df)).orderBy("id").collect()[0]["features"] == [1.0, 0.0, 2.0]
    assert matrix.row_mode(spark.createDataFrame([(0, [2.0, 1.0, 1.0, 2.0])], "id long, features array<double>")).first()["mode"] == 1.0


def test_top_candidates_are_counted_in_tiles(spark, points, monkeypatch):
    from pyspark.sql import Window

    base = lsh.index(points, lsh.Tables(2, 2, 5, "L2", 1.0))
    w = Window.partitionBy("qid").orderBy(F.desc("matches"), "id")
    pairs = lsh.candidates(base, base).withColumn("rank", F.row_number().over(w)).filter("rank <= 3")
    want = sorted(map(tuple, pairs.select("qid", "id", "matches", "rank").collect()))
    for name, value in (("TILE_ROWS", 25), ("LEFT", 8), ("RIGHT", 10)):
        monkeypatch.setattr(lsh, name, value)
    twice = base.union(base.filter("id < 5"))
    also = sorted(map(tuple, lsh.candidates(twice, base).withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("qid", "id", "matches", "rank").collect()))
    assert sorted(map(tuple, lsh.top_candidates(twice, base, 3).select("qid", "id", "matches", "rank").collect())) == also
    monkeypatch.setattr(lsh, "candidates", None)  # no row for each pair of a key
    got = lsh.top_candidates(base, base, 3)
    assert got.columns == ["qid", "id", "matches", "rank"]
    assert sorted(map(tuple, got.collect())) == want
