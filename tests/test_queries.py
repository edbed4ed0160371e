import duckdb
import pytest

from centrova.plans import more, oracles, queries

TABLES = "nation customer orders lineitem part embeddings".split()
SOME = ["assign_sqrl2", "pairwise_jsd", "pairwise_llr", "coreset_probs_lbk", "kmeanspp_parity", "weighted_median", "components", "sssp", "erase_empty"]
SOME += ["minibatch", "kcenter_coreset", "kmeanspp_candidates", "kcenter_outliers", "local_search_swap", "cmp_sparse", "sparse_median", "sparse_geomedian", "soft_median_step", "l1_ball", "spanning_tree", "largest_component", "draw_independent", "matrix_market", "hcluster"]


@pytest.mark.parametrize("name", SOME)
def test_against_duckdb(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf).toPandas()
    want = con.sql((oracles.oracle_sql() | more.oracle_sql())[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b)
    for c in cols:
        assert a[c].astype(float).to_numpy() == pytest.approx(b[c].astype(float).to_numpy(), abs=2e-6)


def test_every_oracle_has_a_query():
    assert set(oracles.oracle_sql() | more.oracle_sql()) <= set(queries.queries())


def test_thorup_sample_ends_by_its_own_rule(spark, sf):
    got = {r["id"] for r in queries.queries()["thorup_sample"](spark, sf).collect()}
    assert got == {r["id"] for r in queries.embeddings(spark, sf).select("id").collect()}  # 500 rows are less than a batch of 522


def test_hierarchical_ends_at_the_radix(spark, sf):
    got = [tuple(r["node_path"]) for r in queries.queries()["hierarchical"](spark, sf).collect()]
    assert len(got) == queries.embeddings(spark, sf).count()
    assert max(got.count(p) for p in set(got)) <= 4  # no five rows are equal
