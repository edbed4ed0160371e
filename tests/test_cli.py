import pytest

from centrova import cli


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cli") / "points")
    spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)], "id long, features array<double>").write.parquet(path)
    return path


def test_cluster_writes_centers_assignments_and_costs(spark, table, tmp_path):
    cli.main(["cluster", table, str(tmp_path), "-k", "3", "--measure", "L1"])
    assert spark.read.parquet(str(tmp_path / "centers")).count() == 3
    assert spark.read.parquet(str(tmp_path / "assignments")).columns == ["id", "cid"]
    assert spark.read.parquet(str(tmp_path / "costs")).count() == 60


def test_coresets_of_several_sizes(spark, table, tmp_path):
    cli.main(["coreset", table, str(tmp_path), "-k", "3", "--size", "5", "20", "--text", "--measure", "MKL", "--prior", "1"])
    assert spark.read.parquet(str(tmp_path / "importance")).count() == 60
    assert 0 < spark.read.parquet(str(tmp_path / "coreset_20")).count() <= 20
    assert 0 < spark.read.text(str(tmp_path / "samples_5")).count() <= 5


def test_selection_and_runs(spark, table, tmp_path):
    cli.main(["kcenter", table, str(tmp_path / "a"), "-k", "4", "--measure", "L2", "--outliers", "0.05"])
    assert spark.read.parquet(str(tmp_path / "a" / "centers")).count() == 4
    cli.main(["d2", table, str(tmp_path / "b"), "-k", "4", "--local-search", "1"])
    assert spark.read.parquet(str(tmp_path / "b" / "assignments")).count() == 60
    cli.main(["runs", table, str(tmp_path / "c"), "-k", "2", "--measure", "SQRL2", "L1"])
    assert spark.read.parquet(str(tmp_path / "c" / "runs")).count() == 2
