import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from centrova.functions.measures import MEASURES, block_distance, distance, measure, registry
from centrova.functions.vectors import merge_cases, shared_zeros, softmax, to_dense, to_sparse

X10, Y10 = [1, 5, 0, 3, 1, 1, 1, 3, 1, 1], [1, 1, 3, 2, 2, 0, 21, 1, 7, 1]
X20 = [0, 7, 6, 0, 6, 6, 0, 0, 7, 9, 4, 0, 0, 0, 6, 6, 0, 0, 0, 7]
Y20 = [6, 7, 0, 0, 0, 5, 6, 9, 0, 0, 0, 0, 0, 9, 0, 6, 5, 6, 0, 0]
ONE_HOT = [0, 0, 0, 1] + [0] * 8
GOLDEN = [("JSD", X10, Y10, 0.16066042325849725), ("JSD", X20, Y20, 0.2307775339934756), ("MKL", [10, 0, 4, 6, 0, 13] + [0] * 6, ONE_HOT, 0.539179777847523)]


@pytest.mark.parametrize(("name", "x", "y", "want"), GOLDEN)
def test_golden_values(spark, name, x, y, want):
    assert block_distance(name, np.array([x]), np.array([y]), 1.0)[0, 0] == pytest.approx(want, abs=1e-12)
    df = spark.createDataFrame([([float(v) for v in x], [float(v) for v in y])], "x array<double>, y array<double>")
    assert df.select(distance(name, F.col("x"), F.col("y"), 1.0)).first()[0] == pytest.approx(want, abs=1e-12)


def test_columns_and_blocks_agree(spark):
    rng = np.random.default_rng(3)
    rows = rng.poisson(2.0, (6, 8)).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "id int, x array<double>")
    pairs = df.select(F.col("id").alias("i"), "x").crossJoin(df.select(F.col("id").alias("j"), F.col("x").alias("y")))
    got = pairs.select("i", "j", *[distance(m, F.col("x"), F.col("y"), 0.5).alias(m) for m in MEASURES]).collect()
    for m in MEASURES:
        want = block_distance(m, rows, rows, 0.5)
        for r in got:
            assert r[m] == pytest.approx(want[r["i"], r["j"]], abs=1e-7), m


@pytest.mark.parametrize("prior", [1.0, 50.0, 0.01])
def test_self_distance(prior):
    x = np.array([X10, Y10], float)
    for name, m in MEASURES.items():
        d = block_distance(name, x, x, prior).diagonal()
        assert np.allclose(d, 1.0 if m.similarity else 0.0, atol=5e-4), name


def test_argument_order_matters():
    x, y = np.array([[10, 0, 4, 6.0]]), np.array([[0, 0, 0, 1.0]])
    assert block_distance("MKL", x, y, 1.0) == pytest.approx(block_distance("REVERSE_MKL", y, x, 1.0))
    assert block_distance("MKL", x, y, 0.0)[0, 0] == math.inf


def test_registry(spark):
    assert measure("sis").name == "SYMMETRIC_ITAKURA_SAITO"
    assert measure(4).name == "JSD"
    with pytest.raises(ValueError):
        measure("nothing")
    assert registry(spark).filter("number = 2").first()["name"] == "SQRL2"


def test_vectors(spark):
    df = spark.createDataFrame([([float(v) for v in X20], [float(v) for v in Y20])], "x array<double>, y array<double>").select("x", "y", to_sparse(F.col("x")).alias("s"), to_sparse(F.col("y")).alias("t"))
    r = df.select(shared_zeros(F.col("s.idx"), F.col("t.idx"), F.col("s.dim")).alias("z"), to_dense(F.col("s.idx"), F.col("s.val"), F.col("s.dim")).alias("d"), softmax(F.col("x")).alias("p"),
                  merge_cases(F.col("s.idx"), F.col("s.val"), F.col("t.idx"), F.col("t.val"), lambda a, b: a * b, lambda a: a * 0, lambda b: b * 0).alias("m")).first()
    assert r["z"] == 4
    assert r["d"] == X20
    assert sum(r["p"]) == pytest.approx(1.0)
    assert sum(r["m"]) == sum(a * b for a, b in zip(X20, Y20, strict=True))
