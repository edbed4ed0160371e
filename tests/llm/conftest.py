import random

import pytest


@pytest.fixture(scope="session")
def words():
    rng = random.Random(9)
    syl = ["ta", "ro", "mi", "len", "sor", "be", "ki", "dan", "ul", "ver"]
    return ["".join(rng.choice(syl) for _ in range(rng.randint(1, 3))) for _ in range(400)]


@pytest.fixture(scope="session")
def prose(words):
    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") + ("\n" if rng.random() < 0.05 else "") for _ in range(n))

    return make


@pytest.fixture(scope="session")
def rows(prose):
    """doc_id, text, source: prose, copies, near copies, shared passages, nulls, empty and very long texts."""
    base = [(i, prose(i, 80 + 13 * i)) for i in range(30)]
    passage = prose(999, 120)
    out = list(base)
    out += [(100 + i, base[3][1]) for i in range(4)]
    near = base[7][1].split(" ")
    for i in range(5):
        w = list(near)
        w[5 + 11 * i] = "edited"
        out.append((200 + i, " ".join(w)))
    out += [(300 + i, prose(40 + i, 60) + " " + passage + " " + prose(60 + i, 60)) for i in range(4)]
    out += [(400, None), (401, ""), (402, "   \n\t"), (403, "one"), (404, "one two"), (405, "é" * 900), (406, "a" * 2500), (407, prose(77, 9000)), (408, "中文字符" * 300), (409, "\x00\x01 control\x0b\x1cx")]
    return [(d, t, f"src{d % 3}" if d % 7 else None) for d, t in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


@pytest.fixture(scope="session")
def duck(rows):
    """A DuckDB connection over the same rows, as documents."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"text": object, "source": object})
    con.register("frame", documents)
    con.sql("create table documents as select doc_id::BIGINT doc_id, text::VARCHAR text, source::VARCHAR source from frame")
    return con


@pytest.fixture(scope="session")
def same():
    def check(got, want):
        a, b = got.toPandas(), want.df()
        cols = sorted(b.columns)
        assert sorted(a.columns) == cols
        as_rows = lambda x: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in x[cols].astype(object).itertuples(index=False))
        assert as_rows(a) == as_rows(b)

    return check
