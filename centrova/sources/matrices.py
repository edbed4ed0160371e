"""Readers and writers of matrices: MatrixMarket, raw compressed-column files, CSR triples, Parquet."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centrova.schema import long_to_sparse


def read_matrix_market(spark: SparkSession, path: str, transpose: bool = False) -> DataFrame:
    """Long form of a coordinate file (gz, bz2 and zst as Spark reads them); an error if entries and header disagree.

    Places start at 0. Rows and columns come from the header, as metadata of ``value``.
    """
    where = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select(F.trim("value").alias("v"), where.alias("at")).filter("v != ''").filter(~F.col("v").startswith("%"))
    # The header is the first line but comments, by file and place in it: tasks may read the parts in any order.
    first = lines.agg(F.min(F.struct("at", "v")).alias("m")).first()["m"]
    if first is None:
        raise ValueError(f"{path} has no header line")
    rows, cols, nnz = (int(x) for x in first["v"].split()[:3])
    at, parts = first["at"], F.split("v", r"\s+")
    head = (F.col("at.file_path") == at["file_path"]) & (F.col("at.file_block_start") == at["file_block_start"]) & (F.col("at.n") == at["n"])
    e = lines.filter(~head).select((parts[0].cast("long") - 1).alias("id"), (parts[1].cast("int") - 1).alias("feature"), F.coalesce(F.get(parts, F.lit(2)).cast("double"), F.lit(1.0)).alias("value"))
    found = e.count()
    if found != nnz:
        raise ValueError(f"{path} has {found} entries, its header says {nnz}")
    if transpose:
        e = e.select(F.col("feature").cast("long").alias("id"), F.col("id").cast("int").alias("feature"), "value")
        rows, cols = cols, rows
    return e.withMetadata("value", {"rows": rows, "columns": cols})


def write_matrix_market(long: DataFrame, rows: int, columns: int, path: str, compression: str = "none") -> None:
    """A coordinate file as a folder of text parts, compressed if asked; the header is in the first one."""
    n = long.count()
    body = long.select(F.format_string("%d %d %s", F.col("id") + 1, F.col("feature") + 1, F.col("value").cast("string")).alias("value"))
    head = long.sparkSession.createDataFrame([("%%MatrixMarket matrix coordinate real general",), (f"{rows} {columns} {n}",)], "value string").coalesce(1)
    head.union(body).write.option("compression", compression).text(path)


def read_xz_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of .xz files, which Spark's codecs do not read; a file is one task's, as its format cannot be split."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import lzma

        for g in frames:
            for content in g["content"]:
                lines = lzma.decompress(content).decode("utf-8").split("\n")
                for lo in range(0, len(lines), 10_000):
                    yield pd.DataFrame({"value": lines[lo : lo + 10_000]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "value string").filter("value != ''")


def read_h5_group(path: str, group: str, spark: SparkSession) -> DataFrame:
    """Sparse rows of a group (data, indices, indptr, shape) of an HDF5 file on the driver; needs the h5py package."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading HDF5 needs the h5py package, which is not installed") from e
    with h5py.File(path, "r") as f:
        g = f[group]
        rows = len(g["indptr"]) - 1
        return from_csr(spark, g["data"][:], g["indices"][:], g["indptr"][:], (rows, int(g["shape"][0])))


def read_raw_columns(spark: SparkSession, folder: str, skip_empty: bool = False) -> DataFrame:
    """Sparse rows of ``indptr.file``, ``indices.file``, ``data.file`` and ``shape.file`` (64-bit offsets and shape, 32-bit places, 32-bit values).

    The four files are one row of binary columns and so one task's, with at most 2 GB a file; larger matrices are better kept as
    Parquet.  Rows come sorted by place.
    """
    f = spark.read.format("binaryFile").load([f"{folder}/{x}.file" for x in ("indptr", "indices", "data", "shape")])
    one = f.select(F.regexp_extract("path", r"(\w+)\.file$", 1).alias("k"), "content").groupBy().pivot("k", ["indptr", "indices", "data", "shape"]).agg(F.first("content"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in frames:
            for _, r in g.iterrows():
                ptr, idx, val = np.frombuffer(r["indptr"], np.uint64).astype(np.int64), np.frombuffer(r["indices"], np.uint32), np.frombuffer(r["data"], np.float32)
                dim = int(np.frombuffer(r["shape"], np.uint32)[0])
                for lo in range(0, len(ptr) - 1, 4096):
                    own = range(lo, min(lo + 4096, len(ptr) - 1))
                    order = [np.argsort(idx[ptr[i] : ptr[i + 1]], kind="stable") for i in own]
                    yield pd.DataFrame({"id": list(own), "idx": [idx[ptr[i] : ptr[i + 1]][o].astype(np.int32) for i, o in zip(own, order, strict=True)], "val": [val[ptr[i] : ptr[i + 1]][o].astype(float) for i, o in zip(own, order, strict=True)], "dim": dim})

    out = one.mapInPandas(run, "id long, idx array<int>, val array<double>, dim int")
    return out.filter(F.size("idx") > 0) if skip_empty else out


def from_csr(spark: SparkSession, data, indices, indptr, shape: tuple[int, int]) -> DataFrame:
    """Sparse rows of an in-memory CSR triple."""
    ptr = np.asarray(indptr)
    if len(ptr) != shape[0] + 1 or ptr[-1] != len(data) or len(data) != len(indices):
        raise ValueError("data, indices, indptr and shape do not fit together")
    rows = [(i, [int(x) for x in indices[a:b]], [float(x) for x in data[a:b]], int(shape[1])) for i, (a, b) in enumerate(zip(ptr, ptr[1:], strict=False))]
    return spark.createDataFrame(rows, "id long, idx array<int>, val array<double>, dim int")


def from_items(spark: SparkSession, items: dict, dim: int) -> DataFrame:
    """Sparse rows of {id: [(place, value), ...]}."""
    return spark.createDataFrame([(i, [int(p) for p, _ in sorted(v)], [float(x) for _, x in sorted(v)], dim) for i, v in items.items()], "id long, idx array<int>, val array<double>, dim int")


def to_csr(sparse: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
    """(data, indices, indptr, shape) in the order of ids; for matrices that fit the driver."""
    rows = sparse.orderBy("id").select("idx", "val", "dim").collect()
    data = np.array([v for r in rows for v in r["val"]], float)
    indices = np.array([i for r in rows for i in r["idx"]], np.int64)
    indptr = np.concatenate([[0], np.cumsum([len(r["idx"]) for r in rows])]).astype(np.int64)
    return data, indices, indptr, (len(rows), rows[0]["dim"] if rows else 0)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, **properties) -> None:
    """Any matrix, coreset or sampler as Parquet, with its properties (seed, method, ...) as column metadata."""
    first = df.columns[0]
    df.withMetadata(first, {"properties": json.dumps(properties)} if properties else {}).write.mode("overwrite").parquet(path)


def properties(df: DataFrame) -> dict:
    """What ``write_table`` was given besides the rows."""
    return json.loads(df.schema[df.columns[0]].metadata.get("properties", "{}"))


def read_blobs(spark: SparkSession, path: str, labels: str | None = None) -> DataFrame:
    """id, features[, label] of space-separated rows below one header line."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.trim("value").alias("v"))
    head = rows.agg(F.min("n").alias("h")).first()["h"]
    from centrova.operators.matrix import _numbered

    rows = rows.filter((F.col("n") != head) & (F.col("v") != ""))
    out = rows.join(_numbered(rows, "n", "id"), "n").select("id", F.split("v", r"\s+").cast("array<double>").alias("features"))
    if labels is None:
        return out
    lab = spark.read.text(labels).filter("trim(value) != ''").select(F.monotonically_increasing_id().alias("n"), F.trim("value").cast("int").alias("label"))
    return out.join(lab.join(_numbered(lab, "n", "id"), "n").select("id", "label"), "id")


def blobs(spark: SparkSession, n: int, d: int, k: int, seed: int = 0, spread: float = 1.0, kind: str = "gaussian") -> DataFrame:
    """id, features, label of n rows around k centers: ``gaussian``, ``counts`` (Poisson) or ``multinomial`` (500 draws a row)."""
    centers = np.random.default_rng(seed).normal(0, 10, (k, d))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in frames:
            rows, labels = [], []
            for i in g["id"]:
                rng = np.random.default_rng([seed, int(i)])
                c = int(rng.integers(k))
                if kind == "gaussian":
                    x = centers[c] + rng.normal(0, spread, d)
                else:
                    rate = np.exp(centers[c] / 10 * spread)
                    x = rng.poisson(20 * rate).astype(float) if kind == "counts" else rng.multinomial(500, rate / rate.sum()).astype(float)
                rows.append(x)
                labels.append(c)
            yield pd.DataFrame({"id": g["id"], "features": rows, "label": labels})

    return spark.range(n).mapInPandas(run, "id long, features array<double>, label int")


def convert(long: DataFrame, dim: int, path: str) -> None:
    """Any long matrix to sparse Parquet."""
    long_to_sparse(long, dim).write.mode("overwrite").parquet(path)
