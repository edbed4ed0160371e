"""Locality-sensitive hashing: l tables of k hashes each, as (table, key, id) rows; lookup is an equi-join."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from centrova.functions.screens import LEFT, RIGHT
from centrova.operators.pairwise import matrix_of
from centrova.plans.iterate import saved

#: Rows of one side that a tile of ``top_candidates`` holds.
TILE_ROWS = 65_536
FAMILIES = ("L2", "L1", "LP", "CLIPPED_L1", "TVD", "JSD", "HELLINGER", "S2JSD")


@dataclass(frozen=True)
class Tables:
    """Settings: hashes per table, number of tables, family, width of a cell (r or w), p of the stable law for LP, seed."""

    dim: int
    hashes: int = 4
    tables: int = 8
    family: str = "L2"
    width: float = 1.0
    p: float = 1.5
    seed: int = 0

    def __post_init__(self):
        if self.family not in FAMILIES:
            raise ValueError(f"no such family: {self.family}; there are {', '.join(FAMILIES)}")


def stable_law(p: float, size: tuple[int, ...], rng: np.random.Generator) -> np.ndarray:
    """Symmetric p-stable draws by the Chambers-Mallows-Stuck formula."""
    t, w = rng.uniform(-np.pi / 2, np.pi / 2, size), rng.exponential(1, size)
    return np.tan(t) if p == 1 else np.sin(p * t) / np.cos(t) ** (1 / p) * (np.cos((1 - p) * t) / w) ** ((1 - p) / p)


def projections(t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, offsets) of all hashes."""
    rng = np.random.default_rng(t.seed)
    n = t.hashes * t.tables
    if t.family in ("L1", "TVD"):
        r = rng.standard_cauchy((n, t.dim))
    elif t.family == "CLIPPED_L1":
        r = np.clip(rng.standard_cauchy((n, t.dim)), -1e3, 1e3)
    elif t.family == "LP":
        r = stable_law(t.p, (n, t.dim), rng)
    else:
        r = rng.standard_normal((n, t.dim))
    return r, rng.uniform(0, 1, n)


def hash_matrix(x: np.ndarray, t: Tables, r: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows, hashes) of whole numbers."""
    x = np.asarray(x, float)
    if t.family in ("JSD", "HELLINGER", "S2JSD", "TVD"):
        s = x.sum(axis=1, keepdims=True)
        x = np.where(s > 0, x / np.where(s > 0, s, 1), 0)
    if t.family in ("JSD", "HELLINGER"):
        return np.ceil(np.sqrt(x) @ r.T / t.width + b).astype(np.int64)
    if t.family == "S2JSD":
        return np.floor(np.sqrt(x @ (np.abs(r).T * 4 / t.width**2) + 1) + b).astype(np.int64)
    return np.floor(x @ r.T / t.width + b).astype(np.int64)


def index(points: DataFrame, t: Tables) -> DataFrame:
    """table, key, id of every row in every table."""
    sent = points.sparkSession.sparkContext.broadcast(projections(t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                h = hash_matrix(matrix_of(b.column(1)), t, *sent.value)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(h), pa.list_(pa.int64()))], ["id", "h"])

    hashed = points.select("id", "features").mapInArrow(run, "id long, h array<bigint>")
    keys = F.array(*[F.struct(F.lit(i).alias("table"), F.xxhash64(F.lit(i), F.slice("h", i * t.hashes + 1, t.hashes)).alias("key")) for i in range(t.tables)])
    return hashed.select("id", F.explode(keys).alias("k")).select("k.table", "k.key", "id")


def candidates(queries: DataFrame, base: DataFrame) -> DataFrame:
    """qid, id, matches: in how many tables two rows share a key; both sides come from ``index``."""
    q = queries.select("table", "key", F.col("id").alias("qid"))
    return q.join(base, ["table", "key"]).groupBy("qid", "id").agg(F.count("*").alias("matches"))


def top_candidates(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """The k rows of most matches for each query; ties to the lower id.

    Matches are counted in tiles of rows that hold all their keys, and only the k best of each query leave a tile: pairs that share a
    key are never made rows.  Where an id has several keys of a table, or none, ``candidates`` counts.
    """
    q, q_odd, q_n = _by_id(queries)
    b, b_odd, b_n = (q, q_odd, q_n) if base is queries else _by_id(base)
    w = W.partitionBy("qid").orderBy(F.desc("matches"), "id")
    found = candidates(queries, base) if q_odd or b_odd else _best_of_tiles(q, q_n, b, b_n, k)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _by_id(rows: DataFrame) -> tuple[DataFrame, bool, int]:
    """(id, keys: structs of table and key; whether an id is null or has a table twice; ids)."""
    own = saved(rows.filter("table is not null and key is not null").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("table", "key"))).alias("keys")))
    odd = F.col("id").isNull() | (F.size(F.array_distinct("keys.table")) < F.size("keys"))
    n, some = own.agg(F.count("*"), F.count_if(odd)).first()
    return own, some > 0, n


def _parts(n: int) -> int:
    return max(1, -(-n // TILE_ROWS), min(8, -(-n // 4096)))


def _best_of_tiles(q: DataFrame, q_n: int, b: DataFrame, b_n: int, k: int) -> DataFrame:
    """qid, id, matches of the k best of every tile."""
    n_tiles, n_blocks = _parts(q_n), _parts(b_n)
    own = ["id", F.col("keys.table").alias("tables"), F.col("keys.key").alias("keys")]
    asked = q.select(*own, F.pmod(F.xxhash64("id", F.lit(3)), F.lit(n_tiles)).cast("int").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"))
    held = b.select(*own, F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))).alias("t"))

    def run(key, x: pa.Table, y: pa.Table) -> pa.Table:
        qi, ids, n = most_matches(*_arrays(x), *_arrays(y), k)
        return pa.table({"qid": pa.array(qi, pa.int64()), "id": pa.array(ids, pa.int64()), "matches": pa.array(n, pa.int64())})

    return asked.groupBy("b", "t").cogroup(held.groupBy("b", "t")).applyInArrow(run, "qid long, id long, matches long")


def _arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids; and of every key its row, table and key)."""
    tables, keys = rows.column("tables").combine_chunks(), rows.column("keys").combine_chunks()
    row = np.repeat(np.arange(len(rows)), np.diff(keys.offsets.to_numpy()))
    return rows.column("id").to_numpy(), row, tables.flatten().to_numpy(), keys.flatten().to_numpy()


def _codes(names: np.ndarray, row: np.ndarray, keys: np.ndarray, n: int, none: int) -> np.ndarray:
    """The places of keys among names, one a row; none where a row has no key or another one."""
    out = np.full(n, none, np.int32)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    out[row] = np.where(names[at] == keys, at, none)
    return out


def most_matches(q_ids, q_row, q_table, q_key, b_ids, b_row, b_table, b_key, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, matches) of the k rows that share most keys with each query row, ties to the lower id; rows that share none are left out."""
    rank = np.empty(len(b_ids), np.int64)
    order = np.argsort(b_ids, kind="stable")
    rank[order] = np.arange(len(b_ids))
    ids, b_row = b_ids[order], rank[b_row]
    asked, held = [], []
    for t in np.intersect1d(q_table, b_table):
        ours, theirs = q_table == t, b_table == t
        names = np.unique(b_key[theirs])
        kind = np.uint16 if len(names) < 65_000 else np.int32
        asked.append(_codes(names, q_row[ours], q_key[ours], len(q_ids), len(names)).astype(kind))
        held.append(_codes(names, b_row[theirs], b_key[theirs], len(ids), len(names) + 1).astype(kind))
    out = [(np.zeros(0, np.int64),) * 3]
    for lo in range(0, len(q_ids) if asked else 0, LEFT):
        size = len(q_ids[lo : lo + LEFT])
        best, near = np.zeros((size, k), np.int64), np.zeros((size, k), np.int64)
        for begin in range(0, len(ids), RIGHT):
            n = np.zeros((size, len(ids[begin : begin + RIGHT])), np.uint8 if len(asked) < 256 else np.int32)
            for a, h in zip(asked, held, strict=True):
                n += a[lo : lo + LEFT, None] == h[None, begin : begin + RIGHT]
            rows = np.flatnonzero(n.max(axis=1) > best[:, -1])  # ids rise, so an equal number changes nothing
            if not len(rows):
                continue
            wide = n.shape[1]
            score = n[rows].astype(np.int32) * wide + np.arange(wide - 1, -1, -1, dtype=np.int32)
            top = np.argpartition(score, wide - k, axis=1)[:, wide - k :] if wide > k else np.broadcast_to(np.arange(wide), score.shape)
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, axis=1), axis=1), axis=1)
            both = np.concatenate([best[rows], np.take_along_axis(n[rows], top, axis=1)], axis=1)
            whose = np.concatenate([near[rows], ids[begin + top]], axis=1)
            take = np.argsort(-both, axis=1, kind="stable")[:, :k]
            best[rows], near[rows] = np.take_along_axis(both, take, axis=1), np.take_along_axis(whose, take, axis=1)
        ok = best > 0
        out.append((np.repeat(q_ids[lo : lo + LEFT], k)[ok.ravel()], near[ok], best[ok]))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))
