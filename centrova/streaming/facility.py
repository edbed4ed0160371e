"""Online facility location over streams: a shard keeps few facilities, and opens one with probability cost / facility cost.

When the cost or the number of facilities of a phase outgrows its bound, the bound is raised and the facilities are read again as
weighted points.  Shards run apart; ``combine`` clusters their facilities by weight, which approximates one run over all.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from centrova.functions import screens
from centrova.functions.measures import block_distance, measure
from centrova.operators.pairwise import matrix_of

#: Rows whose distances to the facilities are taken together, and rows of a batch that is returned.
BATCH, OUT_ROWS = 256, 10_000
FACILITIES = "shard int, facility int, features array<double>, weight double"


@dataclass(frozen=True)
class FacilitySettings:
    """k, an upper guess n of the number of items, the measure, and its factor in the triangle inequality."""

    k: int
    n: int = 1_000_000
    measure: str = "L1"
    alpha: float = 1.0
    seed: int = 0

    @property
    def beta(self) -> float:
        return 2 * self.alpha**2 * (3 * self.alpha + 1) + 2 * self.alpha

    @property
    def gamma(self) -> float:
        c = 3 * self.alpha + 1
        return max(self.beta * (6 * self.alpha + 1) * self.k + 1, 4 * self.alpha**3 * c**2 + 2 * self.alpha**2 * c)

    @property
    def spread(self) -> float:
        return self.k * (1 + math.log(max(self.n, 2)))

    @cached_property
    def most(self) -> float:
        """The facilities of a phase."""
        return max((self.gamma - 1) * (1 + math.log(max(self.n, 2))) * self.k, self.k)


def kmedian_stream(k: int, **more) -> FacilitySettings:
    return FacilitySettings(k, measure="L1", alpha=1.0, **more)


def kmeans_stream(k: int, **more) -> FacilitySettings:
    return FacilitySettings(k, measure="SQRL2", alpha=2.0, **more)


def l2_stream(k: int, **more) -> FacilitySettings:
    return FacilitySettings(k, measure="L2", alpha=1.0, **more)


class FacilityState:
    """The facilities of one shard."""

    def __init__(self, settings: FacilitySettings, bound: float = 0.0, cost: float = 0.0, seen: int = 0, rows: list | None = None, weights: list | None = None):
        self.s, self.bound, self.cost, self.seen = settings, bound, cost, seen
        self.weights: list[float] = list(weights or [])
        self._held = np.array(rows, float) if rows is not None and len(rows) else np.zeros((0, 0))

    @property
    def rows(self) -> np.ndarray:
        return self._held[: len(self.weights)]

    def add(self, x: list[float], weight: float = 1.0) -> None:
        self.extend(np.array([x], float), [weight])

    def extend(self, x: np.ndarray, weights: list[float]) -> None:
        """Add the rows of x in order: as one by one, with distances to the facilities taken for ``BATCH`` rows at once."""
        at = 0
        while at < len(x):
            at += self._some(x[at : at + BATCH], weights[at : at + BATCH])
            while self._full():
                self._next_phase()

    def _full(self) -> bool:
        return self.cost > self.s.gamma * self.bound > 0 or len(self.weights) > self.s.most

    def _some(self, x: np.ndarray, weights: list[float], again: bool = False) -> int:
        """Add rows of x until a bound is reached, and say how many; again: facilities that are read again, all of them."""
        if not self.weights:
            self.seen += 1
            self._open(x[0], weights[0])
            return 1
        before = len(self.weights)
        near, dist = screens.nearest(measure(self.s.measure), x, self.rows)
        among = block_distance(self.s.measure, x, x)
        fresh: list[int] = []
        for r, weight in enumerate(weights):
            self.seen += 1
            i, d = int(near[r]), float(dist[r])
            if fresh:
                new = among[r, fresh]
                j = int(new.argmin())
                if new[j] < d:
                    i, d = before + j, float(new[j])
            if self.bound == 0 and d > 0 and not again:
                self.bound = d
            if self._place(x[r], weight, i, d):
                fresh.append(r)
            if not again and self._full():
                return r + 1
        return len(x)

    def _open(self, x: np.ndarray, weight: float) -> None:
        n = len(self.weights)
        if n == len(self._held):
            held = np.empty((max(16, 2 * n), len(x)))
            held[:n] = self._held[:n] if n else 0
            self._held = held
        self._held[n] = x
        self.weights.append(weight)

    def _place(self, x: np.ndarray, weight: float, i: int, dist: float) -> bool:
        """Whether x opened a facility."""
        price = self.bound / self.s.spread
        u = random.Random(self.s.seed * 1_000_003 + self.seen).random()
        if dist > 0 and price > 0 and u < weight * dist / price:
            self._open(x, weight)
            return True
        self.weights[i] += weight
        self.cost += weight * dist
        return False

    def _next_phase(self) -> None:
        rows, weights = self.rows, self.weights
        self.bound, self.cost = self.bound * self.s.beta, 0.0
        self._held, self.weights = rows[:1].copy(), weights[:1]
        for lo in range(1, len(weights), BATCH):
            self._some(rows[lo : lo + BATCH], weights[lo : lo + BATCH], again=True)


def facilities(points: DataFrame, settings: FacilitySettings, shards: int) -> DataFrame:
    """shard, facility, features, weight of a table: every shard in one pass, ordered by id.

    A shard is a task's, which reads its rows as they come sorted and holds no more than the facilities.
    """

    def out(shard: int, st: FacilityState) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(st.weights), OUT_ROWS):
            x, w = st.rows[lo : lo + OUT_ROWS], st.weights[lo : lo + OUT_ROWS]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), shard, np.int32)), pa.array(np.arange(lo, lo + len(w), dtype=np.int32)), flat, pa.array(w, pa.float64())], ["shard", "facility", "features", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, st = None, FacilityState(settings)
        for b in batches:
            shard = b.column(0).to_numpy()
            cut = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard)) if len(shard) else [0]
            for lo, hi in zip(cut, cut[1:], strict=False):
                if shard[lo] != now:
                    yield from out(now, st)
                    now, st = int(shard[lo]), FacilityState(settings)
                st.extend(matrix_of(b.column(1).slice(lo, hi - lo)), b.column(2).slice(lo, hi - lo).to_pylist())
        yield from out(now, st)

    own = points.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "features", F.col("weight").cast("double").alias("weight"))
    dealt = own.repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("id").asc_nulls_last())
    return dealt.select("shard", "features", "weight").mapInArrow(run, FACILITIES)


def stream_facilities(points: DataFrame, settings: FacilitySettings, shards: int) -> DataFrame:
    """The same for a streaming DataFrame, with state per shard; output mode ``update`` gives each shard's facilities anew."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            bound, cost, seen, flat, weights, dim = state.get
            rows = [list(flat[i : i + dim]) for i in range(0, len(flat), dim)] if dim else []
            st = FacilityState(settings, bound, cost, seen, rows, list(weights))
        else:
            st = FacilityState(settings)
        for g in frames:
            if len(g):
                st.extend(np.array(g["features"].tolist(), float), [float(w) for w in g["weight"]])
        dim = st.rows.shape[1] if len(st.rows) else 0
        state.update((float(st.bound), float(st.cost), int(st.seen), st.rows.ravel().tolist(), [float(w) for w in st.weights], dim))
        yield pd.DataFrame({"shard": key[0], "facility": range(len(st.rows)), "features": list(st.rows), "weight": st.weights})

    own = points.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "features", "weight")
    schema = "bound double, cost double, seen long, flat array<double>, weights array<double>, dim int"
    return own.groupBy("shard").applyInPandasWithState(run, FACILITIES, schema, "update", GroupStateTimeout.NoTimeout)


def combine(found: DataFrame, k: int, settings: FacilitySettings, seed: int = 0):
    """k centers of the facilities of all shards, by weight."""
    from centrova.operators.clustering import hard
    from centrova.operators.seeding import kmeanspp
    from centrova.plans.iterate import saved

    pts = saved(found.select((F.col("shard").cast("long") * 1_000_000 + F.col("facility")).alias("id"), "features", "weight"))
    return hard(pts, kmeanspp(pts, k, settings.measure, seed=seed).centers, settings.measure, seed=seed, weighted=True)
