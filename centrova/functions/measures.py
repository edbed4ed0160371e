"""Dissimilarity measures: one registry entry per measure, as a Spark Column over two arrays and as NumPy over blocks of rows.

Measures on distributions see ``p = (x + prior) / (sum(x) + prior * d)``; the others see x as it is.  Logarithms are natural and
``0 ln 0 = 0``; a Kullback-Leibler term with nothing to divide by is infinite, so give a prior.  The first argument is the point and
the second the center.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INF = float("inf")


@dataclass(frozen=True)
class Measure:
    name: str
    number: int | None
    text: str
    column: Callable[[Column, Column, Column, Column], Column]
    block: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    probability: bool = False
    symmetric: bool = True
    similarity: bool = False
    #: The center that the measure's clusters have: mean, l1_median, tvd_median or geo_median.
    centroid: str = "mean"


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _sum(x: Column, y: Column, term: Callable[[Column, Column], Column]) -> Column:
    return total(F.zip_with(x, y, term))


def _xlogxy(x: Column, y: Column) -> Column:
    return F.when(x <= 0, F.lit(0.0)).when(y <= 0, F.lit(INF)).otherwise(x * F.log(x / y))


def _kl(p: Column, q: Column) -> Column:
    return _sum(p, q, _xlogxy)


def _mid(p: Column, q: Column, share: Column | float = 0.5) -> Column:
    return F.zip_with(p, q, lambda a, b: a * share + b * (1 - share))


def _jsd(p: Column, q: Column) -> Column:
    return _sum(p, q, lambda a, b: 0.5 * _xlogxy(a, (a + b) / 2) + 0.5 * _xlogxy(b, (a + b) / 2))


def _uwllr(p: Column, q: Column, sx: Column, sy: Column) -> Column:
    share = F.when(sx + sy > 0, sx / (sx + sy)).otherwise(F.lit(0.5))
    return _sum(p, q, lambda a, b: share * _xlogxy(a, share * a + (1 - share) * b) + (1 - share) * _xlogxy(b, share * a + (1 - share) * b))


def _itakura(p: Column, q: Column) -> Column:
    def term(a: Column, b: Column) -> Column:
        return F.when((a <= 0) & (b <= 0), F.lit(0.0)).when((a <= 0) | (b <= 0), F.lit(INF)).otherwise(a / b - F.log(a / b) - 1)

    return _sum(p, q, term)


def _cosine(x: Column, y: Column) -> Column:
    norm = F.sqrt(_sum(x, x, lambda a, b: a * b)) * F.sqrt(_sum(y, y, lambda a, b: a * b))
    return F.when(norm > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _sum(x, y, lambda a, b: a * b) / norm))).otherwise(F.lit(0.0))


def _overlap(p: Column, q: Column) -> Column:
    return _sum(p, q, lambda a, b: F.sqrt(a * b))


def _power(z: float) -> Callable[[Column, Column], Column]:
    return lambda x, y: _sum(x, y, lambda a, b: F.pow(F.abs(a - b), F.lit(float(z))))


def _sq(x: Column, y: Column) -> Column:
    return _sum(x, y, lambda a, b: (a - b) * (a - b))


# NumPy twins: (n, d) points and (k, d) centers give (n, k).


def _each(f: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    return lambda x, y: np.stack([f(x, c) for c in y], axis=1) if len(y) else np.zeros((len(x), 0))


def _np_xlogxy(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(a <= 0, 0.0, np.where(b <= 0, np.inf, a * np.log(a / b)))


def _np_kl(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return _each(lambda x, c: _np_xlogxy(x, c).sum(axis=1))(p, q)


def _np_jsd(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return _each(lambda x, c: 0.5 * (_np_xlogxy(x, (x + c) / 2) + _np_xlogxy(np.broadcast_to(c, x.shape), (x + c) / 2)).sum(axis=1))(p, q)


def _np_uwllr(p: np.ndarray, q: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
    out = np.empty((len(p), len(q)))
    for j, c in enumerate(q):
        both = sx + sy[j]
        share = np.where(both > 0, sx / np.where(both > 0, both, 1), 0.5)[:, None]
        r = share * p + (1 - share) * c
        out[:, j] = (share * _np_xlogxy(p, r) + (1 - share) * _np_xlogxy(np.broadcast_to(c, p.shape), r)).sum(axis=1)
    return out


def _np_is_rows(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        v = x / c - np.log(x / c) - 1
    return np.where((x <= 0) & (c <= 0), 0.0, np.where((x <= 0) | (c <= 0), np.inf, v)).sum(axis=1)


def _np_is(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return _each(_np_is_rows)(p, q)


def _np_cos(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None]
    return np.where(norm > 0, np.clip((x @ y.T) / np.where(norm > 0, norm, 1), -1, 1), 0.0)


def _np_sq(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _each(lambda a, c: ((a - c) ** 2).sum(axis=1))(x, y)


def _np_overlap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(p, 0)) @ np.sqrt(np.maximum(q, 0)).T


def _np_power(z: float):
    return _each(lambda a, c: (np.abs(a - c) ** z).sum(axis=1))


def _np_mid_is(p: np.ndarray, q: np.ndarray, reverse: bool) -> np.ndarray:
    def one(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        m, c = (x + c) / 2, np.broadcast_to(c, x.shape)
        return (_np_is_rows(m, x) + _np_is_rows(m, c)) / 2 if reverse else (_np_is_rows(x, m) + _np_is_rows(c, m)) / 2

    return _each(one)(p, q)


def _sis(p: Column, q: Column, reverse: bool) -> Column:
    m = _mid(p, q)
    return (_itakura(m, p) + _itakura(m, q)) / 2 if reverse else (_itakura(p, m) + _itakura(q, m)) / 2


def _two(f):
    """A function of the values alone, as one that also gets their sums."""
    return lambda x, y, sx, sy: f(x, y)


def _plain(name, number, text, column, block, **more) -> Measure:
    return Measure(name, number, text, _two(column), _two(block), **more)


#: Names and numbers are fixed values.
_ALL = [
    _plain("L1", 0, "sum of absolute differences", lambda x, y: _sum(x, y, lambda a, b: F.abs(a - b)), _each(lambda a, c: np.abs(a - c).sum(axis=1)), centroid="l1_median"),
    _plain("L2", 1, "Euclidean distance", lambda x, y: F.sqrt(_sq(x, y)), lambda x, y: np.sqrt(_np_sq(x, y)), centroid="geo_median"),
    _plain("SQRL2", 2, "squared Euclidean distance", _sq, _np_sq),
    _plain("JSM", 3, "square root of the Jensen-Shannon divergence", lambda p, q: F.sqrt(F.greatest(F.lit(0.0), _jsd(p, q))), lambda p, q: np.sqrt(np.maximum(_np_jsd(p, q), 0)), probability=True),
    _plain("JSD", 4, "Jensen-Shannon divergence", _jsd, _np_jsd, probability=True),
    _plain("MKL", 5, "Kullback-Leibler divergence of point from center", _kl, _np_kl, probability=True, symmetric=False),
    _plain("HELLINGER", 6, "Hellinger distance", lambda p, q: F.sqrt(_sum(p, q, lambda a, b: (F.sqrt(a) - F.sqrt(b)) * (F.sqrt(a) - F.sqrt(b)))), lambda p, q: np.sqrt(_np_sq(np.sqrt(p), np.sqrt(q))), probability=True),
    _plain("BHATTACHARYYA_METRIC", 7, "square root of one minus the Bhattacharyya coefficient", lambda p, q: F.sqrt(F.greatest(F.lit(0.0), 1 - _overlap(p, q))), lambda p, q: np.sqrt(np.maximum(1 - _np_overlap(p, q), 0)), probability=True),
    _plain("BHATTACHARYYA_DISTANCE", 8, "minus logarithm of the Bhattacharyya coefficient", lambda p, q: F.when(_overlap(p, q) > 0, -F.log(_overlap(p, q))).otherwise(F.lit(INF)), lambda p, q: -np.log(np.maximum(_np_overlap(p, q), 1e-300)), probability=True),
    _plain("TVD", 9, "total variation distance", lambda p, q: _sum(p, q, lambda a, b: F.abs(a - b)) / 2, lambda p, q: _each(lambda a, c: np.abs(a - c).sum(axis=1) / 2)(p, q), probability=True, centroid="tvd_median"),
    Measure("LLR", 10, "log-likelihood ratio", lambda p, q, sx, sy: (sx + sy) * _uwllr(p, q, sx, sy), lambda p, q, sx, sy: (sx[:, None] + sy[None]) * _np_uwllr(p, q, sx, sy), True),
    _plain("REVERSE_MKL", 11, "Kullback-Leibler divergence of center from point", lambda p, q: _kl(q, p), lambda p, q: _np_kl(q, p).T, probability=True, symmetric=False),
    Measure("UWLLR", 12, "log-likelihood ratio per unit of weight", _uwllr, _np_uwllr, True),
    _plain("ITAKURA_SAITO", 13, "Itakura-Saito distance", _itakura, _np_is, probability=True, symmetric=False),
    _plain("REVERSE_ITAKURA_SAITO", 14, "Itakura-Saito distance, arguments swapped", lambda p, q: _itakura(q, p), lambda p, q: _np_is(q, p).T, probability=True, symmetric=False),
    _plain("COSINE_DISTANCE", 15, "angle as a share of a half turn", lambda x, y: F.acos(_cosine(x, y)) / math.pi, lambda x, y: np.arccos(_np_cos(x, y)) / math.pi),
    _plain("PROBABILITY_COSINE_DISTANCE", 16, "angle between distributions as a share of a half turn", lambda x, y: F.acos(_cosine(x, y)) / math.pi, lambda x, y: np.arccos(_np_cos(x, y)) / math.pi, probability=True),
    _plain("COSINE_SIMILARITY", 17, "cosine of the angle", _cosine, _np_cos, similarity=True),
    _plain("SYMMETRIC_ITAKURA_SAITO", 23, "mean Itakura-Saito distance to the midpoint", lambda p, q: _sis(p, q, False), lambda p, q: _np_mid_is(p, q, False), probability=True),
    _plain("RSYMMETRIC_ITAKURA_SAITO", 24, "mean Itakura-Saito distance from the midpoint", lambda p, q: _sis(p, q, True), lambda p, q: _np_mid_is(p, q, True), probability=True),
    Measure("SRLRT", 25, "square root of the log-likelihood ratio", lambda p, q, sx, sy: F.sqrt(F.greatest(F.lit(0.0), (sx + sy) * _uwllr(p, q, sx, sy))), lambda p, q, sx, sy: np.sqrt(np.maximum((sx[:, None] + sy[None]) * _np_uwllr(p, q, sx, sy), 0)), True),
    Measure("SRULRT", 26, "square root of the log-likelihood ratio per unit of weight", lambda p, q, sx, sy: F.sqrt(F.greatest(F.lit(0.0), _uwllr(p, q, sx, sy))), lambda p, q, sx, sy: np.sqrt(np.maximum(_np_uwllr(p, q, sx, sy), 0)), True),
    _plain("PSL2", None, "squared Euclidean distance of distributions", _sq, _np_sq, probability=True),
    _plain("PL2", None, "Euclidean distance of distributions", lambda x, y: F.sqrt(_sq(x, y)), lambda x, y: np.sqrt(_np_sq(x, y)), probability=True, centroid="geo_median"),
    _plain("L3", None, "3-norm of the difference", lambda x, y: F.pow(_power(3)(x, y), F.lit(1 / 3)), lambda x, y: _np_power(3)(x, y) ** (1 / 3)),
    _plain("L4", None, "4-norm of the difference", lambda x, y: F.pow(_power(4)(x, y), F.lit(1 / 4)), lambda x, y: _np_power(4)(x, y) ** (1 / 4)),
    _plain("LINF", None, "largest absolute difference", lambda x, y: F.coalesce(F.array_max(F.zip_with(x, y, lambda a, b: F.abs(a - b))), F.lit(0.0)), lambda x, y: _each(lambda a, c: np.abs(a - c).max(axis=1, initial=0))(x, y)),
    _plain("SQRL1", None, "square of L1", lambda x, y: F.pow(_power(1)(x, y), F.lit(2.0)), lambda x, y: _np_power(1)(x, y) ** 2),
    _plain("SQRL3", None, "square of L3", lambda x, y: F.pow(_power(3)(x, y), F.lit(2 / 3)), lambda x, y: _np_power(3)(x, y) ** (2 / 3)),
    _plain("SQRL4", None, "square of L4", lambda x, y: F.pow(_power(4)(x, y), F.lit(1 / 2)), lambda x, y: _np_power(4)(x, y) ** (1 / 2)),
    _plain("SQRLINF", None, "square of LINF", lambda x, y: F.pow(F.coalesce(F.array_max(F.zip_with(x, y, lambda a, b: F.abs(a - b))), F.lit(0.0)), F.lit(2.0)), lambda x, y: _each(lambda a, c: np.abs(a - c).max(axis=1, initial=0) ** 2)(x, y)),
]
MEASURES = {m.name: m for m in _ALL}
_BY_NUMBER = {m.number: m for m in _ALL if m.number is not None}
_ALIASES = {"SIS": "SYMMETRIC_ITAKURA_SAITO", "RSIS": "RSYMMETRIC_ITAKURA_SAITO", "PROBCOS": "PROBABILITY_COSINE_DISTANCE", "MATUSITA": "HELLINGER"}

Spec = "str | int | Measure | Callable[[Column, Column], Column]"


def measure(which) -> Measure:
    """A measure by name, alias, number, or from a function of two array Columns."""
    if isinstance(which, Measure):
        return which
    if callable(which):
        return Measure(getattr(which, "__name__", "custom"), None, "custom", _two(which), None)
    if isinstance(which, int) and which in _BY_NUMBER:
        return _BY_NUMBER[which]
    name = str(which).upper()
    name = _ALIASES.get(name, name)
    if name not in MEASURES:
        raise ValueError(f"no such measure: {which}; there are {', '.join(MEASURES)}")
    return MEASURES[name]


def minkowski(p: float) -> Measure:
    """The p-norm of the difference."""
    return _plain(f"L{p:g}", None, f"{p:g}-norm of the difference", lambda x, y: F.pow(_power(p)(x, y), F.lit(1 / p)), lambda x, y: _np_power(p)(x, y) ** (1 / p))


def hellinger(scale: float) -> Measure:
    """The Hellinger distance times a scale; 1 / sqrt(2) bounds it by 1."""
    h = MEASURES["HELLINGER"]
    return Measure("SCALED_HELLINGER", None, "scaled Hellinger distance", lambda p, q, sx, sy: h.column(p, q, sx, sy) * scale, lambda p, q, sx, sy: h.block(p, q, sx, sy) * scale, True)


def _np_poisson(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (_np_xlogxy(x, np.broadcast_to(c, x.shape)) - x + c).sum(axis=1)


#: Not in the registry of numbers: the divergence of Poisson rates, sum of x ln(x / y) - x + y.
POISSON = _plain("POISSON", None, "Bregman divergence of Poisson rates", lambda x, y: _sum(x, y, lambda a, b: _xlogxy(a, b) - a + b), _each(_np_poisson), symmetric=False)


def registry(spark: SparkSession) -> DataFrame:
    """name, number, text of all measures."""
    return spark.createDataFrame([(m.name, m.number, m.text) for m in _ALL], "name string, number int, text string")


def distribution(x: Column, prior: float = 0.0) -> Column:
    """(x + prior) / (sum(x) + prior * d); zeros where that is 0 / 0."""
    beta = F.lit(float(prior)) if prior >= 0 else F.lit(1.0) / F.size(x)
    whole = total(x) + F.size(x) * beta
    return F.transform(x, lambda v: F.when(whole > 0, (v + beta) / whole).otherwise(F.lit(0.0)))


def distance(which, x: Column, y: Column, prior: float = 0.0) -> Column:
    """The measure of two arrays, as a Column; a negative prior stands for 1 / d."""
    m = measure(which)
    if not m.probability:
        return m.column(x, y, None, None)
    return m.column(distribution(x, prior), distribution(y, prior), total(x), total(y))


def block_distance(which, x: np.ndarray, y: np.ndarray, prior: float = 0.0) -> np.ndarray:
    """The measure of every row of x (points) and of y (centers)."""
    m = measure(which)
    if m.block is None:
        raise ValueError("a measure given as a Column function has no NumPy form")
    x, y = np.asarray(x, float), np.asarray(y, float)
    if not m.probability:
        return m.block(x, y, None, None)
    prior = 1.0 / x.shape[1] if prior < 0 else prior
    sx, sy = x.sum(axis=1), y.sum(axis=1)

    def share(v: np.ndarray, s: np.ndarray) -> np.ndarray:
        whole = (s + prior * v.shape[1])[:, None]
        return np.where(whole > 0, (v + prior) / np.where(whole > 0, whole, 1), 0.0)

    return m.block(share(x, sx), share(y, sy), sx, sy)
