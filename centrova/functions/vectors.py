"""Columns over dense arrays and sparse (idx, val, dim) rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from centrova.functions.measures import total


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def l1_norm(x: Column) -> Column:
    return total(F.transform(x, lambda v: F.abs(v)))


def l2_norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def scale(x: Column, by: Column | float) -> Column:
    return F.transform(x, lambda v: v * by)


def l2_normalised(x: Column) -> Column:
    """x over its 2-norm; as it is where that is 0."""
    n = l2_norm(x)
    return F.when(n > 0, F.transform(x, lambda v: v / n)).otherwise(x)


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / total(e))


def nnz(x: Column) -> Column:
    return F.size(F.filter(x, lambda v: v != 0))


def to_dense(idx: Column, val: Column, dim: Column) -> Column:
    """The array of a sparse row."""
    m = F.map_from_arrays(idx, val)
    return F.transform(F.sequence(F.lit(0), dim - 1), lambda i: F.coalesce(F.element_at(m, i.cast("int")), F.lit(0.0)))


def to_sparse(x: Column) -> Column:
    """struct(idx, val, dim) of an array."""
    at = F.filter(F.transform(x, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda s: s["v"] != 0)
    return F.struct(F.transform(at, lambda s: s["i"]).alias("idx"), F.transform(at, lambda s: s["v"]).alias("val"), F.size(x).alias("dim"))


def merge_cases(x_idx: Column, x_val: Column, y_idx: Column, y_val: Column, both, left, right) -> Column:
    """Array of what the three functions make of entries present in both rows, in x alone, in y alone, by index."""
    m = F.map_zip_with(F.map_from_arrays(x_idx, x_val), F.map_from_arrays(y_idx, y_val), lambda k, a, b: F.when(a.isNotNull() & b.isNotNull(), both(a, b)).when(a.isNotNull(), left(a)).otherwise(right(b)))
    return F.transform(F.array_sort(F.map_entries(m)), lambda e: e["value"])


def sparse_dot(x_idx: Column, x_val: Column, y_idx: Column, y_val: Column) -> Column:
    return total(merge_cases(x_idx, x_val, y_idx, y_val, lambda a, b: a * b, lambda a: F.lit(0.0), lambda b: F.lit(0.0)))


def sparse_l1(x_idx: Column, x_val: Column, y_idx: Column, y_val: Column) -> Column:
    return total(merge_cases(x_idx, x_val, y_idx, y_val, lambda a, b: F.abs(a - b), F.abs, F.abs))


def sparse_l2(x_idx: Column, x_val: Column, y_idx: Column, y_val: Column) -> Column:
    return F.sqrt(total(merge_cases(x_idx, x_val, y_idx, y_val, lambda a, b: (a - b) * (a - b), lambda a: a * a, lambda b: b * b)))


def on_l1_ball(x: Column, radius: float | Column = 1.0) -> Column:
    """The nearest array whose absolute values sum to at most radius: all shrink by one threshold, to no less than 0."""
    r = F.lit(float(radius)) if isinstance(radius, (int, float)) else radius
    sizes = F.reverse(F.array_sort(F.transform(x, F.abs)))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(0.0).alias("t"))

    def step(a: Column, v: Column) -> Column:
        s, n = a["s"] + v, a["n"] + 1
        return F.struct(s.alias("s"), n.alias("n"), F.greatest(a["t"], (s - r) / n).alias("t"))

    threshold = F.aggregate(sizes, start, step, lambda a: a["t"])
    return F.transform(x, lambda v: F.signum(v) * F.greatest(F.abs(v) - threshold, F.lit(0.0)))


def shared_zeros(x_idx: Column, y_idx: Column, dim: Column) -> Column:
    """How many positions are zero in both rows."""
    return dim - F.size(F.array_union(x_idx, y_idx))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371000.0) -> Column:
    """Metres between two points given in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))
