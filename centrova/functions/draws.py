"""Repeatable random numbers: whole-number arithmetic on (seed, round, id) that any SQL engine repeats, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647


def uniform(id: Column, round: int | Column, seed: int) -> Column:
    """A number in (0, 1) for each id; ids are taken modulo 2**31 - 1 first, so none overflows."""
    r = F.lit(round).cast("long") if isinstance(round, int) else round.cast("long")
    h1 = ((F.pmod(id, F.lit(PRIME)) + 1) * 1103515245 + r * 40692 + seed * 69621) % PRIME
    h2 = (h1 * h1 + r * 48271 + seed) % PRIME
    return ((h2 * 48271 + 11) % PRIME + F.expr("0.5e0")) / F.expr("2147483647e0")


def uniform_sql(id: str, round: str | int, seed: int) -> str:
    """The same for DuckDB, for ids that are not negative."""
    h1 = f"((({id}) % {PRIME} + 1) * 1103515245 + ({round}) * 40692 + {seed * 69621}) % {PRIME}"
    h2 = f"(({h1}) * ({h1}) + ({round}) * 48271 + {seed}) % {PRIME}"
    return f"(((({h2}) * 48271 + 11) % {PRIME} + 0.5e0) / 2147483647e0)"


def race(weight: Column, u: Column) -> Column:
    """ln(u) / weight: the row with the greatest is a draw in proportion to weight, the n greatest are n draws without replacement."""
    return F.when(weight > 0, F.log(u) / weight)
