"""Options of clustering and coreset calls, checked once."""

from __future__ import annotations

from dataclasses import dataclass

from centrova.functions.measures import measure

CORESET_METHODS = ("BFL", "FL", "LFKF", "VX", "LBK")


@dataclass(frozen=True)
class ClusterOptions:
    """A measure, a prior, a number of clusters, and how to search.

    ``local_search_rounds`` swaps follow k-means++; ``extra_tries`` further seedings compete; ``temperature`` above 0 asks for soft
    clusters; ``outlier_fraction`` above 0 lets farthest-point selection pass over so many points.
    """

    k: int = 10
    measure: str = "SQRL2"
    prior: float = 0.0
    seed: int = 0
    candidates: int = 1
    extra_tries: int = 0
    local_search_rounds: int = 0
    max_iterations: int = 50
    epsilon: float = 1e-4
    temperature: float = 0.0
    outlier_fraction: float = 0.0
    coreset_method: str = "BFL"
    coreset_size: int = 0

    def __post_init__(self):
        measure(self.measure)
        if self.k < 1:
            raise ValueError("k must be 1 or more")
        if self.coreset_method not in CORESET_METHODS:
            raise ValueError(f"no such coreset method: {self.coreset_method}; there are {', '.join(CORESET_METHODS)}")
        if not 0 <= self.outlier_fraction < 1:
            raise ValueError("outlier_fraction must be in [0, 1)")
