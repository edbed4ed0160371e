"""k-median on a distance table: local search, exhaustive search, primal-dual facility location.

These search one step after the other, so they gather a table of bounded size, and refuse a larger one.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells (facilities * clients) that may be gathered.
MOST_CELLS = 40_000_000


@dataclass
class MetricSolution:
    facilities: list[int]
    cost: float


def gathered(distances: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matrix, facility ids, client ids) of (facility, client, dist); absent pairs are infinite."""
    n = distances.agg(F.count_distinct("facility").alias("f"), F.count_distinct("client").alias("c")).first()
    if n["f"] * n["c"] > MOST_CELLS:
        raise ValueError(f"{n['f']} x {n['c']} distances are too many to search one after the other; take a coreset or a sample of facilities first")
    t = distances.select("facility", "client", "dist").toPandas()
    fac, i = np.unique(t["facility"], return_inverse=True)
    cli, j = np.unique(t["client"], return_inverse=True)
    m = np.full((len(fac), len(cli)), np.inf)
    m[i, j] = t["dist"]
    return m, fac, cli


def _greedy_start(m: np.ndarray, k: int) -> list[int]:
    first = int(m.sum(axis=1).argmin())
    chosen, near = [first], m[first].copy()
    while len(chosen) < k:
        gain = np.minimum(m, near).sum(axis=1)
        gain[chosen] = np.inf
        chosen.append(int(gain.argmin()))
        near = np.minimum(near, m[chosen[-1]])
    return chosen


def local_search(m: np.ndarray, k: int, eps: float = 0.0, start: list[int] | None = None, swaps: int = 1) -> tuple[list[int], float]:
    """Swap centers while a swap gains more than eps * cost / k; ``swaps`` > 1 also tries that many at once when single ones end."""
    k = min(k, len(m))
    chosen = list(start) if start else _greedy_start(m, k)
    cost = m[chosen].min(axis=0).sum()
    while True:
        own = m[chosen]
        order = np.argsort(own, axis=0, kind="stable")
        best = own[order[0], np.arange(m.shape[1])]
        second = own[order[1], np.arange(m.shape[1])] if k > 1 else np.full(m.shape[1], np.inf)
        found, found_cost = None, cost - max(eps * cost / k, 1e-12 * max(cost, 1))
        for out in range(k):
            rest = np.where(order[0] == out, second, best)
            total = np.minimum(m, rest).sum(axis=1)
            total[chosen] = np.inf
            i = int(total.argmin())
            if total[i] < found_cost:
                found, found_cost = (out, i), total[i]
        if found:
            chosen[found[0]] = found[1]
            cost = found_cost
            continue
        if swaps > 1:
            multi = _multi_swap(m, chosen, found_cost, swaps)
            if multi:
                chosen, cost = multi
                continue
        return sorted(chosen), float(cost)


def _multi_swap(m: np.ndarray, chosen: list[int], below: float, swaps: int) -> tuple[list[int], float] | None:
    for n in range(2, swaps + 1):
        outside = [i for i in range(len(m)) if i not in set(chosen)]
        for out in combinations(range(len(chosen)), n):
            kept = [c for i, c in enumerate(chosen) if i not in out]
            near = m[kept].min(axis=0) if kept else np.full(m.shape[1], np.inf)
            for into in combinations(outside, n):
                cost = np.minimum(near, m[list(into)].min(axis=0)).sum()
                if cost < below:
                    return kept + list(into), float(cost)
    return None


def exhaustive(m: np.ndarray, k: int) -> tuple[list[int], float]:
    return min(((list(c), float(m[list(c)].min(axis=0).sum())) for c in combinations(range(len(m)), k)), key=lambda x: x[1])


def primal_dual(m: np.ndarray, opening: float) -> tuple[list[int], float]:
    """Facility location by raising all clients' budgets at once: tight facilities open for now, then conflicting ones close."""
    n_f, n_c = m.shape
    active = np.ones(n_c, bool)
    budget = np.zeros(n_c)
    paid_at, tight = np.zeros(n_f), np.zeros(n_f, bool)
    time, order = 0.0, []
    edges = np.argsort(m, axis=None, kind="stable")
    e = 0
    flat = m.ravel()
    reached = np.zeros((n_f, n_c), bool)
    while active.any():
        rate = (reached & active).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            when = np.where(~tight & (rate > 0), time + (opening - paid_at) / rate, np.inf)
        nxt_f = int(when.argmin())
        while e < len(edges) and not active[edges[e] % n_c]:
            e += 1
        nxt_e = flat[edges[e]] if e < len(edges) else np.inf
        to = min(when[nxt_f], nxt_e)
        if not np.isfinite(to):
            break
        paid_at[~tight] += (rate * (to - time))[~tight]
        time = to
        if when[nxt_f] <= nxt_e:
            tight[nxt_f] = True
            order.append(nxt_f)
            done = reached[nxt_f] & active
        else:
            f, c = divmod(int(edges[e]), n_c)
            e += 1
            reached[f, c] = True
            done = np.zeros(n_c, bool)
            done[c] = tight[f]
        budget[done & active] = time
        active &= ~done
    budget[active] = time
    pays = (budget[None] > m) & tight[:, None]
    opened: list[int] = []
    for f in order:
        if not any((pays[f] & pays[g]).any() for g in opened):
            opened.append(f)
    if not opened:
        opened = [int(m.sum(axis=1).argmin())]
    return sorted(opened), float(m[opened].min(axis=0).sum())


def primal_dual_kmedian(m: np.ndarray, k: int, rounds: int = 40) -> tuple[list[int], float]:
    """k facilities: bisection on the opening cost (geometric means), then greedy adding or dropping to k."""
    k = min(k, len(m))
    lo, hi = max(m[m > 0].min(initial=1.0) * 1e-3, 1e-9), float(m[np.isfinite(m)].sum()) + 1.0
    best: list[int] | None = None
    for _ in range(rounds):
        mid = float(np.sqrt(lo * hi))
        opened, _ = primal_dual(m, mid)
        if best is None or abs(len(opened) - k) < abs(len(best) - k):
            best = opened
        if len(opened) == k:
            break
        lo, hi = (mid, hi) if len(opened) > k else (lo, mid)
    chosen = list(best)
    while len(chosen) < k:
        near = m[chosen].min(axis=0)
        total = np.minimum(m, near).sum(axis=1)
        total[chosen] = np.inf
        chosen.append(int(total.argmin()))
    while len(chosen) > k:
        costs = [m[[c for c in chosen if c != x]].min(axis=0).sum() for x in chosen]
        chosen.pop(int(np.argmin(costs)))
    return sorted(chosen), float(m[chosen].min(axis=0).sum())


def solve(distances: DataFrame, k: int, method: str = "local_search", **more) -> MetricSolution:
    """k facilities of (facility, client, dist) by ``local_search``, ``primal_dual`` or ``exhaustive``."""
    m, fac, _ = gathered(distances)
    f = {"local_search": local_search, "primal_dual": primal_dual_kmedian, "exhaustive": exhaustive}[method]
    chosen, cost = f(m, k, **more)
    return MetricSolution([int(fac[i]) for i in chosen], cost)


def thorup_matrix(distances: DataFrame, k: int, seed: int = 0, eps: float = 0.5, rounds: int | None = None) -> DataFrame:
    """facility: a sample with pruning over a distance table (facility, client, dist) whose facilities are clients too."""
    import math

    from centrova.operators.seeding import _draw
    from centrova.plans.iterate import saved

    spark = distances.sparkSession
    left = saved(distances.select(F.col("client").alias("id")).distinct())
    n = max(left.count(), 2)
    batch = max(1, math.ceil(21 * k * math.log(n) / eps))
    ids: list[int] = []
    for r in range(math.ceil(3 * math.log(n)) if rounds is None else rounds):
        if left.limit(batch + 1).count() <= batch:
            ids += [x["id"] for x in left.collect()]  # at most a batch
            break
        ids += _draw(left, F.lit(1.0), batch, r, seed)
        chosen = spark.createDataFrame([(int(i),) for i in dict.fromkeys(ids)], "facility long")
        near = distances.join(F.broadcast(chosen), "facility").groupBy(F.col("client").alias("id")).agg(F.min("dist").alias("cost"))
        costed = saved(left.join(near, "id"))
        pivot = _draw(costed, F.lit(1.0), 1, 5000 + r, seed)[0]
        left = saved(costed.filter(F.col("cost") > costed.filter(F.col("id") == pivot).first()["cost"]).select("id"))
        if left.limit(1).count() == 0:
            break
    return spark.createDataFrame([(int(i),) for i in dict.fromkeys(ids)], "facility long")


def primal_dual_on_graph(edges: DataFrame, candidates: DataFrame, k: int) -> MetricSolution:
    """k of the candidate vertices (id) by the primal-dual search over their distances in the graph."""
    from centrova.operators.graph import distance_rows

    return solve(distance_rows(edges, candidates), k, "primal_dual")


def restricted_search(distances: DataFrame, core: DataFrame, k: int, facilities: DataFrame | None = None, method: str = "local_search", **more) -> tuple[MetricSolution, float]:
    """(solution on the weighted clients of a coreset (id, weight), its cost over all clients); facilities (facility): only among these."""
    from centrova.operators.matrix import client_weighted

    own = distances if facilities is None else distances.join(facilities, "facility", "left_semi")
    few = client_weighted(own, core.select(F.col("id").alias("client"), "weight"))
    s = solve(few, k, method, **more)
    chosen = distances.sparkSession.createDataFrame([(i,) for i in s.facilities], "facility long")
    near = distances.join(F.broadcast(chosen), "facility").groupBy("client").agg(F.min("dist").alias("d"))
    return s, near.agg(F.sum("d").alias("c")).first()["c"] or 0.0


def distortion_table(distances: DataFrame, probs: DataFrame, sizes: list[int], sets: int, k: int, seed: int = 0, repeats: int = 1) -> DataFrame:
    """size, repeat, mean, most: how far a coreset's cost is from that of all clients, over random sets of k facilities.

    The sets are drawn once; their costs over all clients are one pass, and a coreset only adds its weights to these.
    """
    from centrova.functions.draws import uniform
    from centrova.operators.coreset import sample
    from centrova.plans.iterate import saved

    spark = distances.sparkSession
    facilities = distances.select("facility").distinct()
    drawn = spark.range(sets).withColumnRenamed("id", "set").crossJoin(facilities)
    u = uniform(F.col("facility") * 1_000_003 + F.col("set"), 31, seed)
    drawn = drawn.groupBy("set").agg(F.slice(F.sort_array(F.collect_list(F.struct(u.alias("u"), "facility"))), 1, k).alias("f")).select("set", F.explode("f.facility").alias("facility"))
    near = saved(distances.join(drawn, "facility").groupBy("set", "client").agg(F.min("dist").alias("d")))
    full = near.groupBy("set").agg(F.sum("d").alias("full"))
    out = None
    for i, size in enumerate(sizes):
        for r in range(repeats):
            core = sample(probs, size, seed + 97 * i + 13 * r).select(F.col("id").alias("client"), "weight")
            est = near.join(core, "client").groupBy("set").agg(F.sum(F.col("d") * F.col("weight")).alias("est"))
            off = full.join(est, "set", "left").select(F.abs(F.coalesce("est", F.lit(0.0)) / F.col("full") - 1).alias("x"))
            row = off.agg(F.lit(size).alias("size"), F.lit(r).alias("repeat"), F.avg("x").alias("mean"), F.max("x").alias("most"))
            out = row if out is None else out.union(row)
    return out


def kz_clustering(vertices: DataFrame, edges: DataFrame, k: int, z: float = 1.0, coreset_size: int = 100, seed: int = 0, sizes: tuple[int, ...] = (), sets: int = 20, repeats: int = 1) -> dict:
    """The chain for graphs: sampled facilities, their distances, powers, local search, costs of all vertices, a coreset.

    sizes: also a table of distortions of coresets of these sizes, and the cost that a search on each of them reaches.
    """
    from centrova.operators.coreset import sample, sensitivities
    from centrova.operators.graph import distance_rows, shortest_paths, thorup_graph
    from centrova.operators.matrix import powered
    from centrova.plans.iterate import saved

    facilities = thorup_graph(vertices, edges, k, seed)
    d = saved(powered(distance_rows(edges, facilities), z))
    found = solve(d, k)
    centers = vertices.sparkSession.createDataFrame([(i,) for i in found.facilities], "id long")
    near = shortest_paths(edges, centers)
    costed = saved(near.select("id", F.col("source").alias("cid"), F.pow("dist", F.lit(float(z))).alias("cost"), F.lit(1.0).alias("weight")))
    probs = saved(sensitivities(costed, "BFL"))
    out = {"solution": found, "costs": costed, "probabilities": probs, "coreset": sample(probs, coreset_size, seed)}
    if sizes:
        out["distortion"] = distortion_table(d, probs, list(sizes), sets, k, seed, repeats)
        out["restricted"] = {m: restricted_search(d, sample(probs, m, seed), k)[1] for m in sizes}
    return out
