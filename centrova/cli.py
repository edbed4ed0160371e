"""``python -m centrova.cli TASK INPUT OUTPUT``: cluster, select or sample a Parquet table of points and write the results.

Tasks: ``cluster`` (hard, or soft with a temperature; L1 and TVD give medians), ``d2`` (k-means++ seeds), ``kcenter`` (farthest points, with
``--outliers`` passing over some), ``coreset`` (importance sample under seeds), ``runs`` (seedings over several measures and priors).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centrova.options import CORESET_METHODS, ClusterOptions

#: Measures whose coresets need the sensitivities of Bregman divergences.
BREGMAN = {"MKL", "REVERSE_MKL", "ITAKURA_SAITO", "REVERSE_ITAKURA_SAITO", "JSD", "POISSON"}


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="centrova")
    p.add_argument("task", choices=["cluster", "d2", "kcenter", "coreset", "runs"])
    p.add_argument("input", help="Parquet table of points")
    p.add_argument("output", help="folder for the result tables")
    p.add_argument("--id", default="id")
    p.add_argument("--features", default="features")
    p.add_argument("--weight")
    p.add_argument("-k", type=int, nargs="+", default=[10], help="number of centers; runs takes several")
    p.add_argument("--measure", nargs="+", default=["SQRL2"], help="runs takes several")
    p.add_argument("--prior", type=float, nargs="+", default=[0.0], help="runs takes several")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--tries", type=int, default=0)
    p.add_argument("--local-search", type=int, default=0)
    p.add_argument("--temperature", type=float, default=0.0)
    p.add_argument("--outliers", type=float, default=0.0)
    p.add_argument("--method", default="BFL", choices=CORESET_METHODS)
    p.add_argument("--size", type=int, nargs="+", default=[1000], help="draws; one coreset for each")
    p.add_argument("--text", action="store_true", help="also write samples as text")
    return p


def write_assigned(assigned: DataFrame, output: str) -> None:
    """assignments (id, cid) and costs (id, cost)."""
    from centrova.sources.matrices import write_table

    if "cid" in assigned.columns:
        write_table(assigned.select("id", "cid"), f"{output}/assignments")
        write_table(assigned.select("id", "cost"), f"{output}/costs")
    else:
        write_table(assigned.select("id", "costs", "resp"), f"{output}/responsibilities")


def coresets(rows: DataFrame, o: ClusterOptions, method: str, sizes: list[int], text: bool, output: str) -> None:
    """importance (id, prob, weight) under seeds, and a sample of each size."""
    from centrova.operators import coreset, pairwise, seeding
    from centrova.plans.iterate import center_frame, saved
    from centrova.sources.matrices import write_table

    method = "LBK" if o.measure in BREGMAN else method
    s = seeding.best_of(rows, o.k, 1 + o.extra_tries, o.measure, o.prior, o.seed, o.candidates)
    assigned = saved(pairwise.assign(rows, s.centers, o.measure, o.prior))
    probs = saved(coreset.sensitivities(assigned.select("id", "cid", "cost", "weight"), method, o.k))
    write_table(center_frame(rows.sparkSession, s.centers), f"{output}/centers", ids=s.ids, measure=o.measure)
    write_assigned(assigned, output)
    write_table(probs, f"{output}/importance", method=method, seed=o.seed)
    for size in sizes:
        core = saved(coreset.sample(probs, size, o.seed))
        write_table(core, f"{output}/coreset_{size}", method=method, size=size)
        if text:
            lines = core.orderBy("id").select(F.format_string("%d\t%s", "id", F.col("weight").cast("string")).alias("value"))
            lines.coalesce(1).write.mode("overwrite").text(f"{output}/samples_{size}")  # as many lines as draws


def main(argv: list[str] | None = None) -> None:
    a = arguments().parse_args(argv)
    from centrova import api
    from centrova.operators import clustering
    from centrova.plans.iterate import center_frame
    from centrova.schema import points
    from centrova.sources.matrices import write_table

    spark = SparkSession.builder.getOrCreate()
    rows = points(spark.read.parquet(a.input), a.id, a.features, a.weight)
    options = [ClusterOptions(k=k, measure=m, prior=p, seed=a.seed, extra_tries=a.tries, local_search_rounds=a.local_search, temperature=a.temperature, outlier_fraction=a.outliers, coreset_method=a.method) for m in a.measure for p in a.prior for k in a.k]
    o = options[0]
    if a.task == "cluster":
        c = clustering.cluster(rows, o)
        write_table(center_frame(spark, c.centers), f"{a.output}/centers", measure=o.measure, costs=[float(x) for x in c.costs])
        write_assigned(c.assigned, a.output)
    elif a.task == "d2":
        r = api.d2_select(rows, o)
        write_table(center_frame(spark, r["centers"]), f"{a.output}/centers", ids=r["ids"], measure=o.measure, cost=float(r["cost"]))
        write_assigned(r["asn"], a.output)
    elif a.task == "kcenter":
        r = api.greedy_select(rows, o.k, msr=o.measure, prior=o.prior, seed=o.seed, outlier_fraction=o.outlier_fraction, ntimes=1 + o.extra_tries)
        write_table(center_frame(spark, r["centers"]), f"{a.output}/centers", ids=r["ids"], measure=o.measure, cost=float(r["cost"]))
    elif a.task == "coreset":
        coresets(rows, o, a.method, a.size, a.text, a.output)
    else:
        found, took = [], {}
        for x in options:
            name = f"{x.measure} {x.prior:g} {x.k}"
            with api.timed(took, name):
                cost = api.d2_select(rows, x)["cost"]
            found.append((x.measure, x.prior, x.k, float(cost), took[name]))
        write_table(spark.createDataFrame(found, "measure string, prior double, k int, cost double, seconds double"), f"{a.output}/runs", seed=a.seed)


if __name__ == "__main__":
    main()
