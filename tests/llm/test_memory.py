"""What goes to the driver or to Python workers is bounded, and what is above the bounds gives the same rows."""

from pyspark.sql import functions as F

from centrova.llm import frames, jaccard_join, quality_rules
from centrova.llm.components import Labels, components
from centrova.llm.frames import saved


def _hinted(df) -> bool:
    return "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()


def test_labels_are_broadcast_only_while_they_are_few(spark):
    few, many = (Labels(spark.range(n).selectExpr("id as node", "id as component"), n) for n in (1_000, 100_000))
    assert _hinted(few.of("a", "at_a"))
    assert not _hinted(many.of("a", "at_a"))


def test_components_of_many_links(spark):
    links = saved(spark.range(80_000).filter("id % 4 < 3").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    labels = components(links)
    assert labels.n == 80_000
    assert labels.frame.filter("component != node - node % 4").count() == 0


def test_names_of_many_sets_are_not_broadcast(spark, docs):
    j = jaccard_join.Jaccard()
    real = jaccard_join.set_rows(docs, j).filter("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("name"))
    none = spark.range(150_000).select(F.xxhash64("id").alias("set_id"), (F.col("id") + 1_000_000).alias("name"))
    wanted = saved(real.unionByName(none))
    out = jaccard_join._texts_of(docs, wanted, j)
    assert not _hinted(out)
    assert {r["set_id"] for r in out.collect()} == {r["set_id"] for r in real.collect()}


def test_quality_rules_send_texts_to_workers_once(spark, docs, monkeypatch):
    def sent(df) -> list[str]:
        plan = df._jdf.queryExecution().analyzed()
        while "MapInArrow" not in plan.nodeName():
            plan = plan.children().head()
        return [plan.children().head().output().apply(i).dataType().simpleString() for i in range(plan.children().head().output().size())]

    kept = quality_rules.kept_documents(docs)
    assert sorted(sent(kept)) == ["bigint", "string", "string"]
    want = {r["doc_id"]: r["kept"] for r in quality_rules.verdicts(docs).collect()}
    rows = {r["doc_id"]: tuple(r) for r in docs.collect()}
    assert sorted(tuple(r) for r in kept.collect()) == sorted(rows[d] for d, k in want.items() if k)
    # a text that is no string is carried as it is and read as one
    odd = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.lit(1).alias("source"))
    assert sorted(sent(quality_rules.kept_documents(odd))) == ["bigint", "binary", "int", "string", "string"]
    monkeypatch.setattr(quality_rules, "BROADCAST_LINES", -1)
    assert sorted(tuple(r) for r in quality_rules.kept_documents(docs).collect()) == sorted(rows[d] for d, k in want.items() if k)


def test_release_gives_native_memory_back(spark, monkeypatch):
    said = []
    monkeypatch.setattr(frames, "trim", lambda s, f=frames.trim: said.append(f(s)))
    frames.release(spark)
    assert len(said) == 1 and "Trim native heap" in said[0]
