"""Every operator on a table of odd rows: nulls, empty and very long texts, repeated rows, clashing column names, no rows at all."""

import random
import time

import pytest
from pyspark.sql import functions as F

from centrova.llm import decontaminate, jaccard_join, license_scan, mixing, quality_classifier, quality_rules, substring_dedup, suffix_dedup, token_counts, toxicity
from centrova.llm.catalog import tokenizer_path


@pytest.fixture(scope="module")
def odd(spark, prose):
    long = prose(1, 180_000)  # above a slice of 1 MiB
    assert len(long) > 1 << 20
    rows = [(1, long, "a"), (2, None, "a"), (3, "", None), (None, prose(2, 80), "a"), (None, prose(3, 80), None), (4, "x" * 300_000, "b"), (5, "\x00\x1c  ퟿", "b")]
    rows += [(6, prose(4, 90), "b")] * 3 + [(7, prose(5, 90), "b"), (7, prose(6, 90), "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("key", "set_id", "n", "runs", "digest", "score", "size", "row", "family", "n_words", "kept", "k1", "pattern", "toxic", "item"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3).cache()


def counts(df):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in df.select("doc_id").collect())


@pytest.fixture(scope="module")
def bench(spark, odd):
    long = odd.filter("doc_id = 1").first()["text"]
    return spark.createDataFrame([(1, " ".join(long.split()[-30:])), (2, None), (None, "x")], "item_id long, text string").withColumn("words", F.lit(0))


def operators(spark, bench):
    labels = spark.createDataFrame([(1, 1), (1, 1), (6, 0), (7, 1), (None, 1)], "doc_id long, toxic int")
    return {
        "suffix": suffix_dedup.removals, "toxicity": lambda d: toxicity.toxicity(d, labels), "mixing": mixing.mixed_words, "quality": quality_classifier.classify, "licences": license_scan.licences,
        "substring": substring_dedup.removals, "jaccard": jaccard_join.components_by_id, "tokens": lambda d: token_counts.count_tokens(d, tokenizer_path()), "rules": quality_rules.verdicts, "leaks": lambda d: decontaminate.contamination_digest(d, bench),
    }


@pytest.mark.parametrize("name", ["suffix", "toxicity", "mixing", "quality", "licences", "substring", "jaccard", "tokens", "rules", "leaks"])
def test_a_row_for_every_document(spark, odd, bench, name):
    f = operators(spark, bench)[name]
    got = f(odd)
    assert counts(got) == counts(odd)
    same = [r.asDict() for r in got.filter("doc_id = 6").collect()]
    if name != "mixing":  # repeated rows take places of their own in the mix
        assert same[0] == same[1] == same[2]
    none = f(odd.limit(0))
    assert none.count() == 0 and none.columns == got.columns


def test_what_odd_rows_give(spark, odd, bench):
    leaks = {r["doc_id"]: r for r in decontaminate.contamination_digest(odd, bench).collect() if r["doc_id"] in (1, 2)}
    assert leaks[1]["contaminated"] and leaks[1]["n_items"] == 1 and leaks[1]["n_hit"] >= 30
    assert (leaks[2]["n_words"], leaks[2]["n_hit"]) == (0, 0)
    suffix = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.removals(odd).collect() if r["doc_id"] in (1, 4, 6)}
    assert suffix[1] == 0 and suffix[4] == 300_000 and suffix[6] > 400
    jaccard = {(r["doc_id"], r["n_shingles"] > 0): r["component_id"] for r in jaccard_join.components_by_id(odd).collect() if r["doc_id"] in (2, 3, 6)}
    assert jaccard == {(2, False): 2, (3, False): 3, (6, True): 6}


def test_near_copies_with_many_repeats_take_time_in_proportion(spark, prose):
    rng, text = random.Random(1), prose(9, 200)
    other = " ".join("edited" if i == 50 else w for i, w in enumerate(text.split()))
    took = []
    for n in (50, 4000):
        rows = [(i, text if i % 2 else other) for i in range(n)]
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        began = time.time()
        assert {r["component_id"] for r in jaccard_join.components_by_id(df).collect()} == {0}
        took.append(time.time() - began)
    assert took[1] < 4 * took[0] + 20  # 80 times the rows; pairs of rows would be 6,400 times as many
