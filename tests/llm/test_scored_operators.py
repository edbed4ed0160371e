"""Operators with trained models: held-out accuracy, and defined results for odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from centrova.llm import license_scan, quality_classifier, toxicity


@pytest.fixture(scope="module")
def marked(spark, prose):
    """(documents, labels): a third are toxic by one of five words, half of these in disguise."""
    rng, docs, labels = random.Random(4), [], []
    bad = {"moron": "m0r0n", "idiot": "1d1ot", "trash": "traaaash", "pathetic": "p a t h e t i c", "loser": "l-o-s-e-r"}
    for i in range(600):
        w = prose(10_000 + i, 40).split(" ")
        toxic = i % 3 == 0
        if toxic:
            word = rng.choice(list(bad))
            w.insert(rng.randrange(len(w)), bad[word] if i % 6 == 0 else word)
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs += [(9000, None), (9001, ""), (None, "moron")]
    # Plain words that the language model learns from.
    docs += [(20_000 + i, " ".join(bad)) for i in range(40)]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_is_learned_and_seen_through_disguise(marked):
    docs, labels = marked
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 50
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.95
    hidden = [r for r in held if r["doc_id"] % 6 == 0]
    assert sum(r["predicted"] for r in hidden) / len(hidden) > 0.85


def test_toxicity_of_odd_rows(marked):
    docs, labels = marked
    got = toxicity.toxicity(docs, labels)
    rows = {r["doc_id"]: r for r in got.filter("doc_id is null or doc_id >= 9000").collect()}
    assert rows[9000]["score"] == rows[9001]["score"] < 0.5
    assert rows[None]["held_out"]
    assert rows[None]["predicted"] == 1
    no_labels = toxicity.toxicity(docs.limit(5), labels.limit(0)).collect()
    assert [r["score"] for r in no_labels] == [pytest.approx(0.5)] * 5


def test_restorer_leaves_plain_words(marked):
    r = toxicity.Restorer(toxicity.language_model(marked[0]))
    assert r.text("Plain words, and 2.0 more") == "plain words, and 2.0 more"
    assert r.text("m0r0n!! l-o-s-e-r p a t h e t i c x") == "moron loser pathetic x"
    assert r.text('"l-0-s-e-r." (p a t h e t i c.) m.o.r.o.n, traaaash') == "loser ( pathetic .) moron trash"
    assert r.text("say i d i o t m o r o n now") == "say idiot moron now"


def test_quality_needs_no_labels(spark, prose):
    rng, rows = random.Random(2), []
    for i in range(400):
        t = prose(30_000 + i, 80)
        kind = i % 10
        if kind == 0:
            t = " ".join(w + rng.choice(["%%%", "###", "***"]) for w in t.split())
        elif kind == 1:
            t = " ".join(w for w in t.split()[:6] for _ in range(12))
        elif kind == 2:
            t = t.upper().replace(" ", "!! ")
        rows.append((i, t, int(kind > 2)))
    df = spark.createDataFrame(rows, "doc_id long, text string, sound int").withColumn("posterior", F.lit("x"))
    got = quality_classifier.classify(df).join(df.select("doc_id", "sound"), "doc_id").collect()
    assert sum(r["predicted"] == r["sound"] for r in got) / len(got) > 0.97
    odd = quality_classifier.classify(spark.createDataFrame([(1, None), (2, ""), (None, "a b")], "doc_id long, text string"))
    assert odd.count() == 3
    assert quality_classifier.classify(df.limit(0)).count() == 0


def test_label_model_finds_accuracies_and_dependence():
    """Votes drawn from known rates: EM finds them back, and labellers that copy each other share their weight."""
    import numpy as np

    rng, k = np.random.default_rng(1), len(quality_classifier.LABELLERS)
    unsound = rng.random(40_000) < 0.15
    rates = np.linspace(0.3, 0.9, k)
    alarm = np.where(unsound[:, None], rng.random((40_000, k)) < rates, rng.random((40_000, k)) < 0.02)
    alarm[:, 1] = alarm[:, 0]
    vote = np.where(rng.random((40_000, k)) < 0.1, 0, np.where(alarm, -1, 1))
    counts = np.bincount((vote + 1) @ quality_classifier._BASE, minlength=3**k)
    m = quality_classifier.expectation_maximisation(counts)
    assert abs(m.share[1] - 0.15) < 0.01
    assert np.abs(m.alarms[1, 2:] - rates[2:]).max() < 0.03
    assert np.abs(m.alarms[0, 2:] - 0.02).max() < 0.01
    assert np.abs(m.abstains - 0.1).max() < 0.01
    assert m.weights[:2].max() < 0.7 < 0.8 < m.weights[2:].min()
    sound = m.posterior[(vote + 1) @ quality_classifier._BASE] >= 0.5
    assert (sound == ~unsound).mean() > 0.98
    assert len(m.report()) == k


def test_quality_of_repeated_rows_and_long_texts(spark, prose):
    rows = [(1, prose(3, 60))] * 300 + [(2, prose(4, 30_000)), (None, prose(5, 60)), (3, "x" * 200_000)]
    got = quality_classifier.classify(spark.createDataFrame(rows, "doc_id long, text string"), sample_rows=50).collect()
    assert len(got) == len(rows)
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1


def test_licences(spark):
    rows = [
        (1, "text\nLicensed under the Apache License, Version 2.0.\nmore", ["apache-2.0"]),
        (2, "Released under the MIT License.", ["mit"]),
        (3, "This work is licensed under the GNU General Public License, version 3.", ["gpl-3.0"]),
        (4, "Licensed under CC BY-NC 4.0.", ["cc-by-nc-4.0"]),
        (5, "x\nAll rights reserved.", ["proprietary"]),
        (6, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and files", ["mit"]),
        (7, "She lost her driving license on a rainy day.", []),
        (8, "Apache helicopters and the public library", []),
        (9, None, []),
        (10, "", []),
        (None, "Released under the MIT License.\nAll rights reserved.", ["mit", "proprietary"]),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("family", F.lit(0))
    got = {r["doc_id"]: r["families"] for r in license_scan.licences(df).collect()}
    assert got == {d: f for d, _, f in rows}
    assert license_scan.licences(df.limit(0)).count() == 0


GPL3 = """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.
//
// This program is distributed in the hope that it will be useful,
// but WITHOUT ANY WARRANTY; without even the implied warranty of
// MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
// GNU General Public License for more details.
"""
BSD3 = """/*
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice, this
 *    list of conditions and the following disclaimer.
 *
 * 3. Neither the name of the copyright holder nor the names of its
 *    contributors may be used to endorse or promote products derived from
 *    this software without specific prior written permission.
 */"""


def test_wrapped_notices(spark, prose):
    long = prose(5, 40_000).replace("\n", " ")
    rows = [
        (1, GPL3, ["gpl-3.0"]),
        (2, BSD3, ["bsd-3-clause"]),
        (3, BSD3[: BSD3.index(" * 3.")], ["bsd-2-clause"]),
        (4, "All rights reserved seats are in row one", []),
        (5, "Licensed under the EUPL, Version 1.1 or later", []),
        (6, long + " Released under the MIT License.", ["mit"]),
        (7, prose(6, 100) + "\n# " + GPL3.replace("//", "#"), ["gpl-3.0"]),
        (1, GPL3, ["gpl-3.0"]),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    want = sorted((d, tuple(f)) for d, _, f in rows)
    for dealt in (df, df.repartition(5, "doc_id"), df.repartition(3)):
        assert sorted((r["doc_id"], tuple(r["families"])) for r in license_scan.licences(dealt).collect()) == want


def test_licences_of_families_left_out_are_mostly_unknown():
    """Trained without a family, its notices are taken for another one seldom, unless the two share their wording."""
    taken = total = 0
    for family in ("apache-2.0", "cc0-1.0", "isc", "mit", "mpl-2.0", "unlicense"):
        classes, weights, biases = license_scan.train(without=family, rounds=60)
        templates = license_scan.classes_of({f: t for f, t in license_scan.TEMPLATES.items() if f != family})
        for t in license_scan.TEMPLATES[family]:
            words = t.split()
            z = [sum(weights[g][c] for g in license_scan._grams(words) if g in weights) + biases[c] for c in range(len(classes))]
            best = classes[max(range(len(z)), key=z.__getitem__)]
            taken += best != license_scan.UNKNOWN and license_scan.confirmed(words, templates[best])
            total += 1
    assert taken / total <= 0.2


def test_licence_scan_runs_no_python(spark):
    df = spark.createDataFrame([(1, "MIT License")], "doc_id long, text string")
    plan = license_scan.licences(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
