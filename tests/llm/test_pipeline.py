"""The stages one after the other, each against what it should do to its own input, and the whole against a plain version."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from centrova.llm import mixing, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_quality(docs: dict) -> dict:
    lines, texts = defaultdict(set), defaultdict(set)
    norm = lambda line: " ".join(WORD.findall(fold(line)))
    for text, source in docs.values():
        texts[source].add(text)
        for line in (text or "").split("\n"):
            if WORD.search(line):
                lines[source, norm(line)].add(text)
    frequent = {k for k, v in lines.items() if len(v) > 20 and len(v) > 0.05 * len(texts[k[0]])}
    out = {}
    for d, (text, source) in docs.items():
        words = WORD.findall(text or "")
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        again = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
        gone = sum(len(WORD.findall(x)) for x in (text or "").split("\n") if (source, norm(x)) in frequent)
        if len(words) >= 50 and 100 * len(again) <= 50 * len(words) and 100 * (len(words) - gone) >= 50 * len(words):
            out[d] = (text, source)
    return out


def plain_one_of_each(docs: dict) -> dict:
    sets = {}
    for d, (text, _) in docs.items():
        w = WORD.findall(fold(text))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    group = {d: d for d in docs}
    for a in sorted(docs):
        for b in sorted(docs):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    return {d: docs[d] for d in docs if group[d] == d}


def plain_benchmark_free(docs: dict, items: list[str]) -> dict:
    windows = set()
    for text in items:
        w = ALNUM.findall(fold(text))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    out = {}
    for d, (text, source) in docs.items():
        w = ALNUM.findall(fold(text))
        if not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1)):
            out[d] = (text, source)
    return out


def test_pipeline_against_a_plain_version(spark, tmp_path, prose):
    import duckdb
    import pandas as pd

    line = prose(900, 60).replace("\n", " ")
    rows = [(i, prose(i, 100).replace("\n", " ") + "\n" + line, "src0") for i in range(24)]
    rows += [(30 + i, prose(100 + i, 40).replace("\n", " ") + "\n" + line, "src0") for i in range(3)]  # depleted
    rows += [(40 + i, prose(200 + i, 80 + 5 * i), f"src{i % 3}") for i in range(12)]
    near = rows[30][1].split(" ")
    for i in range(5):  # a chain of near copies
        near = [*near]
        near[7 * i] = f"edit{i}"
        rows.append((60 + i, " ".join(near), "src1"))
    passage, item = prose(901, 90), prose(902, 40)
    rows += [(70 + i, prose(300 + i, 60) + " " + passage + " " + prose(320 + i, 60), "src2") for i in range(4)]
    rows += [(80, prose(330, 60) + " " + " ".join(item.split()[4:30]) + " " + prose(331, 60), "src1"), (81, "short", "src1"), (82, None, "src2"), (83, " ".join(["again"] * 80), "src1"), (84, rows[28][1], None), (85, rows[32][1], None), (86, prose(340, 120), None)]
    docs = {d: (t, s) for d, t, s in rows}
    docs = plain_quality(docs)
    assert not {30, 31, 32, 81, 82, 83} & set(docs) and len(docs) < len(rows) - 5
    docs = plain_one_of_each(docs)
    left = substring_dedup.brute_force([(d, t) for d, (t, _) in docs.items()])
    docs = {d: (left[d].decode(), s) for d, (t, s) in docs.items() if left[d].decode() == t or WORD.search(left[d].decode())}
    docs = plain_benchmark_free(docs, [item])
    assert 80 not in docs and 40 in docs
    con = duckdb.connect()
    con.register("frame", pd.DataFrame([(d, t, s) for d, (t, s) in docs.items()], columns=["doc_id", "text", "source"]).astype({"text": object, "source": object}))
    con.sql("create table documents as select doc_id::BIGINT doc_id, text::VARCHAR text, source::VARCHAR source from frame")
    want = {d: taken // size for d, size, taken in con.sql(f"select doc_id, size, taken from ({mixing.oracle_sql()})").fetchall() if size and taken}

    df = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"], r["mix_copies"]) for r in got) == sorted((d, docs[d][0], n) for d, n in want.items())


def test_stages_take_effect(spark, tmp_path, prose):
    good = [(i, prose(i, 100 + i)) for i in range(12)]
    passage = prose(500, 90)
    rows = good + [(20, good[2][1]), (21, good[4][1] + " end"), (30, prose(30, 40) + " " + passage), (31, prose(31, 40) + " " + passage), (40, "too short"), (41, None), (50, prose(50, 30) + " " + " ".join(prose(700, 40).split()[5:30]) + " " + prose(51, 30))]
    df = spark.createDataFrame([(d, t, "en", f"src{d % 2}", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, prose(700, 40))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")).withColumn("__set", F.lit("x")).withColumn("__kept", F.lit(False)), []
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        before = docs.columns
        f(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        if i < 4:
            assert docs.columns == before
        seen.append({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
    assert not {40, 41} & set(seen[0])
    assert set(range(12)) <= set(seen[0])
    assert not {20, 21} & set(seen[1])
    assert len(seen[2][31]) < len(seen[1][31]) - 200
    assert seen[2][30] == seen[1][30]
    assert set(seen[2]) - set(seen[3]) == {50}
    assert set(seen[4]) <= set(seen[3])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in whole.collect()} == set(seen[4])
    assert whole.agg(F.min("mix_copies")).first()[0] >= 1


def test_stages_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
