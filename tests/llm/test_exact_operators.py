"""Operators whose rows SQL or a brute-force version gives exactly."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from centrova.llm import column_bwt, decontaminate, jaccard_join, mixing, quality_rules, sql, substring_dedup, suffix_dedup, token_counts
from centrova.llm import textbytes as tb
from centrova.llm.catalog import tokenizer_path


def with_clashes(docs):
    """Columns named as the operators' own results."""
    return docs.withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("key", F.lit(None).cast("int")).withColumn("size", F.lit("s")).withColumn("name", F.lit(0))


@pytest.mark.parametrize("most_strings", [4096, 2])
def test_suffix_dedup(docs, rows, most_strings):
    want = suffix_dedup.brute_force([r[:2] for r in rows])
    got = suffix_dedup.removed_spans(with_clashes(docs), most_strings=most_strings).collect()
    assert len(got) == len(rows)
    texts = {d: (t or "").encode() for d, t, _ in rows}
    for r in got:
        spans = [tuple(r["spans"][i : i + 2]) for i in range(0, len(r["spans"]), 2)]
        assert spans == want[r["doc_id"]]
        left = substring_dedup.without(texts[r["doc_id"]], np.array(spans, np.int64).reshape(-1, 2))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(texts[r["doc_id"]]), len(texts[r["doc_id"]]) - len(left), len(spans), hashlib.sha256(left).hexdigest())


def test_column_bwt_finds_the_repeats_of_aligned_strings():
    rng = random.Random(1)
    core = bytes(rng.choice(b"ab") for _ in range(30))
    strings, column = [], []
    for _ in range(60):
        head, tail = (bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) for _ in range(2))
        strings.append(head + core + tail)
        column.append(len(head))
    found = column_bwt.repeated_starts(strings, np.array(column), 32)
    for i, s in enumerate(strings):
        for a in range(min(len(s) - 31, column[i] + 1)):  # segments hold no start beyond the column
            want = any(j != i and 0 <= (b := a - column[i] + column[j]) <= len(t) - 32 and t[b : b + 32] == s[a : a + 32] for j, t in enumerate(strings))
            assert found[i][a] == want


def test_segments_of_long_texts_match_those_of_slices(monkeypatch, rows):
    data = np.frombuffer(next(t for d, t, _ in rows if d == 407).encode(), np.uint8)
    offs = np.array([0, len(data)])
    whole = suffix_dedup.segments(data, offs)
    monkeypatch.setattr(tb, "SLICE_BYTES", 4096)
    parts = suffix_dedup.segments(data, offs)
    cover = lambda s: sorted({(a + i) for a, n in zip(s["start"], s["size"], strict=True) for i in range(n - 399)})
    assert cover(whole) == cover(parts)
    assert set(parts["key"]) == set(whole["key"])


def test_each_window_of_a_long_text_is_in_one_piece(monkeypatch, rows):
    data = np.frombuffer(next(t for d, t, _ in rows if d == 407).encode(), np.uint8)
    for limit in (4096, len(data) - 1, len(data) - 400):
        monkeypatch.setattr(tb, "SLICE_BYTES", limit)
        s = suffix_dedup.segments(data, np.array([0, len(data)]))
        starts = sorted(a + i for a, n in zip(s["start"].tolist(), s["size"].tolist(), strict=True) for i in range(n - 399))
        assert starts == list(range(len(data) - 399))


def test_suffix_dedup_of_texts_above_a_slice(spark):
    rng = random.Random(8)
    unique, passage = ("".join(rng.choices("abcdefghijklmnop \n", k=n)) for n in (1_060_000, 700))
    at = tb.SLICE_BYTES - 700  # across the end of the first piece
    table = [(1, unique), (2, unique[:at][::-1] + passage + unique[at:][::-1]), (3, "x" + passage + "y")]
    want = suffix_dedup.brute_force(table)
    assert want[1] == []
    got = suffix_dedup.removed_spans(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert {r["doc_id"]: [tuple(r["spans"][i : i + 2]) for i in range(0, len(r["spans"]), 2)] for r in got} == want


def test_substring_dedup(docs, rows):
    want = substring_dedup.brute_force([r[:2] for r in rows])
    got = {r["doc_id"]: r for r in substring_dedup.removals(with_clashes(docs)).collect()}
    assert {d: r["kept_sha256"] for d, r in got.items()} == {d: hashlib.sha256(b).hexdigest() for d, b in want.items()}
    assert all(got[300 + i]["n_removed"] > 300 for i in (1, 2, 3))
    assert got[0]["n_removed"] == 0
    texts = {r["doc_id"]: r["text"] for r in substring_dedup.deduplicated(docs).collect()}
    assert texts[101] == ""
    assert texts[400] is None


def test_jaccard_join(docs, duck, same):
    same(jaccard_join.components_by_id(with_clashes(docs)), duck.sql(sql.jaccard()))
    five = jaccard_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")
    same(five, duck.sql(sql.jaccard(k=5, percent=80)))


def test_jaccard_join_of_chains(spark, words):
    """Neighbours in the chain link, its ends do not; the component is the whole chain."""
    rng = random.Random(3)
    w = [rng.choice(words) + str(i) for i in range(300)]
    chain = []
    for i in range(60):
        for k in range(4):
            w[(i * 4 + k) % 300] = f"new{i}x{k}"
        chain.append((i, " ".join(w)))
    df = spark.createDataFrame(chain, "doc_id long, text string")
    assert {r["component_id"] for r in jaccard_join.near_duplicates(df, jaccard_join.Jaccard(1, 90)).collect()} == {0}
    assert jaccard_join.one_of_each(df, jaccard_join.Jaccard(1, 90)).count() == 1


def test_one_of_each_keeps_columns_and_word_less_rows(docs, rows):
    left = jaccard_join.one_of_each(with_clashes(docs))
    assert left.columns == with_clashes(docs).columns
    ids = {r["doc_id"] for r in left.select("doc_id").collect()}
    assert {3, 7, 400, 401, 402} <= ids
    assert not ids & {100, 101, 200, 204}


def test_token_counts(docs, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    t = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in token_counts.count_tokens(with_clashes(docs), path).collect()}
    for d, text, _ in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[d]["n_tokens"], got[d]["over_limit"], got[d]["n_bytes"]) == (n, n > 2048, len((text or "").encode()))


def test_token_counts_of_odd_texts():
    from tokenizers import Tokenizer

    path, rng = tokenizer_path(), random.Random(1)
    t = Tokenizer.from_file(path)
    signs = "abzAZéÉßİſ'’.,;:!?<|≯́ \n\t\r  ;019²Ⅷ½कि中文😀-"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += ["<|endoftext|>", "a<|endoftext|>b. <|startoftext|> x", "don't we're I'll. it's,", "İ! x", "ΑΣ. ΟΔΟΣ;"]
    split = lambda x: [c for p in token_counts.safe_parts(x, 25) for c in token_counts._SPACE.split(p)]
    assert token_counts.ChunkCounter(path).lengths([split(x) for x in texts]) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_under_other_rules(spark, rows, name):
    """White space belongs to the tokens of these, so whole texts are encoded."""
    path = tokenizer_path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        length = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    else:
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_file=path)
        length = lambda x: len(piece.encode(x))
    table = [(d, t) for d, t, _ in rows if not t or len(t) < 6000] + [(9, "a  b\n\n c <|endoftext|> d"), (10, " x")]
    got = token_counts.count_tokens(spark.createDataFrame(table, "doc_id long, text string"), path).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == sorted((d, length(t or "")) for d, t in table)


def test_token_counts_in_small_batches(docs, monkeypatch):
    count = token_counts.ChunkCounter(tokenizer_path())
    texts = [r["text"] or "" for r in docs.collect()]
    whole = [sum(count.lengths(list(count.parts(t)))) for t in texts]
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 500)
    monkeypatch.setattr(token_counts, "KEPT_BYTES", 2000)
    assert [sum(count.lengths([c])[0] for c in count.parts(t)) for t in texts] == whole


def test_substring_dedup_of_rows_without_ids(spark, prose):
    t, u = prose(11, 150), prose(12, 150)
    df = spark.createDataFrame([(None, t), (None, t + " and more"), (None, u), (7, "first " + u)], "doc_id long, text string")
    got = {r["text"][:20]: r["text"] for r in substring_dedup.deduplicated(df).collect()}
    kept = [x for x in got.values() if t[40:400] in x]
    assert len(kept) == 1  # of two texts without an id one keeps what they share
    assert sum(u[40:400] in x for x in got.values()) == 1
    assert "first " + u in got.values()


def test_lookups_of_two_key_sets_with_the_same_ends():
    one, two = np.array([1, 5, 1 << 60], np.uint64), np.array([1, 9 << 50, 1 << 60], np.uint64)
    assert decontaminate._Lookup(one).find(np.array([5, 9 << 50], np.uint64)).tolist() == [1, -1]
    assert decontaminate._Lookup(two).find(np.array([5, 9 << 50], np.uint64)).tolist() == [-1, 1]


def test_mixture_of_a_mixture(docs):
    again = mixing.mixed_documents(mixing.mixed_documents(docs))
    assert again.columns == [*docs.columns, "mix_copies", "mix_size", "mix_target"]
    assert again.count() > 0


def test_quality_rules(docs, duck, same, monkeypatch):
    rules = quality_rules.QualityRules()
    same(quality_rules.verdicts(with_clashes(docs), rules), duck.sql(sql.quality_rules()))
    # Few documents: lower the floor, so that lines do get frequent; both ways of looking them up must agree.
    rules = quality_rules.QualityRules(line_floor=1, line_share=0.0)
    want = sql.quality_rules().replace("> 20 AND count(DISTINCT l.text) > 0.05 * h.host_docs", "> 1")
    same(quality_rules.verdicts(docs, rules), duck.sql(want))
    monkeypatch.setattr(quality_rules, "BROADCAST_LINES", 0)
    same(quality_rules.verdicts(docs, rules), duck.sql(want))
    kept = quality_rules.kept_documents(with_clashes(docs))
    assert kept.columns == with_clashes(docs).columns
    assert 400 not in {r["doc_id"] for r in kept.collect()}


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 40])
def test_decontamination(spark, docs, rows, duck, same, block):
    text = {d: t for d, t, _ in rows}
    items = [(0, " ".join(text[5].split()[10:40])), (1, "one TWO"), (2, "x, " + " ".join(text[9].split()[3:12])), (3, None), (4, "!!"), (5, " ".join(text[5].split()[10:40])), (None, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    duck.sql("create or replace table benchmark (item_id BIGINT, text VARCHAR)")
    duck.executemany("insert into benchmark values (?, ?)", items)
    c = decontaminate.contamination(with_clashes(docs), bench, block=block)
    got = c.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
    same(got, duck.sql(sql.decontamination()))
    assert 5 not in {r["doc_id"] for r in decontaminate.clean_documents(docs, bench, block=block).collect()}


def test_mixing(docs, duck, same):
    same(mixing.mixed_words(with_clashes(docs)), duck.sql(mixing.oracle_sql()))
    rows = mixing.mixed_words(docs).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns[:3] == docs.columns
    assert mixed.filter("mix_copies < 1").count() == 0


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert suffix_dedup.removals(empty).count() == 0
    assert substring_dedup.removals(empty).count() == 0
    assert jaccard_join.components_by_id(empty).count() == 0
    assert jaccard_join.one_of_each(empty).count() == 0
    assert token_counts.count_tokens(empty, tokenizer_path()).count() == 0
    assert quality_rules.verdicts(empty).count() == 0
    assert decontaminate.contamination_digest(empty, bench).count() == 0
    assert mixing.mixed_words(empty).count() == 0


def test_null_ids_and_repeated_rows(spark, prose):
    t = prose(5, 150)
    df = spark.createDataFrame([(None, t, "a"), (None, t, "a"), (1, t, "a"), (1, t, "a"), (2, prose(6, 90), None)], "doc_id long, text string, source string")
    assert suffix_dedup.removals(df).filter("n_removed > 0").count() == 4
    assert substring_dedup.removals(df).count() == 5
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_join.components_by_id(df).collect()} == {(None, 1), (1, 1), (2, 2)}
    assert jaccard_join.one_of_each(df).count() == 2
    assert mixing.mixed_words(df).count() == 5
    assert quality_rules.verdicts(df).count() == 5


def test_words_and_ngrams():
    texts = ["Ab  cd\x0bef", "", "x", "\xa0y z"]
    for _, _, data, offs in tb.slices(pa.array(texts)):
        w = tb.words(data, offs, table=tb.FOLDED)
        assert np.diff(w.first).tolist() == [3, 0, 1, 2]
        v = tb.words(np.frombuffer(b"aB cd ef", np.uint8), np.array([0, 8]), table=tb.FOLDED)
        assert w.hash[:3].tolist() == v.hash.tolist()
        assert len(tb.ngrams(w, 2)[0]) == 3
        assert tb.whole_hash(w, 3)[0].tolist() == [2, 3]


def test_components_joined_by_later_links(spark):
    from centrova.llm.components import components, joined

    pairs = lambda rows: spark.createDataFrame(rows, "a long, b long")
    labels = components(pairs([(1, 2), (2, 3), (10, 11)]))
    got = {r["node"]: r["component"] for r in joined(labels, pairs([(3, 11), (20, 21), (1, 3)])).frame.collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 20: 20, 21: 20}


def test_near_copies_with_null_ids(spark):
    def edited(n: int, *at: int) -> str:
        return " ".join(f"edit{i}" if i in at else f"word{i}" for i in range(n))

    # 1 and 2 link only through the row without an id; 3 has no near copy
    chain = [(1, edited(90)), (None, edited(90, 30)), (2, edited(90, 30, 60)), (3, "other words of another text")]
    got = jaccard_join.components_by_id(spark.createDataFrame(chain, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got) == [(0, 1), (1, 1), (2, 1), (3, 3)]
    nameless = [(None, edited(200, 10 * i)) for i in range(1, 4)] + [(None, "other words of another text")]
    kept = jaccard_join.one_of_each(spark.createDataFrame(nameless, "doc_id long, text string")).collect()
    assert sorted(len(r["text"].split()) for r in kept) == [5, 200]
