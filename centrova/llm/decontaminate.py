"""Benchmark decontamination by a prefix-filtered set join.

Items are cut into windows of ``width`` consecutive words (an item of fewer words is one window).  The set of a window is its
shingles of up to ``shingle`` words; a text can hold the window only if it holds all of them, so the prefix needed for a join on
whole containment is the single rarest one, by its count over all documents.  Texts are joined to windows on that shingle; its
place in the window gives the only start the window can have (positional bound), which must leave room for the whole window
within the text (length bound); then all the window's words are compared.

Windows go to the workers in blocks of at most ``block`` windows and names of their items, one pass over the documents per block, so
what is broadcast is bounded however many items there are, unless one window alone has more items.

Defined results: null or word-less texts have no words and no hits; word-less items have no window; items of equal text all
count; the windows of items with null item_id are looked for and hit words, but such items are not named or counted among the items
found; repeated document rows each give a row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from centrova.llm import textbytes as tb
from centrova.llm.frames import saved

WIDTH, SHINGLE, BLOCK = 10, 3, 1_000_000


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """size, words (their hashes), items (sorted, as strings): the distinct windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tb.slices(batch.column(1)):
                w = tb.words(data, offs, tb.ALNUM, tb.FOLDED)
                n = np.diff(w.first)
                at = np.flatnonzero((w.stop > w.start) & (np.arange(len(w)) + width <= w.first[w.doc + 1]))
                short = np.flatnonzero((n > 0) & (n < width))
                starts = np.concatenate([at, w.first[short]])
                size = np.concatenate([np.full(len(at), width), n[short]])
                owner = np.concatenate([w.doc[at], short])
                h = tb.signed(w.hash)
                lists = [h[s : s + k].tolist() for s, k in zip(starts, size, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(owner)), pa.array(lists, pa.list_(pa.int64()))], ["item", "words"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item string, words array<long>").groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _shingles_of(words: np.ndarray, size: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(place, rows, hash) of the k-word shingles of windows whose shingles have k words."""
    out = []
    for at in range(words.shape[1] - k + 1):
        rows = np.flatnonzero(size >= at + k)
        if len(rows):
            h = np.full(len(rows), np.uint64(k), np.uint64)
            for j in range(k):
                h = tb.mix(h * np.uint64(0xD6E8FEB86659FD93) + words[rows, at + j])
            out.append((at, rows, h))
    return out


def _shingle_counts(docs: DataFrame, wanted: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each wanted shingle occurs in all documents; a row per partition and block of shingles is summed."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(len(v), np.int64) for k, v in sent.value.items()}
        lookups = {k: _Lookup(v) for k, v in sent.value.items()}
        for batch in batches:
            for _, _, data, offs in tb.slices(batch.column(0)):
                w = tb.words(data, offs, tb.ALNUM, tb.FOLDED)
                for k, own in lookups.items():
                    _, h = tb.ngrams(w, k)
                    at = own.find(h)
                    total[k] += np.bincount(at[at >= 0], minlength=len(own.keys))
        for k, v in total.items():
            seen = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), k, np.int32)), pa.array(seen), pa.array(v[seen])], ["k", "i", "n"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "k int, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n"))
    out = {k: np.zeros(len(v), np.int64) for k, v in wanted.items()}
    for r in counts.toLocalIterator():  # no more rows than wanted
        out[r["k"]][r["i"]] = r["n"]
    return out


class _Lookup:
    """Places of hashes in sorted keys; a bit table passes over nearly all absent hashes first."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(16, int(np.ceil(np.log2(max(len(keys), 1)))) + 5)
        self.may = np.zeros(1 << self.bits, bool)
        self.may[keys >> np.uint64(64 - self.bits)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash in the keys, or -1."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.keys) or not len(h):
            return out
        at = np.flatnonzero(self.may[h >> np.uint64(64 - self.bits)])
        j = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[j] == h[at]
        out[at[ok]] = j[ok]
        return out


def _prefixes(docs: DataFrame, words: np.ndarray, size: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rarest shingle of each window (ties: first place): hash, place, words."""
    kinds = np.minimum(size, shingle)
    places: dict[int, list] = {}
    for k in range(1, shingle + 1):
        rows = np.flatnonzero(kinds == k)
        places[k] = [(at, rows[r], h) for at, r, h in _shingles_of(words[rows], size[rows], k)] if len(rows) else []
    wanted = {k: np.unique(np.concatenate([h for _, _, h in p])) for k, p in places.items() if p}
    counts = _shingle_counts(docs, wanted)
    best = np.full(len(size), np.iinfo(np.int64).max)
    rare, rare_at = np.zeros(len(size), np.uint64), np.zeros(len(size), np.int64)
    for k, p in places.items():
        for at, rows, h in p:
            n = counts[k][np.searchsorted(wanted[k], h)]
            less = n < best[rows]
            best[rows[less]], rare[rows[less]], rare_at[rows[less]] = n[less], h[less], at
    return rare, rare_at, kinds


def _block_hits(docs: DataFrame, block: list, width: int, shingle: int, carry: list[str]) -> DataFrame:
    """The carried columns, __n_words, __edges of the runs of hit words, and __items found, for the windows of one block."""
    size = np.array([len(r["words"]) for r in block], np.int64)
    words = np.zeros((len(block), width), np.uint64)
    for i, r in enumerate(block):
        words[i, : size[i]] = np.array(r["words"], np.int64).view(np.uint64)
    rare, rare_at, kinds = _prefixes(docs, words, size, shingle)
    probe = {}
    for k in np.unique(kinds):
        rows = np.flatnonzero(kinds == k)
        rows = rows[np.argsort(rare[rows], kind="stable")]
        keys, first = np.unique(rare[rows], return_index=True)
        probe[int(k)] = keys, np.append(first, len(rows)), rows
    items = [r["items"] for r in block]
    sent = docs.sparkSession.sparkContext.broadcast((size, words, rare_at, probe, items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, words, rare_at, probe, items = sent.value
        lookups = {k: _Lookup(keys) for k, (keys, _, _) in probe.items()}
        for batch in batches:
            for lo, hi, data, offs in tb.slices(batch.column(0)):
                w = tb.words(data, offs, tb.ALNUM, tb.FOLDED)
                starts, wins = [], []
                for k, (_, first, rows) in probe.items():
                    at, h = tb.ngrams(w, k)
                    j = lookups[k].find(h)
                    hit = np.flatnonzero(j >= 0)
                    j, at = j[hit], at[hit]
                    many = first[j + 1] - first[j]
                    flat = np.repeat(first[j] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                    win = rows[flat]
                    start = np.repeat(at, many) - rare_at[win]
                    own = w.doc[np.repeat(at, many)]
                    ok = (start >= w.first[own]) & (start + size[win] <= w.first[own + 1])
                    start, win = start[ok], win[ok]
                    same = np.ones(len(win), bool)
                    for c in range(words.shape[1]):
                        inside = np.flatnonzero(same & (c < size[win]))
                        same[inside] = w.hash[start[inside] + c] == words[win[inside], c]
                    starts.append(start[same])
                    wins.append(win[same])
                start, win = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, wins))
                doc = w.doc[start]
                order = np.lexsort((start, doc))
                start, win, doc = start[order], win[order], doc[order]
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                found, hits = [], []
                for r in range(hi - lo):
                    a, b = cut[r], cut[r + 1]
                    found.append(sorted({i for x in np.unique(win[a:b]) for i in items[x]}) if b > a else [])
                    if b > a:
                        base = w.first[r]
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], tb.covered(start[a:b] - base, size[win[a:b]], w.first[r + 1] - base).view(np.int8), [0]])))
                        hits.append(edges.tolist())
                    else:
                        hits.append([])
                own = batch.slice(lo, hi - lo).columns[1:]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(w.first).astype(np.int64)), pa.array(hits, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))], [*carry, "__n_words", "__edges", "__items"])

    schema = StructType([docs.schema[c] for c in carry]).add("__n_words", "long").add("__edges", ArrayType(LongType())).add("__items", ArrayType(StringType()))
    return docs.select(F.col("text").cast("string").alias("__text"), *carry).mapInArrow(run, schema)


def _found(docs: DataFrame, benchmark: DataFrame, carry: list[str], width: int, shingle: int, block: int) -> DataFrame:
    """The carried columns, __n_words, __edges, __items of every document.

    With one block of windows, which is the case up to ``block`` distinct windows, this is one pass after the counts.  Further
    blocks are passes of their own; their results meet by row in a shuffle.
    """
    windows = saved(benchmark_windows(benchmark, width))
    total = windows.agg(F.sum(F.greatest(F.lit(1), F.size("items"))).alias("n")).first()["n"] or 0
    if total <= block:
        return _block_hits(docs, windows.collect(), width, shingle, carry)
    n = -(-total * 9 // (block * 8))  # by hash, so that a block is nearly full and seldom above the limit
    keyed = saved(docs.withColumn("__row", F.monotonically_increasing_id()))
    parts = []
    for i in range(n):
        rows = windows.filter(F.pmod(F.xxhash64("words"), F.lit(n)) == i).collect()
        if rows:
            parts.append(_block_hits(keyed, rows, width, shingle, ["__row"]))
    found = reduce(DataFrame.unionByName, parts).groupBy("__row").agg(
        F.max("__n_words").alias("__n_words"), F.collect_list("__edges").alias("__all"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"))

    def join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n_words, lists in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                e = np.array([x for one in lists for x in one], np.int64).reshape(-1, 2)
                hit = tb.covered(e[:, 0], e[:, 1] - e[:, 0], n_words)
                out.append(np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64())), b.column(3)], ["__row", "__n_words", "__edges", "__items"])

    found = found.mapInArrow(join_edges, "__row long, __n_words long, __edges array<long>, __items array<string>")
    return keyed.select("__row", *carry).join(found, "__row").drop("__row")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items (sorted item ids as strings), edges of the runs of hit words."""
    f = _found(docs.select("doc_id", "text"), benchmark, ["doc_id"], width, shingle, block)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign"))
    hit = F.aggregate("__edges", start, lambda a, e: F.struct((a["n"] + a["sign"] * e).alias("n"), (-a["sign"]).alias("sign")), lambda a: a["n"])
    return f.select("doc_id", F.col("__n_words").alias("n_words"), hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.col("__items").alias("items"), F.col("__edges").alias("edges"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """The rows of docs in which no window occurs, with all their columns (whose names must not begin with two underscores)."""
    return _found(docs, benchmark, docs.columns, width, shingle, block).filter(F.size("__edges") == 0).select(*docs.columns)


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    c = contamination(docs, benchmark)
    return c.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
