"""Quality classifier from weak labels.

Ten heuristic labellers vote sound (+1), unsound (-1) or nothing (0) on every text.  Expectation-maximisation over the counts of
vote patterns (at most 3**10, counted over all texts) estimates, without any given label, the share of unsound texts and how often
each labeller is right on sound and on unsound ones; whether it votes at all says nothing about the class.  Labellers that err
together are found by the correlation of what their votes leave unexplained, and share their weight.  The posterior of a pattern
is the probability that its texts are sound.  On a bounded sample of different texts the posteriors train a logistic scorer over
hashed shapes of words, which then scores every text.

Defined results: null or empty text gets the votes of no words and the score of no features; repeated rows each give a row and are
one text of the sample; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centrova.llm import textbytes as tb

#: Texts that the scorer is fitted on, about (by hash of doc_id and text).
SAMPLE_ROWS = 20_000
BITS = 16
LABELLERS = ("length", "symbols", "stutter", "capitals", "stops", "repeats", "word_size", "short_words", "letters", "sign_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>~^=+{}[]@_\\", np.uint8)] = True
_UPPER, _LOWER, _STOP = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _LOWER[97:123] = True
_STOP[np.frombuffer(b".?!", np.uint8)] = True


def _per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offs]).astype(float)


def votes(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(rows, labellers) of -1, 0, +1."""
    n_rows = len(offs) - 1
    w = tb.words(data, offs)
    alnum = tb.words(data, offs, tb.ALNUM)
    n = np.diff(w.first).astype(float)
    safe = np.maximum(n, 1)
    upper, lower = _per_row(_UPPER[data], offs), _per_row(_LOWER[data], offs)
    again = np.zeros(len(w), bool)
    if len(w) > 1:
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    stutter = np.bincount(w.doc[again], minlength=n_rows) / safe
    at, h = tb.ngrams(w, 3)
    key = tb.mix(h ^ tb.mix(w.doc[at].astype(np.uint64) + np.uint64(1)))
    first = np.unique(key, return_index=True)[1]
    grams = np.bincount(w.doc[at], minlength=n_rows).astype(float)
    repeats = 1 - np.bincount(w.doc[at[first]], minlength=n_rows) / np.maximum(grams, 1)
    size = alnum.stop - alnum.start
    n_alnum = np.maximum(np.diff(alnum.first), 1)
    mean = np.bincount(alnum.doc, size, minlength=n_rows) / n_alnum
    short = np.bincount(alnum.doc[size <= 3], minlength=n_rows) / n_alnum
    symbols = _per_row(_SYMBOL[data], offs) / safe
    stops = _per_row(_STOP[data], offs) / safe
    capitals = upper / np.maximum(upper + lower, 1)

    filled = _per_row(tb.NOT_SPACE[data], offs)
    letters = _per_row(tb.ALNUM[data], offs) / np.maximum(filled, 1)
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=sums[1:])
    signs = np.bincount(w.doc[sums[w.stop] > sums[w.start]], minlength=n_rows) / safe

    def vote(good, bad):
        return np.where(bad, -1, np.where(good, 1, 0))

    enough = n >= 8
    return np.stack([
        vote(n >= 30, n == 0),
        vote(symbols < 0.05, symbols > 0.4),
        vote(enough & (stutter < 0.05), enough & (stutter > 0.3)),
        vote(capitals < 0.3, (upper + lower > 20) & (capitals > 0.7)),
        vote(enough & (stops > 0.01) & (stops < 0.5), enough & (stops > 0.9)),
        vote(enough & (repeats < 0.2), enough & (repeats > 0.6)),
        vote((mean >= 2.5) & (mean <= 9.5), (n > 0) & ((mean < 1.5) | (mean > 15)) | (n == 0)),
        vote(enough & (short >= 0.12), (n >= 20) & (short < 0.04)),
        vote(letters > 0.85, (letters < 0.75) & (n > 0)),
        vote(enough & (signs < 0.02), enough & (signs > 0.2)),
    ], axis=1).astype(np.int64)


_BASE = 3 ** np.arange(len(LABELLERS))


def patterns(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return (votes(data, offs) + 1) @ _BASE


def count_patterns(docs: DataFrame) -> np.ndarray:
    """How many texts have each vote pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(3 ** len(LABELLERS), np.int64)
            for _, _, data, offs in tb.slices(batch.column(0)):
                total += np.bincount(patterns(data, offs), minlength=len(total))
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["pattern", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(3 ** len(LABELLERS), np.int64)
    for r in found:  # at most 3**10 rows
        out[r["pattern"]] = r["n"]
    return out


@dataclass
class LabelModel:
    """What expectation-maximisation says of the classes (0 sound, 1 unsound) and the labellers."""

    #: Posterior probability of sound by vote pattern.
    posterior: np.ndarray
    #: Shares of the classes; P(alarm | class, vote cast) as (class, labeller).
    share: np.ndarray
    alarms: np.ndarray
    #: Shares of texts that a labeller does not vote on, and the weight left to its votes beside those that err with it.
    abstains: np.ndarray
    weights: np.ndarray

    def report(self) -> list[dict]:
        """A row per labeller: accuracy on sound and on unsound texts, overall, how often it abstains, and its weight."""
        rows = []
        for j, name in enumerate(LABELLERS):
            sound, unsound = 1 - self.alarms[0, j], self.alarms[1, j]
            rows.append({"labeller": name, "on_sound": sound, "on_unsound": unsound, "accuracy": self.share[0] * sound + self.share[1] * unsound, "abstains": self.abstains[j], "weight": self.weights[j]})
        return rows


def expectation_maximisation(counts: np.ndarray, rounds: int = 500, clear: float = 1e-3, false_alarms: float = 0.02) -> LabelModel:
    """The model of counts of vote patterns.

    It begins with few alarms on sound texts and some of each labeller on unsound ones.  What is known of the heuristics is that they
    seldom alarm without cause: on sound texts no rate of alarms is taken to be above ``false_alarms``, so that kinds of unsound
    texts that alarm different labellers are one class.  No rate is taken to be nearer to 0 or 1 than ``clear``.
    """
    k = len(LABELLERS)
    vote = (np.arange(len(counts))[:, None] // _BASE) % 3
    seen = np.flatnonzero(counts)
    alarm, calm, n = (vote == 0).astype(float), (vote == 2).astype(float), counts[seen].astype(float)
    p, share = np.stack([np.full(k, 0.02), np.full(k, 0.3)]), np.array([0.8, 0.2])

    def posterior(rows, weights) -> np.ndarray:
        log = np.log(share) + (alarm[rows] * weights) @ np.log(p).T + (calm[rows] * weights) @ np.log(1 - p).T
        q = np.exp(log - log.max(axis=1, keepdims=True))
        return q / q.sum(axis=1, keepdims=True)

    alike = np.ones(k)
    for _ in range(rounds if len(seen) else 0):
        q = posterior(seen, alike) * n[:, None]
        alarms, calms = q.T @ alarm[seen], q.T @ calm[seen]
        new_p = np.clip((alarms + 0.1) / (alarms + calms + 1.0), clear, 1 - clear)
        new_p[0] = np.minimum(new_p[0], false_alarms)
        new = (q.sum(axis=0) + 0.1) / (n.sum() + 0.2)
        still = np.abs(new - share).max() < 1e-9 and np.abs(new_p - p).max() < 1e-6
        share, p = new, new_p
        if still:
            break
    weights, cast = np.ones(k), alarm[seen] + calm[seen]
    if len(seen):
        q, together = posterior(seen, alike) * n[:, None], np.zeros((k, k))
        for c in (0, 1):
            left = alarm[seen] - p[c] * cast
            together += (left * q[:, c, None]).T @ left
        size = np.sqrt(np.diag(together) + 0.005 * n.sum())  # labellers with little left unexplained are not tied together
        r = np.clip(together / size[:, None] / size[None], 0, 1)
        np.fill_diagonal(r, 1.0)
        weights = 1 / r.sum(axis=1)
    abstains = 1 - (n @ cast) / max(n.sum(), 1.0) if len(seen) else np.ones(k)
    return LabelModel(posterior(slice(None), weights)[:, 0], share, p, abstains, weights)


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58] = 65, 97, 48
_SHAPE[128:] = 97
_SHAPE_TABLE = tb.RAW[_SHAPE]


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value): hashed shapes of words, ends of words, word sizes, and whether a word repeats the one before, as shares."""
    w = tb.words(data, offs)
    n = np.maximum(np.diff(w.first), 1).astype(float)
    size = np.minimum(w.stop - w.start, 24)
    first, last = _SHAPE[data[w.start]].astype(np.uint64), _SHAPE[data[w.stop - 1]].astype(np.uint64)
    sums = tb.prefix(data, _SHAPE_TABLE)
    head = tb.span_hash(sums, w.start, np.minimum(w.start + 2, w.stop))
    tail = tb.span_hash(sums, np.maximum(w.stop - 3, w.start), w.stop)
    again = np.zeros(len(w), np.uint64)
    if len(w) > 1:
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    shift = np.uint64(64 - BITS)
    kinds = [tb.mix(size.astype(np.uint64) + np.uint64(1000)), tb.mix(first * np.uint64(256) + last + np.uint64(70_000)), head ^ np.uint64(0x5555), tail, tb.mix(again + np.uint64(900_000))]
    key = np.concatenate([(w.doc.astype(np.int64) << BITS) | (h >> shift).astype(np.int64) for h in kinds])
    key, count = np.unique(key, return_counts=True)
    row = key >> BITS
    return row, key & ((1 << BITS) - 1), count / n[row]


def fit(row: np.ndarray, f: np.ndarray, x: np.ndarray, y: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, both kinds weighing alike."""
    n = len(y)
    if n == 0:
        return np.zeros(1 << BITS), 0.0
    weight = np.where(y >= 0.5, 0.5 / max((y >= 0.5).sum(), 1), 0.5 / max((y < 0.5).sum(), 1))
    used, c = np.unique(f, return_inverse=True)
    w, b, gw, gb = np.zeros(len(used)), 0.0, np.full(len(used), 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[c] * x, minlength=n), -30, 30)))
        e = (p - y) * weight
        g = np.bincount(c, e[row] * x, minlength=len(used)) + 1e-6 * w
        gw += g * g
        gb += e.sum() ** 2
        w -= 0.5 * g / np.sqrt(gw)
        b -= 0.2 * e.sum() / math.sqrt(gb)
    out = np.zeros(1 << BITS)
    out[used] = w
    return out, float(b)


def _sample(docs: DataFrame, total: int, rows: int) -> tuple[np.ndarray, ...]:
    part = min(1.0, rows / max(total, 1))
    pick = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(part * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tb.slices(batch.column(0)):
                row, f, x = features(data, offs)
                first = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(v)) for v in (f.astype(np.int32), x.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([pa.array(patterns(data, offs).astype(np.int32)), *lists], ["pattern", "f", "x"])

    picked = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(pick)
    # Repeated rows are one text of the sample, so what reaches the driver is bounded however often a row is repeated.
    found = picked.groupBy(F.xxhash64("doc_id", "text")).agg(F.first("text").alias("text")).select("text").mapInArrow(run, "pattern int, f array<int>, x array<float>").toArrow()
    lists = [pa.concat_arrays(found.column(c).chunks) if found.column(c).num_chunks else pa.array([], pa.list_(pa.int32())) for c in ("f", "x")]
    size = lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(lists[0]) else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(size)), size), lists[0].flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists[1].flatten().to_numpy(zero_copy_only=False).astype(float), found.column("pattern").to_numpy().astype(np.int64)


def classify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, posterior (of the text's votes), score (of the scorer), predicted (1: sound), kept (predicted is 1)."""
    counts = count_patterns(docs)
    posterior = expectation_maximisation(counts).posterior
    row, f, x, pattern = _sample(docs, int(counts.sum()), sample_rows)
    weights, bias = fit(row, f, x, posterior[pattern])
    sent = docs.sparkSession.sparkContext.broadcast((posterior, weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior, weights, bias = sent.value
        for batch in batches:
            for lo, hi, data, offs in tb.slices(batch.column(1)):
                row, f, x = features(data, offs)
                z = bias + np.bincount(row, weights[f] * x, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(posterior[patterns(data, offs)]), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], ["doc_id", "posterior", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, posterior double, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("kept", F.col("score") >= 0.5)
