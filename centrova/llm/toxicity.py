"""Toxicity by noisy-channel deobfuscation and a linear score of the restored text.

*Language model.*  Character 4-grams of the words of every text are counted in every task and summed; tokens that look disguised are
left out.  32 symbols (word end, 26 letters, four classes of further letters, digits) bound the table by 32**4 entries, whatever
the corpus.

*Channel.*  A token is suspicious if it mixes letters with leet signs or repeats a letter three times or more; so is a run of
single characters between spaces or other separators.  Each character of it becomes a column of a lattice: the letters that the
sign may stand for, the sign itself, or nothing where it repeats the one before; a separator stands for nothing or for the end of
a word.  Viterbi decoding under the model gives the restored words; all other tokens are only lower-cased.

*Score.*  Words, and prefixes of four to seven bytes, of the restored text are hashed; of the features present in a bounded sample
of labelled rows those associated with the label are kept and weighed by logistic regression.  Labels are learned from rows whose
crc32(doc_id as text) mod 5 is not 0; labels, lang, source and doc_id are never inputs of a score.

Defined results: null or empty text has the score of no features; a null doc_id counts as held out; repeated rows each give a row;
without labels of both kinds every score is the smoothed share of label 1; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centrova.llm import textbytes as tb

#: Labelled rows that the weights are fitted on, at most (by hash of doc_id).
SAMPLE_ROWS = 20_000
FOLDS, BITS = 5, 20

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27 + (np.arange(128, 256) & 3)
_SYMBOL[48:58] = 31
N_SYMBOLS = 32
_LETTER = (_SYMBOL > 0) & (_SYMBOL < 31)
#: Bytes that tell a disguised word where they stand in one token with letters.
_ODD = np.zeros(256, bool)
_ODD[list(b"0123456789@$|+*#")] = True

#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "h", "€": "e", "£": "l"}
_SIGN = math.log(0.02)
_KEPT = math.log(0.9)
_DROPPED = math.log(0.3)
#: A separator between single characters stands for nothing, or ends a word.
_JOINED = _PARTED = math.log(0.5)


def _word_stream(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The symbols of the words (runs of letters) of tokens that do not look disguised, three word ends before each word and after the last."""
    token, stop = tb.spans(data, offs, tb.NOT_SPACE)
    signs = _ODD[data]
    signs[1:-1] |= (data[1:-1] == data[:-2]) & (data[1:-1] == data[2:]) & _LETTER[data[1:-1]]
    sums = np.concatenate([[0], np.cumsum(signs)])
    odd = sums[stop] > sums[token]
    inside = np.cumsum(np.bincount(token[odd], minlength=len(data) + 1) - np.bincount(stop[odd], minlength=len(data) + 1))[:-1]
    member = _LETTER[data] & (inside == 0)
    start, stop = tb.spans(np.where(member, data, 32).astype(np.uint8), offs, tb.NOT_SPACE)
    n = stop - start
    at = np.flatnonzero(member)
    out = np.zeros(len(at) + 3 * (len(n) + 1), np.int64)
    out[np.arange(len(at)) + 3 * np.repeat(np.arange(1, len(n) + 1), n)] = _SYMBOL[data[at]]
    return out


def count_grams(docs: DataFrame) -> DataFrame:
    """gram, n: how often each 4-gram of symbols occurs in the words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(N_SYMBOLS**4, np.int64)
            for _, _, data, offs in tb.slices(batch.column(0)):
                s = _word_stream(data, offs)
                total += np.bincount(((s[:-3] * N_SYMBOLS + s[1:-2]) * N_SYMBOLS + s[2:-1]) * N_SYMBOLS + s[3:], minlength=len(total))
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["gram", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(symbol | three before), 32**4 entries as float32.

    Rare contexts are backed up by shorter ones with the weight of the number of symbols seen after them.  A context that begins
    with word ends is the same event as the shorter one, and is not backed up twice.
    """
    found = count_grams(docs).toPandas()  # at most 32**4 rows
    n4 = np.zeros(N_SYMBOLS**4)
    n4[found["gram"].to_numpy(np.int64)] = found["n"].to_numpy()
    n4 = n4.reshape((N_SYMBOLS,) * 4)
    n4[:, :, 0, 0] = 0  # what follows a word end is the next word
    p = (n4.sum(axis=(0, 1, 2)) + 1) / (n4.sum() + N_SYMBOLS)
    for axes in ((0, 1), (0,), ()):
        n = n4.sum(axis=axes)
        kinds = np.maximum((n > 0).sum(axis=-1, keepdims=True), 1)
        shorter = np.broadcast_to(p, n.shape)
        p = (n + kinds * shorter) / (n.sum(axis=-1, keepdims=True) + kinds)
        if n.ndim > 2:
            p[0, 0] = shorter[0, 0]
    return np.log(p).astype(np.float32).ravel()


class Restorer:
    """Restored forms of tokens under a language model; each worker keeps those it has met."""

    KEPT = 1_000_000
    _one = r"[^\W_]|[@$!|+*#€£]"
    _spaced = re.compile(rf"(?<![^\s\"'(\[<])(?:{_one})(?:[ \t](?:{_one})){{2,}}(?![^\s\"')\]>.,;:!?])")
    _separated = re.compile(rf"(?:{_one})(?:[.\-_*~](?:{_one})){{2,}}")
    _letters = re.compile(r"[^\W\d_].*[^\W\d_]", re.S)
    _signs = re.compile(r"(?=.*[^\W\d_])(?=.*[0-9@$!|+(*#€£])")
    _repeats = re.compile(r"([^\W\d_])\1\1")
    _edges = re.compile(r"^[\"'(\[<]*(.*?)[\"')\]>.,;:!?]*$", re.S)

    def __init__(self, model: np.ndarray):
        self.model, self._kept = model, {}

    def text(self, text: str) -> str:
        """The text in lower case with suspicious tokens restored, words parted by one space."""
        kept = self._kept
        if len(kept) > self.KEPT:
            kept.clear()
        out: list[str] = []
        at = 0
        for m in self._spaced.finditer(text):
            self._tokens(text[at : m.start()], out)
            run = kept.get(m[0])
            if run is None:
                run = kept[m[0]] = self.apart(m[0].lower()) if self._letters.search(m[0]) else m[0].lower()
            out.append(run)
            at = m.end()
        self._tokens(text[at:] if at else text, out)
        return " ".join(out)

    def _tokens(self, text: str, out: list[str]) -> None:
        kept = self._kept
        for t in text.split():
            r = kept.get(t)
            if r is None:
                r = kept[t] = self.token(t)
            out.append(r)

    def token(self, token: str) -> str:
        t = token.lower()
        if t.isascii() and t.isalpha() and not self._repeats.search(t):
            return t
        core = self._edges.match(t)[1]
        if self._separated.fullmatch(core) and self._letters.search(core):
            return self.apart(core)
        if not (self._signs.match(core) or self._repeats.search(core)):
            return t
        return self.decode([(c, False) for c in core])

    def apart(self, run: str) -> str:
        """The words of a run of single characters with one separator after each."""
        return self.decode([(c, i % 2 == 1) for i, c in enumerate(run)])

    def decode(self, lattice: list[tuple[str, bool]]) -> str:
        """The likeliest words behind characters (and whether each is a separator): Viterbi over the last three symbols and the letter that a repeat would double."""
        # States: context of three symbols and last letter written -> (score, letters as a linked list).
        states = {(0, ""): (0.0, None)}
        before = ""
        for ch, separator in lattice:
            nxt: dict[tuple[int, str], tuple[float, tuple | None]] = {}
            if separator:
                for (ctx, last), (score, path) in states.items():
                    s = score + _PARTED + float(self.model[ctx * N_SYMBOLS])
                    for key, v, way in (((ctx, last), score + _JOINED, path), ((0, ""), s, (path, " "))):
                        if key not in nxt or nxt[key][0] < v:
                            nxt[key] = v, way
                states = nxt
                continue
            options = [(ch, _KEPT)] + [(x, _SIGN - math.log(len(LEET[ch]))) for x in LEET.get(ch, "")]
            symbols = [(x, int(_SYMBOL[x.encode("utf-8")[-1]]), cost) for x, cost in options]
            for (ctx, last), (score, path) in states.items():
                if ch == before and last:  # a repeat that stands for nothing
                    key, s = (ctx, last), score + _DROPPED
                    if key not in nxt or nxt[key][0] < s:
                        nxt[key] = s, path
                for x, sym, cost in symbols:
                    # a sign that is kept is no word end, and as rare as a digit
                    s = score + cost + float(self.model[ctx * N_SYMBOLS + (sym or N_SYMBOLS - 1)])
                    key = (ctx * N_SYMBOLS + sym) % N_SYMBOLS**3, x
                    if key not in nxt or nxt[key][0] < s:
                        nxt[key] = s, (path, x)
            states, before = nxt, ch
        best = max(((score + float(self.model[ctx * N_SYMBOLS]), path) for (ctx, _), (score, path) in states.items()), key=lambda x: x[0])
        letters, path = [], best[1]
        while path:
            path, x = path
            letters.append(x)
        return "".join(reversed(letters))


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row, feature) of the distinct features of restored texts."""
    shift = np.uint64(64 - BITS)
    for lo, hi, data, offs in tb.slices(texts):
        w = tb.words(data, offs, tb.ALNUM, tb.RAW)
        sums = tb.prefix(data, tb.RAW)
        row, f = [w.doc], [w.hash >> shift]
        for n in (4, 5, 6, 7):
            at = np.flatnonzero(w.stop - w.start > n)
            row.append(w.doc[at])
            f.append(tb.mix(tb.span_hash(sums, w.start[at], w.start[at] + n) + np.uint64(n)) >> shift)
        key = np.unique((np.concatenate(row).astype(np.int64) << BITS) | np.concatenate(f).astype(np.int64))
        yield lo, hi, key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class ToxicityModel:
    language: np.ndarray
    weights: np.ndarray
    bias: float


def _held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def _sample(docs: DataFrame, labels: DataFrame, language: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each feature, feature, label of each row) of at most ``rows`` labelled rows outside the held-out fold."""
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(~_held_out())
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # One text of each labelled doc_id, so that what reaches the driver is bounded however often an id is repeated.
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(marks), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    sent = docs.sparkSession.sparkContext.broadcast(language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = restorer(sent.value)
        for batch in batches:
            texts = pa.array([restore.text(t.as_py() or "") for t in batch.column(0)], pa.string())
            for lo, hi, row, f in features(texts):
                first = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(first), pa.array(f.astype(np.int32)))], ["toxic", "f"])

    found = own.mapInArrow(run, "toxic int, f array<int>").toArrow()
    lists = found.column("f").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), found.column("toxic").to_numpy().astype(float)


def fit(row: np.ndarray, f: np.ndarray, y: np.ndarray, least: int = 4, chi2: float = 20.0, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights of all features, nearly all 0, and the bias."""
    weights, n, pos = np.zeros(1 << BITS), len(y), y.sum()
    prior = (pos + 0.5) / (n + 1.0)
    bias = math.log(prior / (1 - prior))
    if pos == 0 or pos == n:
        return weights, bias
    seen = np.bincount(f, minlength=1 << BITS).astype(float)
    toxic = np.bincount(f, y[row], minlength=1 << BITS)
    expected = seen * pos / n
    with np.errstate(divide="ignore", invalid="ignore"):
        stat = (toxic - expected) ** 2 / (expected * (1 - pos / n) * (1 - seen / n))
    pick = np.flatnonzero((seen >= least) & (np.nan_to_num(stat) >= chi2))
    code = np.full(1 << BITS, -1)
    code[pick] = np.arange(len(pick))
    on = code[f] >= 0
    r, c = row[on], code[f[on]]
    w, b, gw, gb = np.zeros(len(pick)), bias, np.full(len(pick), 1e-6), 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(r, w[c], minlength=n), -30, 30)))
        e = p - y
        g = np.bincount(c, e[r], minlength=len(pick)) / n + 1e-5 * w
        gw += g * g
        gb += e.mean() ** 2
        w -= 0.5 * g / np.sqrt(gw)
        b -= 0.5 * e.mean() / math.sqrt(gb)
    weights[pick] = w
    return weights, float(b)


_restorers: dict[int, Restorer] = {}


def restorer(model: np.ndarray) -> Restorer:
    """One per worker and model."""
    tag = hash(model[:: 4099].tobytes())
    if tag not in _restorers:
        _restorers.clear()
        _restorers[tag] = Restorer(model)
    return _restorers[tag]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    language = language_model(docs)
    return ToxicityModel(language, *fit(*_sample(docs, labels, language, sample_rows)))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every text."""
    pick = np.flatnonzero(model.weights)
    sent = docs.sparkSession.sparkContext.broadcast((model.language, pick, model.weights[pick], model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language, pick, w, bias = sent.value
        restore = restorer(language)
        dense = np.zeros(1 << BITS)
        dense[pick] = w
        for batch in batches:
            texts = pa.array([restore.text(t.as_py() or "") for t in batch.column(1)], pa.string())
            for lo, hi, row, f in features(texts):
                z = bias + np.bincount(row, dense[f], minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
