"""Quality rules with cross-document line frequency.

Lines are normalised (words by ASCII white space, A-Z lower-cased, joined by one space) and hashed.  Per host the number of
distinct documents that hold a line is counted; documents of equal text count as one, so copies of a sound text do not condemn it.
A line above ``max(line_floor, line_share * distinct documents of the host)`` is boilerplate; its words are removed, and a document
that keeps less than ``min_left`` of its words is depleted and rejected, as is one that fails the base rules.

Defined results: null text has no words (base fails); a null host is a host of its own; repeated rows each give a row; an empty
table gives an empty result; only doc_id, text and the host column are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from centrova.llm import textbytes as tb
from centrova.llm.frames import saved

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = 1
_CODE_POINT = np.ones(256, bool)
_CODE_POINT[0x80:0xC0] = False
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False
#: Frequent lines that are broadcast; more are joined by a shuffle.
BROADCAST_LINES = 200_000
#: Bytes of a slice: several arrays of eight bytes a byte live at once in each of an executor's workers.
SLICE_BYTES = 1 << 18


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_pct: int = 50
    line_floor: int = 20
    line_share: float = 0.05
    min_left_pct: int = 50


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """batch and a slice of its texts, for each.  What Arrow has kept of earlier batches, and a reused worker of earlier tasks, goes back first."""
    for batch in batches:
        pa.default_memory_pool().release_unused()
        for lo, hi, data, offs in tb.slices(batch.column(column), SLICE_BYTES):
            yield batch, lo, hi, data, offs


def _lines(data: np.ndarray, offs: np.ndarray, w: tb.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines that hold a word: row, first word, end word, hash of the line's own bytes."""
    start, stop = tb.spans(data, offs, _NOT_NEWLINE)
    a, b = np.searchsorted(w.start, start), np.searchsorted(w.start, stop)
    full = np.flatnonzero(b > a)
    start, stop, a, b = start[full], stop[full], a[full], b[full]
    row = w.doc[a] if len(a) else np.zeros(0, np.int64)
    return row, a, b, tb.span_hash(tb.prefix(data, tb.RAW), start, stop)


def _line_keys(folded: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequence of words [a, b)."""
    _, inv = tb.powers(len(folded) + 1)
    sums = np.zeros(len(folded) + 1, np.uint64)
    np.cumsum(folded * tb.powers(len(folded) + 1)[0][: len(folded)], out=sums[1:])
    return tb.mix((sums[b] - sums[a]) * inv[a] + (b - a).astype(np.uint64))


def _same_row_key(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    return tb.mix(h ^ tb.mix(row.astype(np.uint64) + np.uint64(1)))


def _base(data: np.ndarray, offs: np.ndarray) -> tuple[dict[str, np.ndarray], tuple]:
    """The base figures of each row, and what the line keys need."""
    n = len(offs) - 1
    w = tb.words(data, offs)
    inside = np.zeros(len(data) + 1, np.int64)
    np.cumsum(tb.NOT_SPACE[data] & _CODE_POINT[data], out=inside[1:])
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])
    row, a, b, raw = _lines(data, offs, w)
    distinct = np.unique(_same_row_key(raw, row), return_index=True)[1]
    at, h = tb.ngrams(w, 3)
    key = _same_row_key(h, w.doc[at])
    order = np.argsort(key)
    k = key[order]
    twin = np.zeros(len(k), bool)
    if len(k) > 1:
        same = k[1:] == k[:-1]
        twin[1:] |= same
        twin[:-1] |= same
    hit = tb.covered(at[order[twin]], 3, len(w)) if len(w) else np.zeros(0, bool)
    return {
        "n_words": np.diff(w.first).astype(np.int64),
        "word_chars": np.diff(inside[offs]),
        "n_symbols": np.diff(symbols[offs]),
        "n_dup_lines": tb.by_row(row, n) - tb.by_row(row[distinct], n),
        "n_repeat_words": tb.by_row(w.doc[hit], n),
    }, (row, a, b, w)


def _keyed_lines(docs: DataFrame, host: str) -> DataFrame:
    """host, content (hash of the whole text), line, words: a row per distinct line of a document; line null: the document itself.

    words is the number of words that all occurrences of the line hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, data, offs in _slices(batches, 0):
            w = tb.words(data, offs)
            row, a, b, _ = _lines(data, offs, w)
            folded = tb.span_hash(tb.prefix(data, tb.FOLDED), w.start, w.stop)
            key = _line_keys(folded, a, b)
            whole = tb.span_hash(tb.prefix(data, tb.RAW), offs[:-1], offs[1:])
            _, at, back = np.unique(_same_row_key(key, row), return_index=True, return_inverse=True)
            held = np.bincount(back, (b - a), minlength=len(at)).astype(np.int64)
            owner = np.concatenate([np.arange(hi - lo), row[at]])
            lines = pa.array(np.concatenate([np.zeros(hi - lo, np.int64), tb.signed(key[at])]), mask=np.arange(len(owner)) < hi - lo)
            hosts = batch.column(1).slice(lo, hi - lo).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([hosts, pa.array(tb.signed(whole)[owner]), lines, pa.array(np.concatenate([np.diff(w.first), held]))], ["host", "content", "line", "words"])

    return docs.select(F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("host")).mapInArrow(run, "host string, content long, line long, words long")


def frequent_lines(docs: DataFrame, rules: QualityRules, host: str = "source") -> DataFrame:
    """host, line: the hashes of the lines above the limit of their host."""
    seen = _keyed_lines(docs, host).groupBy("host", "line", "content").agg(F.lit(1).alias("one"))
    counts = seen.groupBy("host", "line").agg(F.count("*").alias("n_docs")).filter(F.col("line").isNull() | (F.col("n_docs") > rules.line_floor))
    counts = saved(counts)
    sizes = counts.filter(F.col("line").isNull()).select(F.col("host").alias("h"), F.col("n_docs").alias("host_docs"))
    lines = counts.filter(F.col("line").isNotNull())
    return lines.join(sizes, F.col("host").eqNullSafe(F.col("h"))).filter(F.col("n_docs") > F.col("host_docs") * rules.line_share).select("host", "line")


_FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words")


def verdicts(docs: DataFrame, rules: QualityRules = QualityRules(), host: str = "source") -> DataFrame:
    """A row per document: doc_id, the base figures, n_removed_words, base_failed, kept."""
    out = _judged(docs.select("doc_id", "text", F.col(host).alias("source")), ["doc_id"], rules, "source")
    return out.select("doc_id", *[F.col(f"__{c}").alias(c) for c in (*_FIGURES, "base_failed", "kept")])


def kept_documents(docs: DataFrame, rules: QualityRules = QualityRules(), host: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns (whose names must not begin with two underscores)."""
    return _judged(docs, docs.columns, rules, host).filter("__kept").select(*docs.columns)


def _judged(docs: DataFrame, carry: list[str], rules: QualityRules, host: str) -> DataFrame:
    """The carried columns, the figures, base_failed and kept, each of these with two underscores before its name."""
    frequent = saved(frequent_lines(docs, rules, host))
    few = frequent.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    figures = _figures_by_broadcast(docs, carry, frequent, host) if few else _figures_by_join(docs, carry, frequent, host)
    failed = (F.col("__n_words") < rules.min_words) | (100 * F.col("__n_repeat_words") > rules.max_repeat_pct * F.col("__n_words"))
    left = 100 * (F.col("__n_words") - F.col("__n_removed_words")) >= rules.min_left_pct * F.col("__n_words")
    return figures.withColumn("__base_failed", failed).withColumn("__kept", ~failed & left)


def _scanned(docs: DataFrame, carry: list[str], host: str, figures_of, more: dict[str, str]) -> DataFrame:
    """The carried columns and what figures_of(data, offs, hosts) gives for each slice, under names with two underscores.

    Text and host go to the workers once, whether or not they are carried: batches of whole texts are what fills their memory.
    """
    names = [*carry, *(f"__{c}" for c in more)]
    sent = [F.col(c) for c in carry]

    def place(column: str, alias: str) -> int:
        """Where column is among those sent, as a string."""
        if column in carry and docs.schema[column].dataType == StringType():
            return carry.index(column)
        sent.append(F.col(column).cast("string").alias(alias))
        return len(sent) - 1

    text_at, host_at = place("text", "__text"), place(host, "__host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, data, offs in _slices(batches, text_at):
            part = batch.slice(lo, hi - lo)
            found = figures_of(data, offs, part.column(host_at))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], *(found[c] for c in more)], names)

    schema = StructType([docs.schema[c] for c in carry])
    for c, kind in more.items():
        schema = schema.add(f"__{c}", kind)
    return docs.select(*sent).mapInArrow(run, schema)


def _figures_by_broadcast(docs: DataFrame, carry: list[str], frequent: DataFrame, host: str) -> DataFrame:
    """One pass; the frequent lines, no more than BROADCAST_LINES, go to every worker."""
    by_host: dict[str | None, list[int]] = {}
    for r in frequent.collect():
        by_host.setdefault(r["host"], []).append(r["line"])
    sent = docs.sparkSession.sparkContext.broadcast({k: np.sort(np.array(v, np.int64)) for k, v in by_host.items()})

    def figures_of(data: np.ndarray, offs: np.ndarray, hosts: pa.Array) -> dict:
        figures, (row, a, b, w) = _base(data, offs)
        removed = np.zeros(len(offs) - 1, np.int64)
        if sent.value and len(a):
            key = tb.signed(_line_keys(tb.span_hash(tb.prefix(data, tb.FOLDED), w.start, w.stop), a, b))
            coded = hosts.dictionary_encode()
            code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)[row]
            drop = np.zeros(len(a), bool)
            for i, name in [(-1, None), *enumerate(coded.dictionary.to_pylist())]:
                if (lines := sent.value.get(name)) is not None and len(own := np.flatnonzero(code == i)):
                    j = np.minimum(np.searchsorted(lines, key[own]), len(lines) - 1)
                    drop[own] = lines[j] == key[own]
            removed = tb.by_row(row[drop], len(offs) - 1, (b - a)[drop])
        return {c: pa.array(v) for c, v in figures.items()} | {"n_removed_words": pa.array(removed)}

    return _scanned(docs, carry, host, figures_of, dict.fromkeys(_FIGURES, "long"))


def _figures_by_join(docs: DataFrame, carry: list[str], frequent: DataFrame, host: str) -> DataFrame:
    """For more frequent lines than may be broadcast: the words they remove are summed per content by a shuffled join."""
    f = frequent.select(F.col("host").alias("h"), F.col("line").alias("l"))
    lines = _keyed_lines(docs, host).filter(F.col("line").isNotNull()).distinct()
    removed = lines.join(f, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l"))).groupBy("host", "content").agg(F.sum("words").alias("__n_removed_words"))

    def figures_of(data: np.ndarray, offs: np.ndarray, hosts: pa.Array) -> dict:
        figures, _ = _base(data, offs)
        whole = tb.span_hash(tb.prefix(data, tb.RAW), offs[:-1], offs[1:])
        return {c: pa.array(v) for c, v in figures.items()} | {"host": hosts, "content": pa.array(tb.signed(whole))}

    own = _scanned(docs, carry, host, figures_of, dict.fromkeys(_FIGURES[:-1], "long") | {"host": "string", "content": "long"})
    removed = removed.select(F.col("host").alias("__h"), F.col("content").alias("__c"), "__n_removed_words")
    out = own.join(removed, F.col("__host").eqNullSafe(F.col("__h")) & (F.col("__content") == F.col("__c")), "left")
    return out.fillna(0, ["__n_removed_words"]).select(*carry, *[f"__{c}" for c in _FIGURES])
