"""Suffix-array dedup of long repeated substrings, built column by column over many documents.

Every byte covered by a ``length``-byte string that also starts elsewhere, in the same text or another, is removed.

*Dealing out.*  The anchor of a ``length``-byte window is the leftmost least hash among its ``GRAM``-byte grams.  Windows of a text
with one anchor, in two halves by their distance from it, form a segment of a few hundred bytes; what all windows of such a half
share around the anchor, its core, is the key.  Equal windows have equal anchors, so equal keys: repeats never cross keys, and keys
that occur once (nearly all) end here, before any text is moved.

*Construction.*  Equal segments are one string with a multiplicity.  The strings of a key stand at one column, the start of the
core, and ``column_bwt`` inserts one symbol of each per round into the transform and common prefixes of their collection; a window
whose common prefix with a neighbour reaches ``length`` is repeated.  Keys are packed into buckets of bounded bytes.

*Hot keys.*  A passage a little longer than a core in a large part of all documents has a key with as many different strings.  The
segments of keys of more than ``most_strings`` are cut at further columns: windows of a narrower range of distances share more of
their bytes, a longer core, which is the next key.  At a range of one distance the core is the window, so a key holds one string.

Texts go by 128 bits of their hash.  Only texts that hold a wanted string, and in the end those that lose bytes, are moved.

Defined results: null text is empty; texts shorter than ``length`` keep all bytes; repeated rows repeat each other and lose what
they share; an empty table gives an empty result; null doc_ids stay null; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centrova.llm import textbytes as tb
from centrova.llm.column_bwt import repeated_starts
from centrova.llm.frames import bounded_broadcast, narrowed, release, saved

LENGTH, GRAM, MOST_STRINGS, BUCKET_BYTES = 400, 24, 4096, 2 << 20
#: Distances from the core that the pieces of a hot key's segments span, level by level.
FINER = (24, 4, 1)
#: Names of texts (16 bytes each) that are broadcast to pick these texts; more meet the texts in a shuffled join.
BROADCAST_NAMES = 1_000_000
_AT = np.uint64((1 << 21) - 1)
U64 = np.uint64


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """out[i] = min(v[i : i + width])."""
    have, out = 1, v
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _pieces(data: np.ndarray, offs: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, first row, bytes before the piece in its row): slices as they are, and a long text in parts that share length - 1 bytes, each window start in one."""
    limit = tb.SLICE_BYTES
    if len(data) <= limit:
        yield data, offs, 0, 0
        return
    for row in range(len(offs) - 1):
        a, b = int(offs[row]), int(offs[row + 1])
        for at in range(a, max(a + 1, b - length + 1), limit - length + 1):
            stop = min(b, at + limit)
            yield data[at:stop], np.array([0, stop - at]), row, at - a


def segments(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """row, start, size, head, key, string of the segments of texts; start within the row, head from start to the core."""
    parts = []
    for d, o, row0, skipped in _pieces(data, offs, length):
        n = len(d)
        if n < length:
            continue
        sums = tb.prefix(d, tb.RAW)
        at = np.arange(n - gram + 1)
        h = tb.span_hash(sums, at, at + gram)
        width = length - gram + 1
        anchor = (_sliding_min((h & ~_AT) | at.astype(np.uint64), width) & _AT).astype(np.int64)
        last = np.full(n - length + 1, -1, np.int32)  # the row of each window, -1 if it leaves its row
        for r in np.flatnonzero(np.diff(o) >= length):
            last[o[r] : o[r + 1] - length + 1] = r
        a = np.flatnonzero(last >= 0)
        if not len(a):
            continue
        m, row = anchor[a], last[a]
        half = -(-width // 2)
        part = (m - a) // half
        new = np.ones(len(a), bool)
        new[1:] = (m[1:] != m[:-1]) | (part[1:] != part[:-1]) | (row[1:] != row[:-1]) | (a[1:] != a[:-1] + 1)
        first = np.flatnonzero(new)
        lo, hi = a[first], a[np.append(first[1:], len(a)) - 1]
        m, part, row = m[first], part[first], row[first]
        core = m - part * half
        core_end = m - np.minimum((part + 1) * half, width) + 1 + length
        key = tb.mix(tb.span_hash(sums, core, core_end) + part.astype(np.uint64))
        string = tb.mix(tb.span_hash(sums, lo, hi + length) ^ tb.mix((core - lo).astype(np.uint64) + U64(3)))
        parts.append((row + row0, lo - o[row] + skipped, hi - lo + length, core - lo, tb.signed(key), tb.signed(string)))
    names = ("row", "start", "size", "head", "key", "string")
    if not parts:
        return {c: np.zeros(0, np.int64) for c in names}
    return {c: np.concatenate(x).astype(np.int64) for c, x in zip(names, zip(*parts, strict=True), strict=True)}


def _named(docs: DataFrame) -> DataFrame:
    """docs with __text, never null, and its name: two hashes.  What is repeated in a text depends on it alone."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("__text", text).withColumn("__name", F.xxhash64(text)).withColumn("__name2", F.xxhash64(F.lit(1), text))


def _segment_rows(named: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tb.slices(batch.column(0)):
                s = segments(data, offs, length, gram)
                rows = pa.array(s["row"] + lo)
                yield pa.RecordBatch.from_arrays([pa.array(s["key"]), pa.array(s["string"]), batch.column(1).take(rows), batch.column(2).take(rows), pa.array(s["start"]), pa.array(s["size"].astype(np.int32)), pa.array(s["head"].astype(np.int32))], ["key", "string", "name", "name2", "start", "size", "head"])

    schema = "key long, string long, name long, name2 long, start long, size int, head int"
    return named.select("__text", "__name", "__name2").filter(F.octet_length("__text") >= length).mapInArrow(run, schema)


def _of_names(named: DataFrame, names: DataFrame, how: str) -> DataFrame:
    """The rows of named whose text is (``left_semi``), or is not (``left_anti``), among names (name, name2)."""
    keep = bounded_broadcast(names.select(F.col("name").alias("n1"), F.col("name2").alias("n2")), BROADCAST_NAMES)
    return named.join(keep, (F.col("__name") == F.col("n1")) & (F.col("__name2") == F.col("n2")), how)


def _cut(named: DataFrame, wanted: DataFrame, run, schema: str) -> DataFrame:
    """run over (text, list of wanted rows' structs): the texts of the wanted rows only, once each."""
    lists = wanted.groupBy("name", "name2").agg(F.collect_list(F.struct("key", "string", "n", "start", "size", "head")).alias("rows"))
    texts = _of_names(named.select("__text", "__name", "__name2"), saved(narrowed(wanted.select("name", "name2").distinct())), "left_semi")
    texts = texts.dropDuplicates(["__name", "__name2"])
    return texts.join(lists, (F.col("__name") == F.col("name")) & (F.col("__name2") == F.col("name2"))).select("__text", "rows", "name", "name2").mapInArrow(run, schema)


def _flat(rows: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return rows.flatten(), np.repeat(np.arange(len(rows)), rows.value_lengths().to_numpy(zero_copy_only=False))


def _strings(named: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """bucket, key, string, n, head, bytes of the wanted segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, owner = _flat(batch.column(1))
            start, size = flat.field("start").to_numpy(), flat.field("size").to_numpy()
            at, cut = -1, []
            for i in range(len(owner)):
                if owner[i] != at:
                    at = owner[i]
                    text = batch.column(0)[int(at)].as_py().encode("utf-8")
                cut.append(text[start[i] : start[i] + size[i]])
            bucket = (flat.field("key").to_numpy().view(np.uint64) % U64(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), flat.field("key"), flat.field("string"), flat.field("n"), flat.field("head"), pa.array(cut, pa.binary())], ["bucket", "key", "string", "n", "head", "bytes"])

    return _cut(named, wanted, run, "bucket int, key long, string long, n long, head int, bytes binary")


def _edges(flags: np.ndarray) -> np.ndarray:
    """Flat [first, end) pairs of the runs of true flags."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))


def _by_transform(named: DataFrame, wanted: DataFrame, buckets: int, length: int) -> DataFrame:
    """key, string, runs: flat [first, end) pairs of the repeated window starts of each string."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.drop_duplicates(["key", "string"]).sort_values(["key", "string"], ignore_index=True)
        found = repeated_starts(g["bytes"].tolist(), g["head"].to_numpy(np.int64), length)
        many = g["n"].to_numpy() > 1
        for i in np.flatnonzero(many):
            found[i][:] = True
        runs = [_edges(x).tolist() for x in found]
        out = g[["key", "string"]].assign(runs=runs)
        return out[[len(r) > 0 for r in runs]]

    return _strings(named, wanted, buckets).groupBy("bucket").applyInPandas(run, "key long, string long, runs array<long>")


def _finer(named: DataFrame, wanted: DataFrame, width: int, length: int) -> DataFrame:
    """The wanted segments in pieces whose windows span ``width`` distances from the core: parent, p_string, shift (in the parent), and a segment's columns."""

    def pieces(data: np.ndarray, start: int, size: int, head: int) -> list[tuple]:
        own = data[start : start + size]
        sums, n = tb.prefix(own, tb.RAW), size - length + 1
        part = (head - np.arange(n)) // width
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        last = np.append(first[1:], n)  # the end of the piece's windows
        core = head - part[first] * width
        key = tb.mix(tb.span_hash(sums, core, core - width + 1 + length) + (part[first] * 1024 + width).astype(np.uint64))
        string = tb.mix(tb.span_hash(sums, first, last - 1 + length) ^ tb.mix((core - first).astype(np.uint64) + U64(3)))
        return list(zip(first.tolist(), tb.signed(key).tolist(), tb.signed(string).tolist(), (start + first).tolist(), (last - first - 1 + length).tolist(), (core - first).tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, owner = _flat(batch.column(1))
            start, size, head = (flat.field(c).to_numpy() for c in ("start", "size", "head"))
            at, of, rows = -1, [], []
            for i in range(len(owner)):
                if owner[i] != at:
                    at = owner[i]
                    data = np.frombuffer(batch.column(0)[int(at)].as_py().encode("utf-8"), np.uint8)
                found = pieces(data, int(start[i]), int(size[i]), int(head[i]))
                rows += found
                of += [i] * len(found)
            shift, key, string, begin, sizes, heads = zip(*rows, strict=True) if rows else ([],) * 6
            of, owners = pa.array(of, pa.int64()), pa.array(owner[of] if of else [], pa.int64())
            columns = [flat.field("key").take(of), flat.field("string").take(of), pa.array(shift, pa.int64()), pa.array(key, pa.int64()), pa.array(string, pa.int64()), flat.field("n").take(of)]
            columns += [batch.column(2).take(owners), batch.column(3).take(owners), pa.array(begin, pa.int64()), pa.array(sizes, pa.int32()), pa.array(heads, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["parent", "p_string", "shift", "key", "string", "n", "name", "name2", "start", "size", "head"])

    return _cut(named, wanted, run, "parent long, p_string long, shift long, key long, string long, n long, name long, name2 long, start long, size int, head int")


def _found(named: DataFrame, strings: DataFrame, length: int, most_strings: int, widths: tuple[int, ...]) -> DataFrame:
    """key, string, runs of repeated window starts of the strings that have any; keys of too many strings are cut finer first."""
    wide = strings.groupBy("key").agg(F.count("*").alias("wide")).filter(F.col("wide") > most_strings).select("key")
    wide = saved(narrowed(wide)) if widths else wide.limit(0)
    hot = widths and wide.limit(1).count()
    cold = strings.join(wide, "key", "left_anti") if hot else strings
    total = cold.agg(F.sum("size").alias("b")).first()["b"] or 0
    found = _by_transform(named, cold, max(1, -(-total // BUCKET_BYTES)), length)
    if not hot:
        return found
    parts = saved(_finer(named, strings.join(wide, "key"), widths[0], length))
    own = _distinct_strings(parts, F.sum("n"))
    below = _found(named, own, length, most_strings, widths[1:])
    back = parts.join(below, ["key", "string"]).select(F.col("parent").alias("key"), F.col("p_string").alias("string"), F.transform("runs", lambda x: x + F.col("shift")).alias("runs"))
    return found.unionByName(back.groupBy("key", "string").agg(F.flatten(F.collect_list("runs")).alias("runs")))


def _distinct_strings(rows: DataFrame, n) -> DataFrame:
    """key, string, n, and where one of the equal segments stands; saved."""
    one = F.min(F.struct("name", "name2", "start", "size", "head")).alias("one")
    return saved(narrowed(rows.groupBy("key", "string").agg(n.alias("n"), one).select("key", "string", "n", "one.*")))


def repeats(named: DataFrame, length: int = LENGTH, gram: int = GRAM, most_strings: int = MOST_STRINGS) -> DataFrame:
    """name, name2, runs: for each text with repeats, flat [first, end) pairs of its repeated window starts, unmerged; saved."""
    rows = _segment_rows(named, length, gram)
    # Saved, so that the join meets a plain table and Spark can split the rows of a hot key.
    keys = saved(narrowed(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")))
    release(named.sparkSession)
    cand = saved(narrowed(rows.join(keys, "key")))
    release(named.sparkSession)
    found = saved(narrowed(_found(named, _distinct_strings(cand, F.count("*")), length, most_strings, FINER)))
    release(named.sparkSession)
    hits = cand.join(found, ["key", "string"]).select("name", "name2", F.transform("runs", lambda x: x + F.col("start")).alias("runs"))
    return saved(narrowed(hits.groupBy("name", "name2").agg(F.flatten(F.collect_set("runs")).alias("runs"))))


def merged(runs: np.ndarray, length: int) -> np.ndarray:
    """Maximal removed [start, stop) spans of flat [first, end) pairs of window starts."""
    r = runs.reshape(-1, 2)
    r = r[np.argsort(r[:, 0], kind="stable")]
    start, stop = r[:, 0], np.maximum.accumulate(r[:, 1] - 1 + length)
    new = np.ones(len(r), bool)
    new[1:] = start[1:] > stop[:-1]
    return np.stack([start[new], stop[np.append(np.flatnonzero(new)[1:], len(r)) - 1]], axis=1)


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_strings: int = MOST_STRINGS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (flat starts and stops of the removed runs) of every document."""
    named = _named(docs.select("doc_id", "text"))
    found = repeats(named, length, gram, most_strings)
    release(docs.sparkSession)
    names = found.select("name", "name2")
    hit = _of_names(named, names, "left_semi").join(found, (F.col("__name") == F.col("name")) & (F.col("__name2") == F.col("name2"))).select("doc_id", "__text", "runs")
    joined = hit.unionByName(_of_names(named, names, "left_anti").select("doc_id", "__text", F.lit(None).cast("array<long>").alias("runs")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, many, digest, spans = [], [], [], [], []
            lists = batch.column(2)
            for i, text in enumerate(batch.column(1)):
                b = text.as_py().encode("utf-8")
                own = merged(lists[i].values.to_numpy(), length) if lists[i].is_valid and len(lists[i]) else np.zeros((0, 2), np.int64)
                h, at = hashlib.sha256(), 0
                for s, e in own.tolist():
                    h.update(b[at:s])
                    at = e
                h.update(b[at:])
                size.append(len(b))
                gone.append(int((own[:, 1] - own[:, 0]).sum()))
                many.append(len(own))
                digest.append(h.hexdigest())
                spans.append(own.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (size, gone, many)), pa.array(digest), pa.array(spans, pa.list_(pa.int64()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return removed_spans(docs).drop("spans")


def brute_force(rows: list[tuple[int, str]], length: int = LENGTH) -> dict[int, list[tuple[int, int]]]:
    """The removed spans of each row by a table of all windows; for tests on small tables."""
    texts = [(text or "").encode() for _, text in rows]
    seen: dict[bytes, int] = {}
    for b in texts:
        for i in range(len(b) - length + 1):
            k = hashlib.blake2b(b[i : i + length], digest_size=16).digest()
            seen[k] = seen.get(k, 0) + 1
    out = {}
    for (doc, _), b in zip(rows, texts, strict=True):
        spans: list[list[int]] = []
        for i in range(len(b) - length + 1):
            if seen[hashlib.blake2b(b[i : i + length], digest_size=16).digest()] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out[doc] = [tuple(x) for x in spans]
    return out
