"""Substring dedup: content-defined chunking with a gear rolling hash, variable chunks deduplicated by digest.

A text is cut where the gear hash of the last 16 bytes hits a mask: after white space with two bits, after any other character
with six.  A cut closer than ``MIN_CHUNK`` bytes to the hit before it is dropped, and a chunk above ``MAX_CHUNK`` is cut on from its
own start.  Every rule looks at nearby bytes alone, so an insertion moves no cut beyond its neighbourhood.

Of each digest the documents' smallest doc_id keeps the chunk, once; every other occurrence is a duplicate.  Runs of duplicates of
at least ``min_run`` bytes are removed; shorter ones are common phrases and stay.  A chunk of ``WIDE`` bytes or more has two digests
of 64 bits and is a duplicate only if both are; a run of shorter ones holds several digests.  So no single collision of 64 bits
removes anything.

A document emits each digest once.  Keepers come from minima taken before the shuffle, so a passage in a third of all documents
is no burden to any task; the join back to documents can be split by Spark.  Nothing is broadcast or collected.

Defined results: null text is empty and has no chunks; rows that share a doc_id count as one document and share its duplicates;
rows without a doc_id are one document for each different text, and keep a chunk only if no document with a doc_id has it; an
empty table gives an empty result; further columns are carried along untouched by ``deduplicated`` and not read by ``removals``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from centrova.llm import textbytes as tb

WINDOW, MIN_CHUNK, MAX_CHUNK, MIN_RUN, WIDE = 16, 8, 512, 100, 64
GEAR = (tb.RAW2 >> np.uint64(13)).astype(np.uint32)
_SPACE = ~tb.NOT_SPACE


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j over the last WINDOW bytes, in 32 bits, by doubling."""
    h, width = GEAR[data], 1
    while width < WINDOW:
        nxt = h.copy()
        nxt[width:] += h[:-width] << np.uint32(width)
        h, width = nxt, width * 2
    return h


def chunks(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, stop, row of every chunk; they cover all bytes of all rows in order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gear(data)
    bits = h >> np.uint32(WINDOW - 6)
    ends_character = np.ones(n, bool)
    ends_character[:-1] = (data[1:] & 0xC0) != 0x80
    space = _SPACE[data]
    hit = np.flatnonzero((space & ((bits & np.uint32(0x30)) == 0)) | (~space & ends_character & ((bits & np.uint32(0x3F)) == 0))) + 1
    row = np.searchsorted(offs, hit - 1, "right") - 1
    # The window and the distance rule see no byte of another row: hits whose window starts before the row are no hits.
    ok = hit - offs[row] >= WINDOW
    hit, row = hit[ok], row[ok]
    apart = np.ones(len(hit), bool)
    apart[1:] = (hit[1:] - hit[:-1] >= MIN_CHUNK) | (row[1:] != row[:-1])
    filled = np.flatnonzero(np.diff(offs) > 0)
    start = np.unique(np.concatenate([offs[filled], hit[apart & (hit < offs[row + 1])]]))
    stop = np.append(start[1:], n)
    long = np.flatnonzero(stop - start > MAX_CHUNK)
    if len(long):
        more = []
        for s, e in zip(start[long], stop[long], strict=True):
            at = s + MAX_CHUNK
            while at < e:
                while at > s and (data[at] & 0xC0) == 0x80:
                    at -= 1
                more.append(at)
                at += MAX_CHUNK
        start = np.sort(np.concatenate([start, np.array(more, np.int64)]))
        stop = np.append(start[1:], n)
    return start, stop, np.searchsorted(offs, start, "right") - 1


def digests(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The digest of every chunk; which chunks are wide; their second digests."""
    wide = np.flatnonzero(stop - start >= WIDE)
    one = tb.span_hash(tb.prefix(data, tb.RAW), start, stop)
    two = tb.mix(tb.span_hash(tb.prefix(data, tb.RAW2), start[wide], stop[wide]) ^ np.uint64(0x2D)) if len(wide) else np.zeros(0, np.uint64)
    return tb.signed(one), wide, tb.signed(two)


def _named(docs: DataFrame) -> DataFrame:
    """docs with __own: what names a row without a doc_id, by its text; null where there is a doc_id."""
    return docs.withColumn("__own", F.when(F.col("doc_id").isNull(), F.xxhash64(F.col("text").cast("string"))))


def _emitted(docs: DataFrame) -> DataFrame:
    """digest, doc_id, own: each digest of a document once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tb.slices(batch.column(2)):
                start, stop, row = chunks(data, offs)
                one, wide, two = digests(data, start, stop)
                d, row = np.concatenate([one, two]), np.concatenate([row, row[wide]])
                once = np.unique(tb.mix(d.view(np.uint64) ^ tb.mix(row.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
                rows = pa.array(row[once] + lo)
                yield pa.RecordBatch.from_arrays([pa.array(d[once]), batch.column(0).take(rows), batch.column(1).take(rows)], ["digest", "doc_id", "own"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _named(docs).select("doc_id", "__own", F.col("text").cast("string").alias("text")).mapInArrow(run, f"digest long, doc_id {kind}, own long")


def duplicate_chunks(docs: DataFrame) -> DataFrame:
    """__doc, __no_doc, __digests: of each document the digests that another document keeps."""
    rows = _emitted(docs)
    kept = rows.groupBy("digest").agg(F.min("doc_id").alias("keeper"), F.min("own").alias("own_keeper"), F.count("*").alias("n")).filter("n > 1").select("digest", "keeper", "own_keeper")
    keeps = F.col("doc_id").eqNullSafe(F.col("keeper")) & (F.col("doc_id").isNotNull() | (F.col("own") == F.col("own_keeper")))
    dup = rows.join(kept, "digest").filter(~keeps)
    return dup.groupBy(F.col("doc_id").alias("__doc"), F.col("own").alias("__no_doc")).agg(F.collect_set("digest").alias("__digests"))


def _runs(data: np.ndarray, offs: np.ndarray, marked: list[np.ndarray | None], min_run: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per row the removed [start, stop) pairs, relative to the row; and its number of chunks."""
    start, stop, row = chunks(data, offs)
    d, wide, two = digests(data, start, stop)
    both = d.copy()
    both[wide] ^= two
    key = tb.mix(both.view(np.uint64) ^ tb.mix(row.astype(np.uint64) + np.uint64(1)))
    dup = np.ones(len(d), bool)
    dup[np.unique(key, return_index=True)[1]] = False  # all but the first occurrence in the row
    first = np.searchsorted(row, np.arange(len(offs)))
    out = []
    for r in range(len(offs) - 1):
        a, b = first[r], first[r + 1]
        if marked[r] is not None and len(marked[r]):
            marks = np.isin(d[a:b], marked[r])
            w = slice(*np.searchsorted(wide, [a, b]))
            marks[wide[w] - a] &= np.isin(two[w], marked[r])
            dup[a:b] |= marks
        own = dup[a:b]
        if not own.any():
            out.append(np.zeros((0, 2), np.int64))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))).reshape(-1, 2)
        spans = np.stack([start[a + edge[:, 0]], stop[a + edge[:, 1] - 1]], axis=1) - offs[r]
        out.append(spans[spans[:, 1] - spans[:, 0] >= min_run])
    return out, np.diff(first)


def without(text: bytes, spans: np.ndarray) -> bytes:
    if not len(spans):
        return text
    at, parts = 0, []
    for s, e in spans.tolist():
        parts.append(text[at:s])
        at = e
    parts.append(text[at:])
    return b"".join(parts)


def deduplicated(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """The documents with duplicate runs cut from text, and __n_bytes, __n_chunks, __spans (flat starts and stops of what went)."""
    marks = duplicate_chunks(docs)
    cols = docs.columns
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("__own").eqNullSafe(F.col("__no_doc"))
    joined = _named(docs).join(marks, same, "left").select(*cols, "__digests")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = cols.index("text")
        for batch in batches:
            for lo, hi, data, offs in tb.slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                lists = part.column(len(cols))
                marked = [lists[i].values.to_numpy() if lists[i].is_valid else None for i in range(hi - lo)]
                spans, n = _runs(data, offs, marked, min_run)
                own = list(part.columns[:-1])
                if any(len(s) for s in spans):
                    valid = part.column(at).is_valid().to_pylist()
                    whole = data.tobytes()
                    left = [without(whole[offs[i] : offs[i + 1]], spans[i]).decode("utf-8") if valid[i] else None for i in range(hi - lo)]
                    own[at] = pa.array(left, pa.string())
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(offs)), pa.array(n.astype(np.int64)), pa.array([s.ravel() for s in spans], pa.list_(pa.int64()))], [*cols, "__n_bytes", "__n_chunks", "__spans"])

    schema = StructType([*docs.schema.fields]).add("__n_bytes", LongType()).add("__n_chunks", LongType()).add("__spans", ArrayType(LongType()))
    return joined.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)


def removals(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_removed, n_spans, kept_sha256 of every document."""
    d = deduplicated(docs.select("doc_id", "text"), min_run)
    left = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return d.select("doc_id", F.col("__n_bytes").alias("n_bytes"), F.col("__n_chunks").alias("n_chunks"), (F.col("__n_bytes") - F.length(left)).cast("long").alias("n_removed"), (F.size("__spans") / 2).cast("long").alias("n_spans"), F.sha2(left, 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str]], min_run: int = MIN_RUN) -> dict[int, bytes]:
    """What is left of each text, by plain loops over bytes; for tests on small tables without repeated or null doc_ids."""
    table = [int(x) for x in GEAR]
    cut: dict[int, list[bytes]] = {}
    for doc, text in rows:
        b = (text or "").encode()
        hits, h = [], 0
        for i, x in enumerate(b):
            h = ((h << 1) + table[x]) & 0xFFFFFFFF
            low = (h & 0xFFFF) >> (WINDOW - 6)
            space = x in b" \t\n\v\f\r"
            whole = i + 1 == len(b) or (b[i + 1] & 0xC0) != 0x80
            if i + 1 >= WINDOW and ((space and low & 0x30 == 0) or (not space and whole and low == 0)):
                hits.append(i + 1)
        cuts = [x for k, x in enumerate(hits) if (k == 0 or x - hits[k - 1] >= MIN_CHUNK) and x < len(b)]
        edges = [0, *cuts, len(b)] if b else [0]
        parts = []
        for s, e in zip(edges, edges[1:], strict=False):
            while e - s > MAX_CHUNK:
                at = s + MAX_CHUNK
                while (b[at] & 0xC0) == 0x80:
                    at -= 1
                parts.append(b[s:at])
                s = at
            parts.append(b[s:e])
        cut[doc] = parts
    keeper: dict[bytes, int] = {}
    for doc in sorted(cut):
        for p in cut[doc]:
            keeper.setdefault(hashlib.sha256(p).digest(), doc)
    out = {}
    for doc, parts in cut.items():
        seen, left, run = set(), b"", b""
        for p in [*parts, None]:
            k = hashlib.sha256(p).digest() if p is not None else None
            if p is not None and (keeper[k] != doc or k in seen):
                run += p
                continue
            if len(run) < min_run:
                left += run
            run = b""
            if p is not None:
                seen.add(k)
                left += p
        out[doc] = left
    return out
