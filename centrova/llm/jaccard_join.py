"""N-gram Jaccard join by parity sketches.

A text's set is its distinct k-word shingles, hashed to 64 bits.  For sets that link (100 * intersection >= percent * union) the
symmetric difference is at most D = size * (100 - percent) / percent for either of them.

*Sketch.*  The shingles of a set are dealt to g blocks by the high bits of their hash and XORed within a block: the parity sketch
of a very wide bit vector, kept block by block.  A shingle that only one of two sets has changes one block, so no more blocks
differ than the symmetric difference (Hamming distance of the folded bit sketch likewise).

*Pigeonhole join.*  Of blocks in order, let i be the first that is not empty and equal in both sets.  All filled blocks before it
differ, so it is among the first D + 1 filled blocks of either set: each set emits just those, and linked sets share a key.  g
depends on the size band (a doubling); a set emits in its own band and, if a larger partner may be in the next one, there too.  A
set with no more than D filled blocks could lack such an i, but then so must its partner: these rare sets share one further key.

*Verify.*  Within a key every set is paired with the least and the greatest set; sizes and folded sketches thin these pairs out
before any text moves, and texts are fetched only for what is left, one text of each set, for one pair of each set first.  Sets of
a key that are still in different components are then compared by Hamming distance of folded sketches, in tiles of bounded size,
and every pair that the distance allows is verified, first the closest one to each other component, then all.  Pairs inside one
component are not looked at, since they can change nothing; so no link between components is missed and no group is expanded to
all its pairs.

Equal sets are one node from the start.  Defined results: a null or word-less text has an empty set and links with nothing; a text
of fewer than k words has one shingle, its whole sequence; repeated rows each give a row; null doc_ids stay null and are never a
component's name unless it has no other; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from centrova.llm import textbytes as tb
from centrova.llm.components import Labels, components, joined
from centrova.llm.frames import bounded_broadcast, counted, drop, hinted, narrowed, release, saved, stored, texts

U64 = np.uint64
#: Sets per side of a tile of sketch comparisons, and rows of smaller keys that share a group.
TILE, GROUP_ROWS = 1024, 5000
#: Names of sets (16 bytes each) that are broadcast to fetch their texts; more meet the texts in a shuffled join.
BROADCAST_SETS = 100_000


@dataclass(frozen=True)
class Jaccard:
    """Shingles of ``words`` words; links from ``percent`` percent on."""

    words: int = 5
    percent: int = 80

    def most_apart(self, size: np.ndarray) -> np.ndarray:
        """The largest symmetric difference of a set of this size and any set that links with it."""
        return size * (100 - self.percent) // self.percent

    def pair_apart(self, total):
        """The largest symmetric difference of two linked sets whose sizes add up to total."""
        return total * (100 - self.percent) // (100 + self.percent)

    def blocks(self, band: np.ndarray) -> np.ndarray:
        return np.maximum(64, (2 ** (band + 1) * 8 * (100 - self.percent)) // (5 * self.percent) + 1)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each row, sorted within it; their rows; the first of each row (rows + 1)."""
    w = tb.words(data, offs, tb.NOT_SPACE, tb.FOLDED)
    at, h = tb.ngrams(w, k)
    rows, whole = tb.whole_hash(w, k)
    doc, h = np.concatenate([w.doc[at], rows]), np.concatenate([h, whole])
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
    doc, h = doc[order], h[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        doc, h = doc[new], h[new]
    return h, doc, np.searchsorted(doc, np.arange(len(offs)))


def set_ids(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set as a whole."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(tb.mix(h * U64(0x9E3779B97F4A7C15) + U64(1)), out=sums[1:])
    return tb.signed(tb.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)))


def _xor_groups(h: np.ndarray, doc: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, block, XOR of each filled block; shingles come sorted by row and hash, hence by block."""
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])
    start = np.flatnonzero(new)
    return doc[start], block[start], np.bitwise_xor.reduceat(h, start) if len(start) else h


def block_keys(h: np.ndarray, doc: np.ndarray, first: np.ndarray, j: Jaccard) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): what the sets emit for the pigeonhole join."""
    size = np.diff(first)
    band = np.zeros(len(size), np.int64)
    full = size > 0
    band[full] = np.frexp(size[full].astype(float))[1] - 1
    apart = j.most_apart(size)
    up = full & (size * 100 // j.percent >= 2 ** (band + 1))
    rows, keys = [], []
    for layout, who in ((band, full), (band + 1, up)):
        take = who[doc]
        t, d = h[take], doc[take]
        if not len(t):
            continue
        block = ((t >> U64(32)) * j.blocks(layout)[d].astype(np.uint64)) >> U64(32)
        row, block, x = _xor_groups(t, d, block)
        begin = np.searchsorted(row, np.arange(len(size)))
        rank = np.arange(len(row)) - begin[row]
        emit = rank <= apart[row]
        salt = tb.mix(block[emit] * U64(64) + layout[row[emit]].astype(np.uint64))
        rows.append(row[emit])
        keys.append(tb.mix(x[emit] ^ salt))
        filled = np.bincount(row, minlength=len(size))
        poor = np.flatnonzero(who & (filled <= apart))
        rows.append(poor)
        keys.append(tb.mix(U64(0xF00D) + layout[poor].astype(np.uint64)))
    return (np.concatenate(rows), np.concatenate(keys)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def folded_sketches(h: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, 64-bit words): a bit sketch per set with at least four bits a shingle; halves XOR to the next smaller sketch."""
    size = np.diff(first)
    band = np.frexp(np.maximum(size, 1).astype(float))[1] - 1
    width = np.maximum(4, 2 ** np.maximum(band - 3, 0))
    offs = np.concatenate([[0], np.cumsum(width)])
    bit = offs[doc] * 64 + (h & (width[doc] * 64 - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(bit, minlength=int(offs[-1]) * 64) & 1).astype(np.uint8)
    return offs, np.packbits(odd, bitorder="little").view(np.uint64)


def set_rows(docs: DataFrame, j: Jaccard) -> DataFrame:
    """doc_id, n_shingles, set_id (null for an empty set), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tb.slices(batch.column(1)):
                h, doc, first = shingle_sets(data, offs, j.words)
                n = np.diff(first).astype(np.int64)
                at, sketch = folded_sketches(h, doc, first)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tb.signed(sketch)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(set_ids(h, first), mask=n == 0), lists], ["doc_id", "n_shingles", "set_id", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, n_shingles long, set_id long, sketch array<long>")


def emitted(docs: DataFrame, j: Jaccard) -> DataFrame:
    """key, set_id: the pigeonhole join's rows; sets met before in a slice of the batch emit once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in tb.slices(batch.column(0)):
                h, doc, first = shingle_sets(data, offs, j.words)
                ids = set_ids(h, first)
                row, key = block_keys(h, doc, first, j)
                once = np.zeros(len(ids), bool)
                once[np.unique(ids, return_index=True)[1]] = True
                keep = once[row]
                yield pa.RecordBatch.from_arrays([pa.array(tb.signed(key[keep])), pa.array(ids[row[keep]])], ["key", "set_id"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, set_id long")


def _distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)


def likely(pairs: DataFrame, sets: DataFrame, j: Jaccard) -> DataFrame:
    """The pairs (a, b, ...) that sizes and sketches allow; sketches of different width are left to the texts."""
    x, y = (sets.select(F.col("set_id").alias(c), *[F.col(v).alias(f"{v}_{c}") for v in ("n", "sketch")]) for c in ("a", "b"))
    sizes = 100 * F.least("n_a", "n_b") >= j.percent * F.greatest("n_a", "n_b")
    apart = _distance(F.col("sketch_a"), F.col("sketch_b")) * (100 + j.percent) <= (F.col("n_a") + F.col("n_b")) * (100 - j.percent)
    near = F.when(F.size("sketch_a") == F.size("sketch_b"), apart).otherwise(F.lit(True))
    return pairs.join(x, "a").join(y, "b").filter(sizes).filter(near).select(*pairs.columns)


def _texts_of(docs: DataFrame, wanted: DataFrame, j: Jaccard) -> DataFrame:
    """set_id, text: one text of each wanted set (set_id, name: a doc_id that holds it, null if only rows without one do)."""

    def sets_of(with_id: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, data, offs in tb.slices(batch.column(0)):
                    h, _, first = shingle_sets(data, offs, j.words)
                    ids, own = set_ids(h, first), batch.column(0).slice(lo, hi - lo)
                    rows = pa.RecordBatch.from_arrays([pa.array(ids), own], ["set_id", "text"])
                    # rows may share a doc_id, so a name alone does not give the set
                    yield rows.filter(pa.array(batch.column(1).slice(lo, hi - lo).to_numpy() == ids)) if with_id else rows

        return run

    named = bounded_broadcast(wanted.filter("name is not null"), BROADCAST_SETS)
    out = texts(docs).join(named, F.col("doc_id") == F.col("name")).select("text", "set_id").mapInArrow(sets_of(True), "set_id long, text string")
    nameless = wanted.filter("name is null").select("set_id")
    if nameless.limit(1).count():
        found = texts(docs).filter("doc_id is null").select("text").mapInArrow(sets_of(False), "set_id long, text string")
        out = out.unionByName(found.join(bounded_broadcast(nameless, BROADCAST_SETS), "set_id").select("set_id", "text"))
    return out.groupBy("set_id").agg(F.min("text").alias("text"))


def held_texts(docs: DataFrame, pairs: DataFrame, sets: DataFrame, j: Jaccard) -> tuple[DataFrame, str]:
    """set_id, text of every set in pairs (a, b), as a stored table, and its path."""
    ends, found = counted(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct())
    names, _ = counted(sets.select("set_id", "name").join(hinted(ends, found["n"]), "set_id"))
    held, path = stored(narrowed(_texts_of(docs, names, j)))
    release(docs.sparkSession)
    return held, path


def verified(pairs: DataFrame, held: DataFrame, j: Jaccard) -> tuple[DataFrame, int]:
    """The pairs (a, b) that link, by the whole sets, made anew from the held texts; and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in (2, 3):
                lists: list[np.ndarray] = []
                for lo, hi, data, offs in tb.slices(batch.column(c)):
                    h, _, first = shingle_sets(data, offs, j.words)
                    lists += [h[first[r] : first[r + 1]] for r in range(hi - lo)]
                sides.append(lists)
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(*sides, strict=True)):
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                both = int(np.count_nonzero(b[at] == a))
                keep[i] = 100 * both >= j.percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    x, y = (held.select(F.col("set_id").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b"))
    links, found = counted(pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), heavy=True)
    release(held.sparkSession)
    return links, found["n"]


def _tile_pairs(j: Jaccard, closest: bool):
    def fold(sketch: np.ndarray, width: int) -> np.ndarray:
        while sketch.shape[1] > width:
            half = sketch.shape[1] // 2
            sketch = sketch[:, :half] ^ sketch[:, half:]
        return sketch

    def pairs_of(probe: np.ndarray, ids: np.ndarray, n: np.ndarray, comp: np.ndarray, sketches: np.ndarray, out: list) -> None:
        width = np.array([len(x) for x in sketches])
        for p in np.unique(width[probe]):
            ours = np.flatnonzero(probe & (width == p))
            sk_p = np.stack(sketches[ours]).view(np.uint64)
            for b in np.unique(width[~probe]):
                if not p // 2 <= b <= p * 2:
                    continue
                base = np.flatnonzero(~probe & (width == b))
                sk_b = np.stack(sketches[base]).view(np.uint64)
                w = min(p, b)
                fp, fb = fold(sk_p, w), fold(sk_b, w)
                for i, own in enumerate(ours):
                    ok = np.flatnonzero((comp[base] != comp[own]) & (100 * np.minimum(n[own], n[base]) >= j.percent * np.maximum(n[own], n[base])))
                    if not len(ok):
                        continue
                    apart = np.bitwise_count(fb[ok] ^ fp[i]).sum(axis=1, dtype=np.int64)
                    near = apart <= j.pair_apart(n[own] + n[base[ok]])
                    ok, apart = ok[near], apart[near]
                    if closest and len(ok):
                        ok = ok[np.argsort(apart, kind="stable")]
                        ok = ok[np.unique(comp[base[ok]], return_index=True)[1]]
                    if len(ok):
                        other = ids[base[ok]]
                        out.append(np.stack([np.minimum(ids[own], other), np.maximum(ids[own], other)], axis=1))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["key", "bt", "pt"], kind="stable")
        key = g[["key", "bt", "pt"]].to_numpy()
        cut = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))), len(g))
        columns = [g[c].to_numpy() for c in ("probe", "set_id", "n", "component", "sketch")]
        out: list[np.ndarray] = []
        for lo, hi in zip(cut, cut[1:], strict=False):
            pairs_of(*(c[lo:hi] for c in columns), out)
        found = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def _named(members: DataFrame, labels: Labels) -> DataFrame:
    """key, set_id, component of members; a set without links is its own component."""
    return members.select("key", "set_id").join(labels.of("set_id", "component"), "set_id", "left").select("key", "set_id", F.coalesce("component", "set_id").alias("component"))


def _open_members(members: DataFrame, labels: Labels) -> tuple[DataFrame, int]:
    """key, set_id of the keys that hold several components, and their number.

    Keys of up to three sets are done with: their least and greatest set were compared with all others.  Keys that hold the same
    sets give the same pairs: one of them is enough.
    """
    named = _named(members, labels)
    keys = named.groupBy("key").agg(F.min("component").alias("c_lo"), F.max("component").alias("c_hi"), F.count("*").alias("m"), F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("same"))
    keys, found = counted(keys.filter("c_lo != c_hi and m > 3").groupBy("m", "same").agg(F.min("key").alias("key")).select("key"))
    out, total = counted(members.select("key", "set_id").join(hinted(keys, found["n"]), "key"), heavy=True)
    return out, total["n"]


def _across(members: DataFrame, total: int, sets: DataFrame, labels: Labels, j: Jaccard, closest: bool) -> DataFrame:
    """Pairs (a, b) of one key and different components that the sketches allow; total: the rows of members."""
    named = _named(members, labels)
    parts = named.groupBy("key", "component").agg(F.count("*").alias("n_part"))
    whole = parts.groupBy("key").agg(F.max(F.struct("n_part", "component"))["component"].alias("main"), F.sum("n_part").alias("m"), F.max("n_part").alias("n_main"))
    keys, found = counted(whole.filter("m > n_main"))
    named = named.join(hinted(keys, found["n"]), "key")
    base_tiles, probe_tiles = F.ceil(F.col("m") / TILE).cast("int"), F.ceil((F.col("m") - F.col("n_main")) / TILE).cast("int")
    own, probe = F.xxhash64("set_id", F.lit(7)), F.col("component") != F.col("main")
    # Every set is base in its tile for each probe tile; a set outside the main component is also a probe in its tile for each base tile.
    as_base = F.transform(F.sequence(F.lit(0), probe_tiles - 1), lambda t: F.struct(F.pmod(own, base_tiles).cast("int").alias("bt"), t.alias("pt"), F.lit(False).alias("probe")))
    as_probe = F.transform(F.sequence(F.lit(0), base_tiles - 1), lambda t: F.struct(t.alias("bt"), F.pmod(own, probe_tiles).cast("int").alias("pt"), F.lit(True).alias("probe")))
    dealt = named.select("key", "set_id", "component", "m", F.explode(F.when(probe, F.concat(as_base, as_probe)).otherwise(as_base)).alias("t"))
    # Small keys share a group; a tile of a large key is a group.
    group = F.when(F.col("m") <= TILE, F.pmod(F.xxhash64("key"), F.lit(-(-total // GROUP_ROWS)))).otherwise(F.xxhash64("key", "t.bt", "t.pt"))
    rows = dealt.select(group.alias("group"), "key", "t.bt", "t.pt", "t.probe", "set_id", "component").join(sets.select("set_id", "n", "sketch"), "set_id")
    return rows.groupBy("group").applyInPandas(_tile_pairs(j, closest), "a long, b long").distinct()


def _pigeonholed(docs: DataFrame, j: Jaccard) -> DataFrame:
    """key, set_id, lo, hi: the keys that several sets emit, with the least and the greatest of these."""
    rows = emitted(docs, j)
    keys = saved(narrowed(rows.groupBy("key").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).filter("lo != hi")))
    release(docs.sparkSession)
    return saved(narrowed(rows.join(keys, "key").select("key", "set_id", "lo", "hi").distinct()))


def _apart(pairs: DataFrame, labels: Labels) -> DataFrame:
    """The pairs (a, b) between different components."""
    named = pairs.select("a", "b").join(labels.of("a", "at_a"), "a", "left").join(labels.of("b", "at_b"), "b", "left")
    return named.filter(F.coalesce("at_a", "a") != F.coalesce("at_b", "b")).select("a", "b")


def _linked_stars(docs: DataFrame, members: DataFrame, sets: DataFrame, j: Jaccard) -> tuple[DataFrame, Labels]:
    """(pairs (a, b) of each set with the least and greatest set of its keys; labels by the links among these).

    Texts are moved for as few pairs as may do: the pair of each set that shares most keys, then what is left between components.
    """
    spark = docs.sparkSession
    stars = members.select("set_id", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("end")).filter("set_id != end")
    asked = saved(narrowed(stars.groupBy(F.least("set_id", "end").alias("a"), F.greatest("set_id", "end").alias("b")).agg(F.count("*").alias("shared"))))
    release(spark)
    near, found = counted(likely(asked, sets, j), heavy=True)
    release(spark)
    held, path = held_texts(docs, near, sets, j)
    ends = near.select(F.col("a").alias("s"), "shared", "a", "b").union(near.select(F.col("b").alias("s"), "shared", "a", "b"))
    best = ends.groupBy("s").agg(F.max(F.struct("shared", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    best, some = counted(best)
    labels = components(verified(best, held, j)[0])
    rest, some = counted(_apart(near.join(hinted(best, some["n"]), ["a", "b"], "left_anti"), labels))
    if some["n"]:
        links, n = verified(rest, held, j)
        labels = joined(labels, links) if n else labels
    drop(spark, path)
    release(spark)
    return asked.select("a", "b"), labels


def linked_sets(docs: DataFrame, wide: DataFrame, j: Jaccard) -> Labels:
    """The labels of the sets (by set_id) that link with another one; wide: the rows of set_rows."""
    spark = docs.sparkSession
    members = _pigeonholed(docs, j)
    release(spark)
    every = wide.filter("set_id is not null").groupBy("set_id").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("name"))
    sets, path = stored(narrowed(every.join(members.select("set_id").distinct(), "set_id")))
    release(spark)
    asked, labels = _linked_stars(docs, members, sets, j)
    members, total = _open_members(members, labels)
    for closest in (True, False) if total else ():
        allowed, found = counted(_across(members, total, sets, labels, j, closest), heavy=True)
        if not found["n"]:
            break  # no pair of different components is close enough
        pairs, found = counted(allowed.join(asked, ["a", "b"], "left_anti"))
        if found["n"]:
            held, texts_path = held_texts(docs, pairs, sets, j)
            links, n = verified(pairs, held, j)
            labels = joined(labels, links) if n else labels
            drop(spark, texts_path)
            asked = asked.union(pairs)
        release(spark)
    drop(spark, path)
    return labels


def _named_sets(docs: DataFrame, j: Jaccard) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, set_id of every document; set_id, least doc_id of the set, component of every set)."""
    wide, path = stored(set_rows(docs, j))
    sized = saved(wide.select("doc_id", "n_shingles", "set_id"))
    labels = linked_sets(docs, wide, j)
    drop(docs.sparkSession, path)
    least = sized.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    named = least.join(labels.of("set_id", "component"), "set_id", "left")
    return sized, saved(narrowed(named.select("set_id", "least", F.coalesce("component", "set_id").alias("component"))))


def near_duplicates(docs: DataFrame, j: Jaccard = Jaccard()) -> DataFrame:
    """doc_id, n_shingles, set_id, component_id (the smallest doc_id reachable by links, itself included) of every document."""
    sized, named = _named_sets(docs, j)
    names = saved(narrowed(named.groupBy("component").agg(F.min("least").alias("component_id"))))
    names = saved(narrowed(named.select("set_id", "component").join(names, "component").select(F.col("set_id").alias("s"), "component_id")))
    out = sized.join(names, F.col("set_id") == F.col("s"), "left")
    return out.select("doc_id", "n_shingles", "set_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def components_by_id(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id with 3-word shingles and links from 90 percent on."""
    return near_duplicates(docs, Jaccard(3, 90)).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, j: Jaccard = Jaccard()) -> DataFrame:
    """The documents, one of each component: one with the smallest doc_id.  Documents with empty sets all stay.

    Texts are moved once, to meet the rows that name what stays; copies of one set are dealt by their doc_ids.
    """
    cols = docs.columns
    _, named = _named_sets(docs, j)
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "set_id")).alias("k")
    keepers = named.groupBy("component").agg(first).select(F.col("k.least").alias("__doc"), F.col("k.set_id").alias("__keeps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tb.slices(batch.column(cols.index("text"))):
                h, _, first = shingle_sets(data, offs, j.words)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(set_ids(h, first), mask=np.diff(first) == 0)], [*cols, "__set"])

    known = docs.mapInArrow(run, StructType([*docs.schema.fields]).add("__set", LongType()))
    alone = known.filter("__set is null").select(*cols)
    kept = known.filter("__set is not null").join(keepers, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__set") == F.col("__keeps")))
    return alone.unionByName(kept.dropDuplicates(["doc_id", "__set"]).select(*cols))
