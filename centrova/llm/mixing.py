"""Mixing sources to target weights by systematic sampling.

Sizes are numbers of words (runs of other than ASCII white space).  Sources, by code point with null last, weigh 5, 2, 1,
repeating, and share ``budget`` times all sizes; a target stops at ``cap`` times its source's size and the excess is reshared by
weight, which ends where ``target = min(cap * size, level * weight)`` for one level.

Within a source every document expects ``rate = target / source size`` copies.  The prefix sum of expected copies before the
i-th document is ``rate * i``; with one random offset u per source the document is emitted once per integer in
``(u + rate * i, u + rate * (i + 1)]``.  Documents are ordered by coarse size, so that every stretch of the line has its share of
words, then by bucket of doc_id, size and doc_id.  No task holds a whole source: counts per (source, size class, bucket), whose
number has a fixed bound per source, give each bucket its first place, and places within a bucket are a window over the bucket.

Defined results: null text has size 0; null sources are one source, the last; null doc_ids go to a bucket of their own; repeated
rows each take their own place; a source without words has target 0 and nothing taken; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from centrova.llm.frames import saved

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 256
PRIME = 2147483647


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def size_class(size: Column) -> Column:
    """Classes that are a quarter of a doubling wide, in whole numbers: the bit length and the two bits after the first."""
    bits = F.length(F.conv(size.cast("string"), 10, 2))
    return F.when(size < 4, size).otherwise(4 * bits + F.shiftrightunsigned(size * 4, 0) / F.pow(F.lit(2.0), bits - 1)).cast("long")


def bucket(doc_id: Column) -> Column:
    """A bucket by multiplicative hashing, in arithmetic that any SQL engine repeats; null: a bucket of its own."""
    return F.coalesce(F.pmod(F.pmod(doc_id, F.lit(PRIME)) * 48271 % PRIME, F.lit(BUCKETS)), F.lit(BUCKETS)).cast("long")


def offset(source_rank: Column, seed: int) -> Column:
    """The random offset of a source in (0, 1)."""
    h = ((source_rank + 1) * 1103515245 + seed * 69621) % PRIME
    return ((h * h + seed) % PRIME * 48271 % PRIME + F.expr("0.5e0")) / F.expr("2147483647e0")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """source, source_rank, source_size, target, rate, u; a row per source.

    The windows run over one row per source in one task; there are as many rows as sources, not documents.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("source_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1)
    k = len(weights)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % k + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * F.lit(cap))
    every = W.partitionBy(F.lit(1))
    below = W.partitionBy(F.lit(1)).orderBy(F.col("most") / F.col("weight"), "source_rank").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("capped", F.coalesce(F.sum("most").over(below), F.lit(0.0))).withColumn("w_capped", F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    level = (F.lit(budget) * F.sum("source_size").over(every) - F.col("capped")) / (F.sum("weight").over(every) - F.col("w_capped"))
    # The level if all sources before this one, by cap per weight, are at their cap; the first that stays under its cap has the true one.
    s = s.withColumn("level", level).withColumn("under", F.col("level") * F.col("weight") <= F.col("most"))
    s = s.withColumn("true_level", F.min(F.when(F.col("under"), F.struct((F.col("most") / F.col("weight")).alias("r"), F.col("source_rank"), F.col("level"))))
                     .over(every)["level"])
    s = s.withColumn("target", F.least(F.col("most"), F.coalesce(F.col("true_level"), F.lit(float("inf"))) * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return s.select("source", "source_rank", "source_size", "target", rate.alias("rate"), offset(F.col("source_rank"), seed).alias("u"))


def mix(docs: DataFrame, *more: str, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken (copies * size), then ``more`` columns of the documents, as a struct ``row``."""
    size = n_words(F.col("text"))
    cols = ["doc_id", F.col("source").cast("string").alias("source"), size.alias("size")]
    # Words are counted once: sizes are saved, unless whole rows would have to be saved with them.
    sized = docs.select(*cols, F.struct(*[F.col(c) for c in more]).alias("row")) if more else saved(docs.select(*cols))
    sized = sized.withColumn("class", size_class(F.col("size"))).withColumn("bucket", bucket(F.col("doc_id")))
    cells = sized.groupBy("source", "class", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    targets = source_targets(cells, weights, budget, cap, seed)
    before = W.partitionBy("source").orderBy("class", "bucket").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("source", "class", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    cells = cells.join(targets, cells["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    own = W.partitionBy("source", "class", "bucket").orderBy("size", "doc_id")
    placed = sized.withColumn("place", F.row_number().over(own).cast("long") - 1)
    c = cells.select(F.col("source").alias("_s"), F.col("class").alias("_c"), F.col("bucket").alias("_b"), "before", "source_size", "target", "rate", "u")
    placed = placed.join(c, placed["source"].eqNullSafe(c["_s"]) & (placed["class"] == c["_c"]) & (placed["bucket"] == c["_b"]))
    i = F.col("before") + F.col("place")
    copies = F.floor(F.col("u") + F.col("rate") * (i + 1)) - F.floor(F.col("u") + F.col("rate") * i)
    out = placed.withColumn("copies", copies.cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if more else []))


def mixed_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every document of the table with its number of copies, copies above 0 only; earlier mix_ columns give way."""
    m = mix(docs, *[c for c in docs.columns if c.lower() not in ("mix_copies", "mix_size", "mix_target")]).filter("copies > 0")
    return m.select("row.*", F.col("copies").alias("mix_copies"), F.col("size").alias("mix_size"), F.col("target").alias("mix_target"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM {docs}
), c AS (
  SELECT *, CASE WHEN size < 4 THEN size ELSE CAST(floor(4 * length(bin(size)) + size * 4 / pow(2.0, length(bin(size)) - 1)) AS BIGINT) END AS class,
    coalesce(((doc_id % 2147483647 + 2147483647) % 2147483647) * 48271 % 2147483647 % 256, 256) AS bucket FROM sized
), s0 AS (
  SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank FROM sized GROUP BY source
), s1 AS (
  SELECT *, CASE source_rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS most FROM s0
), s2 AS (
  SELECT *, coalesce(sum(most) OVER b, 0) AS capped, coalesce(sum(weight) OVER b, 0) AS w_capped, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight FROM s1
  WINDOW b AS (ORDER BY most / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s3 AS (SELECT *, (1.5::DOUBLE * all_size - capped) / (all_weight - w_capped) AS level FROM s2
), s4 AS (
  SELECT *, least(most, (SELECT level FROM s3 WHERE level * weight <= most ORDER BY most / weight, source_rank LIMIT 1) * weight) AS target,
    ((source_rank + 1) * 1103515245 + 17 * 69621) % 2147483647 AS h FROM s3
), s5 AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate, (((h * h + 17) % 2147483647) * 48271 % 2147483647 + 0.5::DOUBLE) / 2147483647::DOUBLE AS u FROM s4
), placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, bucket, size, doc_id) - 1 AS i FROM c)
SELECT p.doc_id, p.size, CAST(s.source_size AS BIGINT) AS source_size, s.target,
  CAST(floor(s.u + s.rate * (p.i + 1)) - floor(s.u + s.rate * p.i) AS BIGINT) * p.size AS taken
FROM placed p JOIN s5 s ON p.source IS NOT DISTINCT FROM s.source
"""


def oracle_sql(docs: str = "documents") -> str:
    return SQL.replace("{docs}", docs)
