"""Connected components of a graph of links, as a few joins; nothing is gathered on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centrova.llm.frames import counted, hinted


@dataclass
class Labels:
    """node, component (the smallest node reachable) of every node that has links, and how many nodes these are."""

    frame: DataFrame
    n: int

    def of(self, node: str, component: str) -> DataFrame:
        """The labels under other names, to be joined; broadcast while they are few."""
        return hinted(self.frame.select(F.col("node").alias(node), F.col("component").alias(component)), self.n)


def components(links: DataFrame) -> Labels:
    """The labels of links (a, b).

    Labels fall to the least label among neighbours, then to their label's label, so a round at least doubles the distance that a
    label has come; each round is one job, written to the checkpoint folder.  Hubs are safe: minima are taken before rows are dealt
    out, and joins on a hub can be split.
    """
    both, _ = counted(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    frame, found = counted(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    labels = Labels(frame, found["n"])
    while True:
        near = both.join(labels.of("b", "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        fell = labels.frame.join(hinted(near, labels.n), F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "m").alias("new"))
        fell = fell.join(labels.of("via", "further"), F.col("new") == F.col("via")).select("node", "old", F.least("new", "further").alias("component"))
        fell, found = counted(fell, changed=F.count_if(F.col("old") != F.col("component")))
        labels = Labels(fell.select("node", "component"), labels.n)
        if not found["changed"]:
            return labels


def joined(labels: Labels, links: DataFrame) -> Labels:
    """The labels after further links (a, b): only components that a link ties together are looked at again."""
    ends = links.select("a", "b")
    for c in ("a", "b"):
        ends = ends.join(labels.of(c, f"of_{c}"), c, "left").withColumn(c, F.coalesce(f"of_{c}", c)).drop(f"of_{c}")
    merged = components(ends.filter("a != b"))
    known = labels.frame.join(merged.of("old", "new"), F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    fresh = merged.frame.join(hinted(labels.frame.select("node"), labels.n), "node", "left_anti").select("node", "component")
    return Labels(*_sized(known.union(fresh)))


def _sized(df: DataFrame) -> tuple[DataFrame, int]:
    out, found = counted(df)
    return out, found["n"]
