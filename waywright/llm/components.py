"""Connected components over links, by contraction on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long): root is its component's smallest node.

    Each round lets a node follow its smallest neighbour, if smaller, to where that chain
    ends, and links what remains of the links between those ends; at least half of the nodes
    that have links left go in a round.  Rounds go on until no link is left.  Every table is
    written, so a lost executor costs one step.  No links give an empty table; self-links
    are allowed and null ends are not.
    """
    edges = scratch.cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges-0")
    ends = edges.select("a").union(edges.select("b"))
    found = scratch.cut(ends.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), f"{name}-found-0")
    step = 0
    while edges.filter("a <> b").limit(1).count():
        step += 1
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        up = scratch.cut(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("up")), f"{name}-up-{step}-0")
        hops = 0
        while True:
            hops += 1
            over = up.select(F.col("node").alias("at"), F.col("up").alias("top"))
            higher = up.join(over, up.up == over["at"]).select("node", F.col("top").alias("next"), F.col("up").alias("was"))
            higher = scratch.cut(higher, f"{name}-up-{step}-{hops}")
            scratch.drop(f"{name}-up-{step}-{hops - 1}")
            moved = higher.filter("next <> was").limit(1).count()
            up = higher.select("node", F.col("next").alias("up"))
            if not moved:
                break
        left, right = (up.select(F.col("node").alias(c), F.col("up").alias(f"top_{c}")) for c in ("a", "b"))
        fewer = edges.filter("a <> b").join(left, "a").join(right, "b").filter("top_a <> top_b")
        edges = scratch.cut(fewer.select(F.least("top_a", "top_b").alias("a"), F.greatest("top_a", "top_b").alias("b")).distinct(), f"{name}-edges-{step}")
        found = scratch.cut(found.join(up.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), f"{name}-found-{step}")
        scratch.drop(f"{name}-up-{step}-{hops}", f"{name}-edges-{step - 1}", f"{name}-found-{step - 1}")
    scratch.drop(f"{name}-edges-{step}")
    return found
