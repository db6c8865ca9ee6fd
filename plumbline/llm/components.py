"""Connected components of a link table, by alternating star contraction.

Every round is two joins and two minimum aggregations over the remaining
links; nothing is collected but the number of links that changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import cut

MAX_ROUNDS = 60


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Links of every node's (larger or smaller) neighbours to its least neighbour."""
    if larger:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if larger:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def _digest(links: DataFrame):
    return links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links, either way round and with repeats, to (node, component).

    component is the least node reachable. Nodes without a link to another
    node aren't in the result; null ends are ignored. Rounds stop when the
    links no longer change: then every node points at its component.
    """
    now = cut(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = None
    for _ in range(MAX_ROUNDS):
        seen = _digest(now)
        if seen == was or not seen[0]:
            break
        was = seen
        now = cut(_star(cut(_star(now, True)), False))
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.groupBy("a").agg(F.min("b").alias("c")).select(F.col("a").alias("node"), F.col("c").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
