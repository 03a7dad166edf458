"""Connected components of a graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import written


def _least(pairs: DataFrame) -> DataFrame:
    """For each pair (u, v) the least partner of u. The least partners are written first, so that
    the join has a plain scan on both sides and Spark can split a hub's pairs."""
    least = written(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
    return pairs.join(least, "u")


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``node, component`` of all nodes in ``edges (a, b)``; a component is named by its least node.

    With ``rounds`` the work ends after so many rounds: nodes with the same name are then connected,
    but a component may still have several names.

    Alternates between linking larger and smaller partners of each node to its least partner, until
    every node is linked to the least node of its component alone. The number of pairs never grows.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, before = written(pairs, "pairs"), None
    while rounds != 0:
        if rounds is None:
            state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
            if state == before:
                break
            before = state
        else:
            rounds -= 1
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = _least(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        smaller = _least(written(larger, "larger"))
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        smaller = smaller.select(F.explode(ends).alias("p")).select("p.u", "p.v")
        pairs = written(smaller.filter("u <> v").distinct(), "pairs")
    self_named = pairs.select(F.col("v").alias("u"), "v")
    return pairs.union(self_named).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
