"""Similar tokens: replacement probabilities for walks that swap tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.session import large


def similar_nodes(similarities: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, nbr, weight`` in both directions, for pairs (``a, b, distance``) of known nodes."""
    known = nodes.select("node")
    both = (
        similarities.join(large(known.withColumnRenamed("node", "a")), "a", "left_semi")
        .join(large(known.withColumnRenamed("node", "b")), "b", "left_semi")
        .select(
            F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("nbr")),
                             F.struct(F.col("b").alias("node"), F.col("a").alias("nbr")))),
            "distance",
        )
    )
    return both.groupBy("node", "nbr").agg(F.sum("distance").alias("weight"))


def replacement_probability(similar: DataFrame, p_stay: float = 0.5) -> DataFrame:
    """``node, nbr, probability``; the node itself takes what the others leave.

    The weights of the others are scaled to ``1 - p_stay`` when their sum reaches 1, and multiplied
    by sum and ``1 - p_stay`` below.
    """
    total = similar.groupBy("node").agg(F.sum("weight").alias("total"))
    share = F.when(F.col("total") >= 1, F.col("weight") / F.col("total")).otherwise(F.col("weight") * F.col("total"))
    others = similar.join(large(total), "node").select("node", "nbr", (share * F.lit(1 - p_stay)).alias("probability"))
    stay = F.when(F.col("total") >= 1, F.lit(1 - p_stay)).otherwise(F.col("total") * F.col("total") * F.lit(1 - p_stay))
    selves = total.select("node", F.col("node").alias("nbr"), (F.lit(1.0) - stay).alias("probability"))
    return others.unionByName(selves)
