"""The older graph: row, cell and column nodes straight from the table, and left/right steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.hashing import hash60, scaled
from rowloom.functions.smoothing import Smoothing
from rowloom.functions.text import canonical
from rowloom.operators.graph import uniform_slots
from rowloom.operators.hot_keys import frequent_by_count, lookup_join
from rowloom.session import large

# kinds of neighbour that a step to the left or right leads to, by kind of node
DIRECTIONS = {"left": {"cell": "row", "column": "cell"}, "right": {"row": "cell", "cell": "column"}}


def tripartite_graph(
    df: DataFrame, key: str, cols: list[str], smoothing: Smoothing = Smoothing.parse("smooth"), flatten: bool = False
) -> DataFrame:
    """``node, node_kind, nbr, nbr_kind, weight``; the weight is the smoothed frequency of ``nbr``.

    Rows and columns weigh 1, and so do words when ``flatten`` splits the values. Cells that look
    like a row id get ``dfc_`` in front, columns named like a cell get ``dfcol_``.
    """
    entries = []
    for c in cols:
        whole = isinstance(df.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        value = F.col(c).cast("string") if whole else canonical(F.col(c).cast("string"))
        entries.append(F.struct(F.lit(c).alias("col"), value.alias("value")))
    long = df.select(F.concat(F.lit("idx_"), F.col(key).cast("string")).alias("rid"), F.inline(F.array(*entries))).filter(
        "value is not null"
    )
    if flatten:
        long = long.select("rid", "col", F.explode(F.split("value", "_")).alias("value")).filter("value <> ''")
    long = long.withColumn("cell", F.when(F.col("value").startswith("idx_"), F.concat(F.lit("dfc_"), "value")).otherwise(F.col("value")))
    if flatten or smoothing.method == "no":
        weighted = long.withColumn("w", F.lit(1.0))
    else:
        counts = long.groupBy("cell").agg(F.count(F.lit(1)).alias("frequency"))
        found = lookup_join(long, counts, ["cell"], frequent_by_count(counts, ["cell"], "frequency"))
        weighted = found.withColumn("w", smoothing.weight(F.col("frequency")))

    # a column takes its escaped name when some cell is spelled like it (at most one row per column)
    clash = long.filter(F.col("cell").isin(cols)).select(F.col("cell").alias("col")).distinct().withColumn("clash", F.lit(True))
    named = weighted.join(clash, "col", "left").withColumn(
        "column", F.when(F.col("clash"), F.concat(F.lit("dfcol_"), "col")).otherwise(F.col("col"))
    )

    def edge(node, kind, nbr, nbr_kind, weight):
        return F.struct(F.col(node).alias("node"), F.lit(kind).alias("node_kind"), F.col(nbr).alias("nbr"),
                        F.lit(nbr_kind).alias("nbr_kind"), weight.alias("weight"))

    one = F.lit(1.0)
    edges = F.array(
        edge("rid", "row", "cell", "cell", F.col("w")),
        edge("cell", "cell", "rid", "row", one),
        edge("column", "column", "cell", "cell", F.col("w")),
        edge("cell", "cell", "column", "column", one),
    )
    return named.select(F.inline(edges)).distinct()


def step_slots(graph: DataFrame, direction: str) -> DataFrame:
    """Numbered neighbours for steps in one direction."""
    wanted = DIRECTIONS[direction]
    allowed = F.lit(False)
    for kind, nbr_kind in wanted.items():
        allowed = allowed | ((F.col("node_kind") == kind) & (F.col("nbr_kind") == nbr_kind))
    return uniform_slots(graph.filter(allowed).select("node", "nbr"))


def left_right_step(walkers: DataFrame, graph: DataFrame, direction: str, seed: int = 42) -> DataFrame:
    """Move walkers (``walk_id, node``) one step; those of a kind that cannot go there drop out."""
    slots = step_slots(graph, direction)
    sizes = slots.filter("slot = 0").select("node", "degree")
    draw = hash60(seed, F.col("walk_id"), direction, 0)
    keyed = walkers.join(large(sizes), "node").withColumn("slot", scaled(draw, F.col("degree")))
    return keyed.join(large(slots.select("node", "slot", "nbr")), ["node", "slot"]).select("walk_id", "node", "nbr")
