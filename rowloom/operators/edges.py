"""Edge lists: emission from cells, and their numeric and undirected forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.smoothing import Smoothing
from rowloom.operators.cells import value_frequency
from rowloom.operators.hot_keys import frequent_by_count, lookup_join
from rowloom.operators.numbering import dense_index
from rowloom.session import large

EDGE_SCHEMA = "src string, dst string, w_fwd double, w_back double"


def edge_list(
    token_table: DataFrame,
    smoothing: Smoothing = Smoothing(),
    frequency: DataFrame | None = None,
    window: str | None = None,
) -> DataFrame:
    """Two edges per token: row to token (1, w) and token to column (w, 1).

    ``w`` is the smoothed frequency of the token, 1 when ``frequency`` does not hold it. By default
    the frequencies are those of ``token_table``; give :func:`value_frequency` of raw values to
    weight by the uncleaned text. Without smoothing no join takes place. With ``window`` (a column
    of numbers) frequencies are per window, and edges of later windows are the later ones.
    """
    by = (window,) if window else ()
    if smoothing.method == "no":
        weighted = token_table.withColumn("w", F.lit(1.0))
    else:
        counts = value_frequency(token_table, by) if frequency is None else frequency
        on = [*by, "value"]
        found = lookup_join(token_table, counts, on, frequent_by_count(counts, on, "frequency"), "left")
        weighted = found.withColumn("w", F.coalesce(smoothing.weight(F.col("frequency")), F.lit(1.0)))
    sub = F.col("sub") if "sub" in token_table.columns else F.lit(0)
    token = F.concat(F.when(F.col("is_numeric"), "tn__").otherwise("tt__"), F.col("value"))

    def edge(side: int, src, dst, w_fwd, w_back):
        seq = F.struct(
            *([F.col(window).alias("window")] if window else []),
            F.col("rid_no").alias("rid"), F.col("col_no").alias("col"), "pos", sub.alias("sub"), F.lit(side).alias("side")
        )
        return F.struct(
            seq.alias("edge_seq"), src.alias("src"), dst.alias("dst"), w_fwd.alias("w_fwd"), w_back.alias("w_back")
        )

    one = F.lit(1.0)
    pair = F.array(
        edge(0, F.col("rid"), token, one, F.col("w")),
        edge(1, token, F.concat(F.lit("cid__"), F.col("col")), F.col("w"), one),
    )
    return weighted.select(F.inline(pair))


def adjacency_rows(edges: DataFrame) -> DataFrame:
    """Neighbour map in long form; the way back of a one-way edge has weight 0.

    The last edge of a node pair wins. Long rows instead of one map per node, as the neighbours of
    a column node grow with the table.
    """
    both = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("edge_seq"), F.lit(0).alias("way"), F.col("src").alias("node"), F.col("dst").alias("nbr"),
                         F.col("w_fwd").alias("weight")),
                F.struct(F.col("edge_seq"), F.lit(1).alias("way"), F.col("dst").alias("node"), F.col("src").alias("nbr"),
                         F.coalesce("w_back", F.lit(0.0)).alias("weight")),
            )
        )
    )
    return both.groupBy("node", "nbr").agg(F.max_by("weight", F.struct("edge_seq", "way")).alias("weight"))


def numeric_adjacency(edges: DataFrame) -> DataFrame:
    """Adjacency with node names replaced by dense ids in name order."""
    ids = node_ids(edges)
    return (
        adjacency_rows(edges)
        .join(large(ids.select(F.col("node"), F.col("node_id"))), "node")
        .join(large(ids.select(F.col("node").alias("nbr"), F.col("node_id").alias("nbr_id"))), "nbr")
        .select("node_id", "nbr_id")
    )


def node_ids(edges: DataFrame) -> DataFrame:
    names = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return dense_index(names, ["node"], "node_id")


def undirected_edges(edges: DataFrame) -> DataFrame:
    """Distinct node pairs, ends in name order, for export to graph tools."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
