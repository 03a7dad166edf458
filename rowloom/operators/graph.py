"""Edges to graph tables: nodes, flattened edges, adjacency, draw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.hashing import TWO_60, scaled
from rowloom.functions.text import node_name, node_prefix
from rowloom.options import NodeTypes
from rowloom.operators.hot_keys import frequent_by_count, lookup_join
from rowloom.operators.numbering import GROUP_CHUNK, group_totals, number_in_groups
from rowloom.session import large

#: Exact sums of weights: below 10^16 each.
WEIGHT = "decimal(28,12)"


def _flat_tokens(node, prefixes: list[str]):
    """The node itself and, for prefixes to flatten, one node per word of its name."""
    if not prefixes:
        return F.array(node)
    prefix = node_prefix(node)
    words = F.filter(F.split(node_name(node), "_"), lambda w: w != "")
    split = F.array_distinct(F.array_append(F.transform(words, lambda w: F.concat(prefix, F.lit("__"), w)), node))
    return F.when(prefix.isin(prefixes), split).otherwise(F.array(node))


def flattened_edges(edges: DataFrame, types: NodeTypes, flatten=(), directed_back_edge: bool = False) -> DataFrame:
    """Link all words of one end to all words of the other; no edge from a node to itself.

    Null endpoints stop the job. Missing weights count as 1. A null ``w_back`` (with a ``w_fwd``)
    marks a one-way edge, which gets a way back of equal weight with ``directed_back_edge``.
    """
    prefixes = types.flattened(flatten)
    for end in ("src", "dst"):
        types_checked = types.check(F.col(end))
        edges = edges.withColumn(end, F.when(types_checked.isNotNull(), F.col(end)))
    w_back = F.coalesce("w_back", "w_fwd") if directed_back_edge else F.col("w_back")
    unweighted = F.col("w_fwd").isNull()
    spread = (
        edges.select(
            "edge_seq",
            F.when(unweighted, 1.0).otherwise(F.col("w_fwd")).alias("w_fwd"),
            F.when(unweighted, 1.0).otherwise(w_back).alias("w_back"),
            F.explode(_flat_tokens(F.col("src"), prefixes)).alias("a"),
            "dst",
        )
        .select("edge_seq", "w_fwd", "w_back", "a", F.explode(_flat_tokens(F.col("dst"), prefixes)).alias("b"))
        .filter("a <> b")
    )
    return spread.select("edge_seq", F.col("a").alias("src"), F.col("b").alias("dst"), "w_fwd", "w_back")


def node_catalog(edges: DataFrame, types: NodeTypes, flatten=()) -> DataFrame:
    """All nodes with their flags. Words made by flattening are text, whatever their prefix."""
    prefixes = types.flattened(flatten)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("whole")).distinct()
    names = ends.select(F.explode(_flat_tokens(F.col("whole"), prefixes)).alias("node")).distinct()
    node = F.col("node")
    is_word = node_prefix(node).isin(prefixes) & ~node_name(node).contains("_") if prefixes else F.lit(False)
    return names.select(
        "node",
        types.check(node).alias("prefix"),
        types.flag(node, "is_first").alias("is_first"),
        types.flag(node, "is_root").alias("is_root"),
        types.flag(node, "is_appear").alias("is_appear"),
        (types.flag(node, "is_numeric") & ~is_word).alias("is_numeric"),
    )


def both_ways(flat: DataFrame, *carry: str) -> DataFrame:
    """``edge_seq, way, node, nbr, weight`` of both directions of each edge; a missing way back is left out."""
    ends = (("src", "dst", "w_fwd"), ("dst", "src", "w_back"))
    ways = [
        F.struct("edge_seq", F.lit(way).alias("way"), F.col(a).alias("node"), F.col(b).alias("nbr"), F.col(w).alias("weight"), *carry)
        for way, (a, b, w) in enumerate(ends)
    ]
    return flat.select(F.inline(F.array(*ways))).filter(F.col("weight").isNotNull())


def adjacency(flat: DataFrame) -> DataFrame:
    """``node, nbr, weight, n_edges`` with both directions; the last edge of a pair sets the weight."""
    return both_ways(flat).groupBy("node", "nbr").agg(
        F.max_by("weight", F.struct("edge_seq", "way")).alias("weight"), F.count(F.lit(1)).alias("n_edges")
    )


def same_both_ways():
    """Aggregate: do all edges weigh the same in both directions?"""
    weighted = F.col("w_fwd").isNotNull()
    same = F.when(weighted, F.coalesce(F.col("w_fwd") == F.col("w_back"), F.lit(False))).otherwise(True)
    return F.coalesce(F.bool_and(same), F.lit(True))


def is_uniform(edges: DataFrame) -> DataFrame:
    """One row: do all edges weigh the same in both directions?"""
    return edges.agg(same_both_ways().alias("is_uniform"))


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.filter("is_root").select("node")


def isolated_nodes(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """Nodes from which no edge leads away."""
    return nodes.join(large(adj.select("node").distinct()), "node", "left_anti").select("node")


def require_connected(nodes: DataFrame, adj: DataFrame) -> None:
    lonely = isolated_nodes(nodes, adj).limit(1).collect()
    if lonely:
        raise ValueError(f"node {lonely[0].node} has no neighbours")


def degrees(adj: DataFrame) -> DataFrame:
    return adj.groupBy("node").agg(
        F.count(F.lit(1)).alias("degree"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight")
    )


def transition_probability(adj: DataFrame) -> DataFrame:
    """``node, nbr, probability``: weight over the weight of all neighbours of the node."""
    totals = adj.groupBy("node").agg(F.sum(F.col("weight").cast(WEIGHT)).alias("total"), F.count(F.lit(1)).alias("n"))
    return lookup_join(adj, totals.select("node", "total"), ["node"], frequent_by_count(totals, ["node"], "n")).select(
        "node", "nbr", (F.col("weight") / F.col("total").cast("double")).alias("probability")
    )


def first_bag(adj: DataFrame, types: NodeTypes) -> DataFrame:
    """Per node its neighbours that may start a walk, once per edge (``copies``)."""
    return adj.filter(types.flag(F.col("nbr"), "is_first")).select(
        "node", F.col("nbr").alias("first"), F.col("n_edges").alias("copies")
    )


def _with_nbr_degree(slots: DataFrame, degree: DataFrame) -> DataFrame:
    """``slots`` with the degree of each neighbour."""
    far = degree.select(F.col("node").alias("nbr"), F.col("degree").alias("nbr_degree"))
    return slots.join(large(far), "nbr", "left").select(*slots.columns, "nbr_degree")


def uniform_slots(adj: DataFrame, chunk: int = GROUP_CHUNK, far: bool = True) -> DataFrame:
    """``node, slot, nbr, degree, nbr_degree``: the neighbours of a node, numbered from 0.

    A uniform draw is then an equi-join on (node, slot), which spreads a hub over its slots. Without
    ``far`` the degrees of the neighbours are left out.
    """
    degree = group_totals(adj, "node").select("node", F.col("group_size").alias("degree"))
    sized = adj.select("node", "nbr").join(large(degree), "node")
    numbered = number_in_groups(sized, "node", "nbr", "degree", chunk=chunk)
    if not far:
        return numbered.select("node", F.col("position").alias("slot"), "nbr", "degree")
    return _with_nbr_degree(numbered.select("node", F.col("position").alias("slot"), "nbr", "degree"), degree)


def whole_weights(adj: DataFrame, weight: str = "weight") -> DataFrame:
    """``node, nbr, w, degree, total``: positive weights as whole numbers relative to the node's largest one.

    A node's largest weight becomes 2^(61 - bits of its degree), so its total is at most 2^61, and a weight
    that would become 0 is 1. Sums are then exact, and a neighbour with a share of 2^-40 keeps its draws.
    """
    exact = adj.filter(F.col(weight) > 0).select("node", "nbr", F.col(weight).cast("double").alias("weight"))
    sizes = exact.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.max("weight").alias("largest"))
    unit = F.call_function("shiftleft", F.lit(1).cast("bigint"), 61 - F.length(F.bin(F.col("degree")))).cast("double")
    w = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("weight") / F.col("largest") * unit))
    sized = exact.join(large(sizes), "node").select("node", "nbr", w.alias("w"), "degree")
    return sized.join(large(sized.groupBy("node").agg(F.sum("w").alias("total"))), "node")


def weighted_slots(adj: DataFrame, chunk: int = GROUP_CHUNK, weight: str = "weight", far: bool = True) -> DataFrame:
    """``node, slot, lo, hi, nbr, degree, nbr_degree``: draws by weight in constant expected time.

    The 60-bit range is divided among the neighbours by weight (``lo <= draw < hi``), and also into
    ``degree`` equal slots. A neighbour is listed in each slot that its range touches, fewer than
    two rows per neighbour on average, so a draw is an equi-join on (node, slot) and a filter.
    """
    numbered = number_in_groups(whole_weights(adj, weight), "node", "nbr", "degree", weight="w", chunk=chunk)
    total, full = F.col("total").cast("double"), F.lit(float(TWO_60))
    bound = lambda upto: F.ceil(upto.cast("double") / total * full).cast("bigint")
    ranged = numbered.select(
        "node", "nbr", "degree", bound(F.col("weight_before")).alias("lo"), bound(F.col("weight_before") + F.col("w")).alias("hi"),
    ).filter("lo < hi")
    slots = F.sequence(scaled(F.col("lo"), F.col("degree")), scaled(F.col("hi") - 1, F.col("degree")))
    spread = ranged.select("node", F.explode(slots).alias("slot"), "lo", "hi", "nbr", "degree")
    if not far:
        return spread
    return _with_nbr_degree(spread, group_totals(adj.filter(F.col(weight) > 0), "node").select("node", F.col("group_size").alias("degree")))


def slot_probability(slots: DataFrame) -> DataFrame:
    """The neighbour probabilities that a weighted draw table stands for."""
    return slots.select("node", "nbr", "lo", "hi").distinct().select(
        "node", "nbr", ((F.col("hi") - F.col("lo")) / F.lit(float(TWO_60))).alias("probability")
    )


def sentence_budget(nodes: DataFrame, sentence_length: int, factor: int = 1000) -> DataFrame:
    return nodes.agg(
        F.floor(F.count(F.lit(1)) * F.lit(factor) / F.lit(sentence_length)).cast("bigint").alias("n_sentences")
    )


def neighbours(adj: DataFrame, node: str) -> DataFrame:
    return adj.filter(F.col("node") == node).select("nbr", "weight")


def grow(edges: DataFrame, batch: DataFrame, types: NodeTypes, flatten=(), delta_tokens: bool = True):
    """Add a batch of edges. Returns all edges, the root nodes touched, and the largest row number.

    Without ``delta_tokens`` only whole values count as touched, not the words they are split into.
    """
    merged = edges.unionByName(batch, allowMissingColumns=True)
    touched = node_catalog(batch, types, flatten if delta_tokens else ())
    max_rid = merged.select(F.explode(F.array("src", "dst")).alias("node")).filter(
        F.col("node").startswith("idx__")
    ).agg(F.max(node_name(F.col("node")).try_cast("bigint")).alias("max_rid"))
    return merged, roots(touched), max_rid
