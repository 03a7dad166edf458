"""Queries that train vectors or run whole plans. SQL checks only what it can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.catalog.base import GRAPH_COLS, ORACLES, PART_COLS, query, rounded, table
from rowloom.catalog.graphs import part_adjacency, part_nodes
from rowloom.catalog.matching import label_truth, record_table
from rowloom.catalog.tables import LOG, TYPES
from rowloom.operators import embed
from rowloom.operators import graph as G
from rowloom.operators import walks as W
from rowloom.operators.match import nested_list, similarity_list
from rowloom.options import GraphOptions, MatchOptions, TrainOptions, WalkOptions
from rowloom.plans import batch as B
from rowloom.plans.experiment import list_against_truth

SMALL = dict(dimensions=24, window=3, epochs=2, sampling_factor=0.0, learning_rate=0.05)


def name_walks(spark, sf_dir):
    """The words of each part name as one sentence."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("walk_id"), F.concat(F.split("p_name", " "), F.array("p_brand")).alias("walk")
    )


_WORDS = "words AS (SELECT unnest(list_append(string_split(p_name, ' '), p_brand)) AS key FROM part), vocab AS (SELECT key, count(*) AS occurrences FROM words GROUP BY key HAVING count(*) >= 2)"


@query("vocabulary", f"WITH {_WORDS} SELECT key, occurrences FROM vocab")
def vocabulary(spark, sf_dir):
    return embed.vocabulary(name_walks(spark, sf_dir))


@query(
    "keep_probability",
    f"""WITH {_WORDS}, r AS (SELECT key, occurrences, 0.001 * (SELECT sum(occurrences) FROM vocab) / occurrences AS ratio FROM vocab)
SELECT key, occurrences, {rounded('least(1.0, sqrt(ratio) + ratio)')} AS keep FROM r""",
)
def keep_probability(spark, sf_dir):
    return embed.keep_probability(embed.vocabulary(name_walks(spark, sf_dir)), 0.001)


def _graph_walks(spark, sf_dir, per_root=10):
    tables = W.walk_tables(part_adjacency(spark, sf_dir), TYPES)
    seeds = W.spread_walks(G.roots(part_nodes(spark, sf_dir)), per_root)
    return W.random_walks(seeds, tables, TYPES, WalkOptions(sentence_length=8))


def _trained(spark, sf_dir, **changes):
    options = TrainOptions(**{**SMALL, **changes})
    return embed.train(_graph_walks(spark, sf_dir), options), options


@query("word2vec")
def word2vec(spark, sf_dir):
    return embed.vectors(*_trained(spark, sf_dir))


@query("cbow")
def cbow(spark, sf_dir):
    return embed.vectors(*_trained(spark, sf_dir, method="CBOW"))


@query("subword")
def subword(spark, sf_dir):
    return embed.vectors(*_trained(spark, sf_dir, algorithm="fasttext"))


@query("subword_unknown")
def subword_unknown(spark, sf_dir):
    """Vectors for supplier names, none of which is a node of the graph."""
    model, options = _trained(spark, sf_dir, algorithm="fasttext")
    return embed.subword_vectors(table(spark, sf_dir, "supplier").select(F.concat(F.lit("tt__"), "s_name").alias("key")), model, options)


@query("warm_start")
def warm_start(spark, sf_dir):
    """Train on the words of the names, then go on with walks over the graph."""
    options = TrainOptions(**SMALL)
    first = embed.train(name_walks(spark, sf_dir), options)
    return embed.vectors(embed.train(_graph_walks(spark, sf_dir, 3), options, first), options)


@query("pca")
def pca(spark, sf_dir):
    return embed.reduce_dimensions(record_table(spark, sf_dir).select("key", "vector"), 8)


@query("train_and_match")
def train_and_match(spark, sf_dir):
    """Edges, walks, vectors and matches of two halves of ``part`` in one go."""
    part = table(spark, sf_dir, "part")
    graph = GraphOptions(flatten="tt", smoothing=LOG)
    edges = B.table_edges(part, "p_partkey", list(PART_COLS), graph)
    vectors = B.train_edges(edges, graph, WalkOptions(sentence_length=8, walks_per_node=5), TrainOptions(**SMALL))
    return B.matched_rows(vectors, part.count() // 2, MatchOptions(n_top=10, n_candidates=1))


@query("train_compressed")
def train_compressed(spark, sf_dir):
    graph = GraphOptions(flatten=())
    edges = B.table_edges(table(spark, sf_dir, "part"), "p_partkey", list(GRAPH_COLS), graph)
    walk = WalkOptions(sentence_length=6, walks_per_node=5)
    return B.train_edges(edges, graph, walk, TrainOptions(**SMALL), compression=True)


@query("list_experiment", ORACLES["prf"])
def list_experiment(spark, sf_dir):
    """A stored list of the nearest rows, scored against truth."""
    from rowloom.catalog.matching import near_entries

    near = near_entries(spark, sf_dir).withColumnRenamed("rank", "seq")
    return list_against_truth(nested_list(similarity_list(near, 10)), label_truth(spark, sf_dir), 2, 2)
