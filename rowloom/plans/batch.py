"""Whole runs on tables: edges to graph, walks, vectors, and what is done with these."""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.operators import embed
from rowloom.operators.cells import cells
from rowloom.operators.edges import edge_list
from rowloom.operators.evaluate import eq_report, er_report, odd_one_out, sm_report
from rowloom.operators.graph import (
    adjacency, flattened_edges, is_uniform, node_catalog, require_connected, roots, sentence_budget,
)
from rowloom.operators.knn import knn, record_vectors
from rowloom.operators.match import (
    column_candidates, column_vectors, cross_source_candidates, match_columns, match_pairs,
)
from rowloom.operators.sets import compress_edges, decode_keys, intersecting_nodes, key_dictionary
from rowloom.operators.similar import replacement_probability, similar_nodes
from rowloom.operators.walks import planned_walks, random_walks, roots_or_all, spread_walks, walk_tables
from rowloom.options import GraphOptions, MatchOptions, TrainOptions, WalkOptions
from rowloom.session import freeze
from rowloom.sources.writers import append_result


@dataclass
class Stages:
    """Seconds per stage and counts of one run, for the result row."""

    metrics: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def timed(self, name: str):
        start = time.time()
        yield
        self.metrics[f"time_{name}"] = round(time.time() - start, 3)


def table_edges(df: DataFrame, key: str | None = None, cols: list[str] | None = None, options: GraphOptions = GraphOptions()) -> DataFrame:
    return edge_list(cells(df, key, cols), options.smoothing)


def make_walks(
    edges: DataFrame,
    graph: GraphOptions = GraphOptions(),
    walk: WalkOptions = WalkOptions(),
    shared: DataFrame | None = None,
    similarities: DataFrame | None = None,
    stages: Stages | None = None,
) -> DataFrame:
    """Walks over the graph of an edge list.

    ``shared`` (``value``) limits the starts to nodes of these names, or to all roots when none is
    found. ``similarities`` (``a, b, distance``) are for walks that replace tokens.
    """
    stages = stages or Stages()
    types = graph.node_types
    with stages.timed("graph"):
        nodes = freeze(node_catalog(edges, types, graph.flatten))
        adj = freeze(adjacency(flattened_edges(edges, types, graph.flatten, graph.directed_back_edge)))
        require_connected(nodes, adj)
        weighted = walk.sampler == "weighted" or (walk.sampler == "auto" and not is_uniform(edges).first().is_uniform)
        tables = walk_tables(
            adj, types, weighted,
            numeric_nodes=nodes.filter("is_numeric") if walk.replace_numbers else None,
            similar=replacement_probability(similar_nodes(similarities, nodes)) if similarities is not None else None,
        )
    with stages.timed("walks"):
        starts = roots(nodes)
        if shared is not None:
            starts = roots_or_all(intersecting_nodes(nodes, shared), starts)
        if walk.walks_per_node:
            seeds = spread_walks(starts, walk.walks_per_node)
        else:
            budget = walk.n_sentences or sentence_budget(nodes, walk.sentence_length, walk.representation_factor).first()[0]
            seeds = planned_walks(starts, budget, walk.seed)
        walks = freeze(random_walks(seeds, tables, types, walk))
    return walks


def train_edges(
    edges: DataFrame,
    graph: GraphOptions = GraphOptions(),
    walk: WalkOptions = WalkOptions(),
    training: TrainOptions = TrainOptions(),
    compression: bool = False,
    shared: DataFrame | None = None,
    similarities: DataFrame | None = None,
    stages: Stages | None = None,
) -> DataFrame:
    """``key, vector`` trained on the walks of an edge list; with ``compression`` over coded names."""
    dictionary = None
    if compression:
        dictionary = freeze(key_dictionary(edges))
        edges = compress_edges(edges, dictionary, graph.node_types)
    walks = make_walks(edges, graph, walk, shared, similarities, stages)
    trained = train_walks(walks, training, stages)
    return trained if dictionary is None else decode_keys(trained, dictionary)


def train_walks(walks: DataFrame, training: TrainOptions = TrainOptions(), stages: Stages | None = None) -> DataFrame:
    stages = stages or Stages()
    with stages.timed("training"):
        return freeze(embed.vectors(embed.train(walks, training), training))


def row_candidates(vectors: DataFrame, n_items: int, options: MatchOptions = MatchOptions()) -> DataFrame:
    """Cross-source candidates of all rows, by the search that ``indexing`` names."""
    records = record_vectors(vectors)
    near = {
        "basic": lambda: knn(records, k=options.n_top),
        "faiss": lambda: knn(records, k=options.n_top * 10, metric="l2"),
        "annoy": lambda: knn(records, k=options.n_top, probes=options.probes),
        "ngt": lambda: knn(records, k=options.n_top, probes=options.probes),
    }[options.indexing]()
    return cross_source_candidates(near, n_items, options.n_candidates)


def test_rows(vectors: DataFrame, truth: DataFrame, n_items: int, options: MatchOptions = MatchOptions()) -> DataFrame:
    found = freeze(row_candidates(vectors, n_items, options))
    return er_report(found, record_vectors(vectors).select("key"), truth, n_items, options.n_top)


def run_rows(
    edges: DataFrame,
    truth: DataFrame,
    n_items: int,
    results: str,
    graph: GraphOptions = GraphOptions(),
    walk: WalkOptions = WalkOptions(),
    training: TrainOptions = TrainOptions(),
    match: MatchOptions = MatchOptions(),
    **train,
) -> DataFrame:
    """Train on an edge list, test the row matches, and append one row on the run to the table ``results``.

    The row holds all options, the seconds of each stage, and the scores. ``train`` goes to :func:`train_edges`.
    """
    stages = Stages()
    vectors = train_edges(edges, graph, walk, training, stages=stages, **train)
    with stages.timed("test"):
        report = freeze(test_rows(vectors, truth, n_items, match))
    options = {"graph": graph, "walk": walk, "training": training, "match": match}
    parameters = {f"{kind}.{name}": value for kind, o in options.items() for name, value in vars(o).items()}
    append_result(edges.sparkSession, results, parameters, stages.metrics, report)
    return report


def matched_rows(vectors: DataFrame, n_items: int, options: MatchOptions = MatchOptions()) -> DataFrame:
    """``left, right`` ids of matched rows."""
    pairs = match_pairs(row_candidates(vectors, n_items, options))
    name = lambda c: F.concat(F.lit("idx__"), F.col(c).cast("string"))
    return pairs.select(name("lo").alias("left"), name("hi").alias("right"))


def matched_columns(vectors: DataFrame, columns: list[str], truth: DataFrame | None = None, max_rank: int = 3) -> DataFrame:
    return match_columns(column_candidates(column_vectors(vectors, truth), columns), max_rank)


def test_columns(vectors: DataFrame, columns: list[str], truth: DataFrame, max_rank: int = 3) -> DataFrame:
    return sm_report(matched_columns(vectors, columns, truth, max_rank), truth)


def test_quality(vectors: DataFrame, tests: DataFrame) -> DataFrame:
    return eq_report(odd_one_out(tests, vectors))
