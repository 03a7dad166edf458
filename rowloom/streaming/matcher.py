"""Continuous matching: windows to edges, walks, vectors, neighbours and similarity lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators import embed
from rowloom.operators.cells import cells
from rowloom.operators.edges import edge_list
from rowloom.operators.graph import node_catalog, roots
from rowloom.operators.graph_store import GraphStore
from rowloom.operators.knn import knn, mixed_neighbours, record_vectors
from rowloom.operators.match import flat_list, from_source, merge_lists, symmetric
from rowloom.operators.walks import random_walks, spread_walks
from rowloom.options import GraphOptions, StreamOptions, TrainOptions, WalkOptions
from rowloom.session import freeze
from rowloom.sources.readers import stored_versions
from rowloom.sources.writers import latest_list, upsert_list, write_list


class StreamMatcher:
    """Handler for :class:`~rowloom.streaming.buffer.WindowBuffer`.

    For the due windows of a micro-batch: edges with frequencies per window are added to the stored
    graph (:class:`~rowloom.operators.graph_store.GraphStore`), walks start at the root nodes touched, the model is trained on from its last version,
    and the similarity lists of the records in the windows, and of their neighbours, are renewed.
    All steps are set-based, also over several windows, and stored by version.
    """

    def __init__(
        self, spark: SparkSession, state_path: str, options: StreamOptions,
        graph: GraphOptions = GraphOptions(flatten="tt"), walk: WalkOptions = WalkOptions(backtrack=False),
        training: TrainOptions = TrainOptions(window=3), cols: list[str] | None = None, delta_tokens: bool = True,
        first_epochs: int = 10, later_epochs: int = 5,
    ) -> None:
        self.spark = spark
        self.path = state_path
        self.options = options
        self.graph = graph
        self.walk = walk
        self.training = training
        self.cols = cols
        self.delta_tokens = delta_tokens
        self.first_epochs = first_epochs
        self.later_epochs = later_epochs
        self.store = GraphStore(spark, f"{state_path}/graph", graph.node_types, graph.flatten, walk.sampler)

    # --- stored tables ---

    def edges(self) -> DataFrame:
        """All edges so far, with the version that they came in."""
        return self.spark.read.option("basePath", f"{self.path}/edges").parquet(f"{self.path}/edges")

    def model(self, before: int | None = None) -> DataFrame | None:
        """The newest model version."""
        versions = stored_versions(self.spark, f"{self.path}/model")
        usable = [v for v in versions if before is None or v < before]
        return self.spark.read.parquet(f"{self.path}/model/version={max(usable)}") if usable else None

    def similarity(self) -> DataFrame:
        """``id, word, score, rank`` of the current lists."""
        return flat_list(latest_list(self.spark, f"{self.path}/lists"))

    def snapshot(self, path: str) -> None:
        write_list(self.similarity(), path, self.options.output_format)

    # --- steps ---

    def __call__(self, windows: DataFrame, version: int) -> None:
        fresh = self._extend_graph(windows, version)
        vectors = self._train(self._walks(fresh), version)
        targets = windows.select(F.col("rid").alias("key")).distinct()
        self._match(vectors, targets, version)

    def _extend_graph(self, windows: DataFrame, version: int) -> DataFrame:
        """Store the edges of the windows and add them to the graph; returns them."""
        data = self.cols or [c for c in windows.columns if c not in ("rid", "rid_no", "seq", "window", "version", "timestamp")]
        table = cells(windows, cols=data, carry=("window",))
        target = f"{self.path}/edges/version={version}"
        edge_list(table, self.options.smoothing, window="window").write.mode("overwrite").parquet(target)
        fresh = self.spark.read.parquet(target)
        self.store.add(fresh, version)
        return fresh

    def _walks(self, fresh: DataFrame) -> DataFrame:
        types = self.graph.node_types
        delta = freeze(roots(node_catalog(fresh, types, self.graph.flatten if self.delta_tokens else ())))
        tables = self.store.walk_tables(delta)
        return freeze(random_walks(spread_walks(delta, self.options.walks_per_node), tables, types, self.walk))

    def _train(self, walks: DataFrame, version: int) -> DataFrame:
        known = self.model(before=version)
        epochs = self.first_epochs if known is None else self.later_epochs
        options = TrainOptions(**{**self.training.__dict__, "epochs": epochs})
        trained = embed.train(walks, options, known)
        target = f"{self.path}/model/version={version}"
        trained.write.mode("overwrite").parquet(target)
        return freeze(embed.vectors(self.spark.read.parquet(target), self.training))

    def _match(self, vectors: DataFrame, targets: DataFrame, version: int) -> None:
        k, floor = self.options.most_similar_k, self.options.score_floor
        if self.options.strategy == "basic":
            found = mixed_neighbours(vectors, targets, k, floor)
        else:
            records = record_vectors(vectors)
            found = knn(records.join(targets, "key", "left_semi"), records, k=10 * k, floor=floor)
            if self.options.limit_k:
                found = found.filter(F.col("rank") <= k)
        found = from_source(found, self.options.source_num)
        # the order in which a record-by-record run would meet the pairs
        place = F.struct(F.expr("cast(substring(key, 6) as bigint)").alias("rid"), F.col("rank").alias("rank"))
        pairs = symmetric(
            found.select(F.col("key").alias("id"), F.col("nbr").alias("word"), "score", place.alias("seq"))
        )
        pairs = freeze(pairs)
        touched = pairs.select("id").distinct()
        stored = flat_list(
            latest_list(self.spark, f"{self.path}/lists", before=version).join(touched, "id", "left_semi")
        )
        upsert_list(merge_lists(stored, pairs, self.options.list_size), f"{self.path}/lists", version)
