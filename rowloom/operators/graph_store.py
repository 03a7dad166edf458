"""A graph that grows by batches, stored as tables by version.

A batch adds its pairs of nodes, numbered with a version; of a pair the row of the newest version counts.
Draw slots are built anew only for nodes whose neighbours or weights changed, under the same version, and
a node's newest version names the slots that count. So a batch groups, sorts and numbers only what it
touches; the tables of all other nodes are read as they are. After ``merge_every`` batches everything
is written as one version, so that no more versions than that are ever read.

A record's edges count once, however often it arrives, and the last edge of a pair sets the weight. A version
that is added again replaces itself, as long as no later one was added. Rows become valid with the manifest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators.graph import both_ways, first_bag, flattened_edges, same_both_ways, uniform_slots, weighted_slots
from rowloom.operators.numbering import GROUP_CHUNK
from rowloom.operators.walks import WalkTables, start_tables
from rowloom.options import NodeTypes
from rowloom.session import freeze, shuffle_partitions
from rowloom.sources.readers import path_exists, stored_versions

_MANIFEST = "version bigint, since bigint, weighted boolean, batches int"


@dataclass(frozen=True)
class _State:
    """Rows of versions ``since`` to ``until`` make up the graph. Versions are doubled, odd ones are merged."""

    since: int = 0
    until: int = -1
    weighted: bool = False
    batches: int = 0


class GraphStore:
    def __init__(
        self, spark: SparkSession, path: str, types: NodeTypes, flatten="tt", sampler: str = "auto",
        merge_every: int = 8, chunk: int = GROUP_CHUNK,
    ) -> None:
        if merge_every < 1:
            raise ValueError("merge_every must be positive")
        self.spark = spark
        self.path = path
        self.types = types
        self.flatten = flatten
        self.sampler = sampler
        self.merge_every = merge_every
        self.chunk = chunk

    # --- stored tables ---

    def _state(self, before: int | None = None) -> _State:
        versions = [v for v in stored_versions(self.spark, f"{self.path}/manifest") if before is None or v < before]
        if not versions:
            return _State()
        row = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/version={max(versions)}").first()
        return _State(row.since, 2 * max(versions) + 1, row.weighted, row.batches)

    def _live(self, name: str, state: _State, schema: str) -> DataFrame:
        """All rows of the versions in use. The folder names are the version column."""
        folder = f"{self.path}/{name}"
        if state.until < 0 or not path_exists(self.spark, folder):
            return self.spark.createDataFrame([], f"{schema}, version bigint")
        read = self.spark.read.schema(f"{schema}, version bigint").option("basePath", folder).parquet(folder)
        return read.filter((F.col("version") >= state.since) & (F.col("version") <= state.until))

    def _write(self, df: DataFrame, name: str, version: int) -> DataFrame:
        target = f"{self.path}/{name}/version={version}"
        df.write.mode("overwrite").parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def _pairs(self, state: _State, seq: str | None = None) -> DataFrame:
        """The rows of all pairs; ``seq`` is the type of the order of edges, as stored before by default."""
        if seq is None:
            version = next(v for v in stored_versions(self.spark, f"{self.path}/pairs") if state.since <= v <= state.until)
            seq = self.spark.read.parquet(f"{self.path}/pairs/version={version}").schema["seq"].dataType.simpleString()
        return self._live("pairs", state, f"node string, nbr string, seq {seq}, weight double, n_edges bigint, changed boolean")

    def _slots(self, state: _State) -> DataFrame:
        bounds = "lo bigint, hi bigint, " if state.weighted else ""
        return self._live("slots", state, f"node string, slot bigint, {bounds}nbr string")

    def _nodes(self, state: _State) -> DataFrame:
        """``node, version, degree``, as of each node's newest version."""
        rows = self._live("nodes", state, "node string, degree bigint")
        return rows.groupBy("node").agg(F.max(F.struct("version", "degree")).alias("n")).select("node", "n.version", "n.degree")

    def adjacency(self) -> DataFrame:
        """``node, nbr, weight, n_edges`` of the whole graph."""
        state = self._state()
        if state.until < 0:
            return self.spark.createDataFrame([], "node string, nbr string, weight double, n_edges bigint")
        return _newest(self._pairs(state)).select("node", "nbr", "weight", "n_edges")

    def degrees(self) -> DataFrame:
        """``node, degree``: from how many neighbours a draw chooses."""
        return self._nodes(self._state()).select("node", "degree")

    # --- growth ---

    def add(self, edges: DataFrame, version: int) -> DataFrame:
        """Add the edges of a batch; returns the nodes whose draws changed."""
        before = self._state(version)
        facts = edges.agg(F.min("edge_seq.rid").alias("rid"), same_both_ways().alias("uniform")).first()
        weighted = before.weighted or self.sampler == "weighted" or (self.sampler == "auto" and not facts.uniform)
        delta = freeze(self._delta(edges, before, version, facts.rid))
        seq = delta.schema["seq"].dataType.simpleString()
        keys = delta.select("node", "nbr")
        old = self._pairs(before, seq).join(keys, ["node", "nbr"], "left_semi")
        old = _newest(old).select("node", "nbr", "seq", "weight", "n_edges", F.col("weight").alias("was"))
        both = old.unionByName(delta.withColumn("was", F.lit(None).cast("double")))
        merged = both.groupBy("node", "nbr").agg(
            F.max(F.struct("seq", "weight")).alias("m"), F.sum("n_edges").alias("n_edges"), F.max("was").alias("was"))
        # a new neighbour changes the draws of its node; another weight only where draws go by weight
        changed = F.col("was").isNull() | (F.lit(weighted) & (F.col("was") != F.col("m.weight")))
        merged = merged.select("node", "nbr", "m.seq", "m.weight", "n_edges", changed.alias("changed"))
        state = _State(before.since, 2 * version, weighted, before.batches + 1)
        touched = self._write(merged, "pairs", 2 * version).filter("changed").select("node").distinct()
        pairs = self._pairs(state, seq)
        if weighted == before.weighted:
            pairs = pairs.join(touched, "node", "left_semi")
        else:  # from here on draws go by weight, so the slots of all nodes are made anew
            touched = pairs.select("node").distinct()
        self._write_slots(_newest(pairs), weighted, 2 * version)
        if state.batches >= self.merge_every:
            state = self._merge(state, version)
        manifest = self.spark.createDataFrame([(version, state.since, weighted, state.batches)], _MANIFEST)
        self._write(manifest.coalesce(1), "manifest", version)
        self._forget(before.since)
        return touched

    def _delta(self, edges: DataFrame, before: _State, version: int, least_rid: int | None) -> DataFrame:
        """``node, nbr, seq, weight, n_edges`` of a batch; edges of records that were seen before count 0."""
        rids = self._write(edges.select("edge_seq.rid").distinct(), "rids", version)
        place = [F.col(f"edge_seq.{f}").alias(f) for f in ("rid", "col", "pos", "sub", "side")]
        last = F.max_by(F.struct("edge_seq", "w_fwd", "w_back"), "edge_seq").alias("e")
        one = edges.select("*", *place).groupBy("rid", "col", "pos", "sub", "side", "src", "dst").agg(last)
        flat = flattened_edges(one.select("e.edge_seq", "src", "dst", "e.w_fwd", "e.w_back"), self.types, self.flatten, directed_back_edge=True)
        earlier = [v for v in stored_versions(self.spark, f"{self.path}/rids") if v < version]
        fresh = F.lit(1).cast("bigint")
        if earlier and before.until >= 0 and least_rid is not None:
            # ids rise from batch to batch, so the files of old records are skipped by their statistics
            seen = self.spark.read.schema(rids.schema).parquet(*(f"{self.path}/rids/version={v}" for v in earlier))
            seen = seen.filter(F.col("rid") >= F.lit(least_rid)).join(rids, "rid", "left_semi").distinct().select(F.col("rid").alias("seen"))
            flat = flat.join(seen, F.col("edge_seq.rid") == F.col("seen"), "left")
            fresh = F.col("seen").isNull().cast("bigint")
        both = both_ways(flat.withColumn("fresh", fresh), "fresh")
        return both.groupBy("node", "nbr").agg(
            F.max(F.struct(F.struct("edge_seq", "way").alias("seq"), "weight")).alias("m"), F.sum("fresh").alias("n_edges")
        ).select("node", "nbr", "m.seq", "m.weight", "n_edges")

    def _write_slots(self, adj: DataFrame, weighted: bool, version: int) -> None:
        adj = freeze(adj.select("node", "nbr", "weight"))
        slots = weighted_slots(adj, self.chunk, far=False) if weighted else uniform_slots(adj, self.chunk, far=False)
        self._write(slots.drop("degree"), "slots", version)
        counted = adj.filter(F.col("weight") > 0) if weighted else adj
        self._write(counted.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "nodes", version)

    def _merge(self, state: _State, version: int) -> _State:
        """Write what counts as one version; earlier ones are read no more."""
        merged = 2 * version + 1
        pairs = _newest(self._pairs(state)).withColumn("changed", F.lit(False))
        nodes = self._nodes(state)
        slots = self._slots(state).join(nodes.drop("degree"), ["node", "version"]).drop("version")
        self._write(pairs.select("node", "nbr", "seq", "weight", "n_edges", "changed"), "pairs", merged)
        self._write(slots, "slots", merged)
        self._write(nodes.drop("version"), "nodes", merged)
        return _State(merged, merged, state.weighted, 0)

    def _forget(self, since: int) -> None:
        """Delete versions that even a repetition of the last batch doesn't read."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in ("pairs", "slots", "nodes"):
            for old in stored_versions(self.spark, f"{self.path}/{name}"):
                if old < since:
                    folder = path(f"{self.path}/{name}/version={old}")
                    folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    # --- walks ---

    def walk_tables(self, roots: DataFrame) -> WalkTables:
        """Draw tables of the whole graph, and start draws of the nodes in ``roots``."""
        state = self._state()
        nodes = freeze(self._nodes(state))
        slots = self._slots(state).join(nodes.select("node", "version"), ["node", "version"]).drop("version")
        far = nodes.select(F.col("node").alias("nbr"), F.col("degree").alias("nbr_degree"))
        parts = shuffle_partitions(self.spark)
        slots = freeze(slots.join(far, "nbr", "left").repartition(parts, "node", "slot").sortWithinPartitions("node", "slot"))
        near = _newest(self._pairs(state).join(roots.select("node").distinct(), "node", "left_semi"))
        starts, bag = start_tables(first_bag(near, self.types), self.chunk)
        return WalkTables(slots, starts, nodes.select("node", "degree"), bag, state.weighted)


def _newest(pairs: DataFrame) -> DataFrame:
    value = F.max(F.struct("version", "seq", "weight", "n_edges")).alias("p")
    return pairs.groupBy("node", "nbr").agg(value).select("node", "nbr", "p.version", "p.seq", "p.weight", "p.n_edges")
