"""A tree of cells of vectors: pivots, pivots of the vectors of a large cell, and so on.

The first level has at most ``MAX_PIVOTS`` cells, whose pivots every task gets. A cell of more than
``SPLIT_BLOCKS`` blocks gets pivots of its own, chosen among its vectors, and so on, so that the cells
stay small at any number of vectors. The pivots below the first level are tables; vectors and queries
go down to them by a shuffle on the cell, in slices of bounded size. Each cell knows the least and the
largest distance of its vectors from its pivot, which bounds what it can hold. What still can't be
told apart after ``MAX_LEVELS`` levels is cut into blocks by hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.hashing import TWO_32, hash32
from rowloom.session import freeze

# rows of a block; two blocks and their products are what one task holds
BLOCK_ROWS = 4096
# pivots of the first level live on the driver and in every task, those of a cell in the tasks of its slices
MAX_PIVOTS = 4096
MAX_LEVELS = 3
SPLIT_BLOCKS = 16
# rows that are compared with the pivots of a cell at once
_SLICE_ROWS = 4096
# numbers of a matrix that is held at once, whatever the number of pivots or vectors
TILE = 1 << 20
BLOCK_BITS = 24
_SLACK = 1e-6
# scores are ranked after rounding, so that engines agree on ties; what rounds to the same may lie that much apart
SCORE_DIGITS = 9
ROUNDED = 10.0**-SCORE_DIGITS

_PLACED = "key string, vector array<float>, cell bigint, radius double"
_VISIT = (
    "key string, vector array<float>, q_block bigint, home bigint, worst double, "
    "t_groups array<bigint>, starts array<bigint>, counts array<bigint>, t_blocks array<bigint>, nodes array<bigint>"
)
_PRIME, _FACTOR = (1 << 31) - 1, 1_103_515_245


def matrix(vectors: pd.Series, metric: str) -> np.ndarray:
    return normal(np.array(vectors.tolist(), dtype=np.float64), metric)


def normal(m: np.ndarray, metric: str) -> np.ndarray:
    """Rows of length one for the cosine; what has no length stays."""
    if metric == "cosine":
        size = np.linalg.norm(m, axis=1, keepdims=True)
        m = m / np.where(size > 0, size, 1.0)
    return m


def group_of(block, n_groups: int):
    """One of ``n_groups`` groups of blocks, by a hash that columns and arrays of numbers share.

    Groups of about ``BLOCK_ROWS`` rows are what is compared, however small the blocks are.
    """
    return block % _PRIME * _FACTOR % _PRIME % n_groups


def tiles(n_rows: int, width: int) -> list[slice]:
    """Slices of rows whose products with ``width`` columns have at most ``TILE`` numbers."""
    step = max(1, TILE // max(1, width))
    return [slice(at, at + step) for at in range(0, n_rows, step)]


@dataclass(frozen=True)
class Siblings:
    """Cells of one parent: ids, pivots, rings of radii, blocks (none: split further, or empty)."""

    metric: str
    cells: np.ndarray
    pivots: np.ndarray
    r_min: np.ndarray
    r_max: np.ndarray
    n_blocks: np.ndarray
    split: np.ndarray

    @classmethod
    def of(cls, metric: str, rows: pd.DataFrame) -> Siblings:
        number = lambda c, t: rows[c].to_numpy(dtype=t)
        return cls(
            metric, number("cell", np.int64), matrix(rows["pivot"], metric), number("lo", float), number("hi", float),
            number("n_blocks", np.int64), number("split", bool),
        )

    def distances(self, m: np.ndarray) -> np.ndarray:
        square = (m * m).sum(1)[:, None] + (self.pivots * self.pivots).sum(1)[None, :] - 2 * m @ self.pivots.T
        return np.sqrt(np.maximum(square, 0.0))

    def assign(self, batch: pd.DataFrame) -> pd.DataFrame:
        """The nearest pivot of each vector; the first of equally near ones."""
        at, radius = np.zeros(len(batch), np.int64), np.zeros(len(batch))
        for part in tiles(len(batch), len(self.cells)):
            distance = self.distances(matrix(batch["vector"].iloc[part], self.metric))
            at[part] = distance.argmin(1)
            radius[part] = distance[np.arange(len(distance)), at[part]]
        return pd.DataFrame({"key": batch["key"], "vector": batch["vector"], "cell": self.cells[at], "radius": radius})

    def take(self, at: np.ndarray) -> Siblings:
        return Siblings(self.metric, self.cells[at], self.pivots[at], self.r_min[at], self.r_max[at], self.n_blocks[at], self.split[at])

    def limits(self, worst: np.ndarray, floor: float | None) -> np.ndarray:
        """The largest distance of something that scores as much as ``worst`` (NaN or minus infinity: not known) and the floor."""
        known = np.isfinite(worst)
        if self.metric != "cosine":
            return np.where(known, np.sqrt(np.maximum(ROUNDED - np.where(known, worst, 0.0), 0.0)), np.inf)
        limit = np.sqrt(np.maximum(2.0 - 2.0 * (np.where(known, worst, -1.5) - ROUNDED), 0.0))
        return limit if floor is None else np.minimum(limit, math.sqrt(max(2.0 - 2.0 * (floor - ROUNDED), 0.0)))

    def used(self) -> np.ndarray:
        return (self.n_blocks > 0) | self.split

    def may_hold(self, distance: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Which cells may hold something within the limit: nothing in a cell is nearer than the ring of radii around its pivot allows."""
        lower = np.maximum(np.maximum(distance - self.r_max[None, :], self.r_min[None, :] - distance), 0.0)
        return (lower <= (limit * (1 + _SLACK) + _SLACK)[:, None]) & self.used()[None, :]

    def nearest(self, distance: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` nearest cells that hold something; the first of equally near ones."""
        at = np.argsort(np.where(self.used()[None, :], distance, np.inf), axis=1, kind="stable")[:, :probes]
        chosen = np.zeros(distance.shape, bool)
        np.put_along_axis(chosen, at, True, axis=1)
        return chosen

    def visits(self, batch: pd.DataFrame, floor: float | None, probes: int | None, n_groups: int) -> Iterator[pd.DataFrame]:
        """One row per query: the blocks to visit, by group, and as ``nodes`` the cells that are split further."""
        for part in tiles(len(batch), max(len(self.cells), int(self.n_blocks.sum()))):
            yield self._visits(batch.iloc[part], floor, probes, n_groups)

    def _visits(self, batch: pd.DataFrame, floor: float | None, probes: int | None, n_groups: int) -> pd.DataFrame:
        distance = self.distances(matrix(batch["vector"], self.metric))
        limit = self.limits(batch["worst"].to_numpy(dtype=np.float64), floor)
        open_cells = self.may_hold(distance, limit)
        if probes is not None:
            open_cells &= self.nearest(distance, probes)
        rows, at = np.nonzero(open_cells)
        counts = np.where(self.split[at], 1, self.n_blocks[at])
        rows, at = np.repeat(rows, counts), np.repeat(at, counts)
        within = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        split = self.split[at]
        target = (self.cells[at] << BLOCK_BITS) + within
        other = ~split & (target != batch["home"].to_numpy()[rows])
        below, nodes = rows[split], self.cells[at[split]]
        rows, target = rows[other], target[other]
        group = group_of(target, n_groups)
        order = np.lexsort((target, group, rows))
        rows, target, group = rows[order], target[order], group[order]
        first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (group[1:] != group[:-1])])) if len(rows) else rows
        counts = np.diff(np.append(first, len(rows)))
        # row i of the batch has the entries ends[i] to ends[i + 1] of the sorted lists
        each = np.arange(len(batch) + 1)
        blocks_at, groups_at, nodes_at = np.searchsorted(rows, each), np.searchsorted(rows[first], each), np.searchsorted(below, each)
        starts = first - blocks_at[rows[first]] + 1
        lists = lambda values, ends: [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
        out = batch[["key", "vector", "q_block", "home", "worst"]].reset_index(drop=True)
        return out.assign(
            t_groups=lists(group[first], groups_at), starts=lists(starts, groups_at), counts=lists(counts, groups_at),
            t_blocks=lists(target, blocks_at), nodes=lists(nodes, nodes_at))


@dataclass(frozen=True)
class CellTree:
    """The first level, and per deeper level a table ``node, cell, pivot, lo, hi, n_blocks, split``."""

    metric: str
    block_rows: int
    top: Siblings
    levels: tuple[DataFrame, ...]
    leaves: DataFrame

    def single(self) -> bool:
        """All vectors are in one block."""
        return not self.levels and int(self.top.n_blocks.sum()) <= 1

    def place(self, queries: DataFrame) -> DataFrame:
        """``key, vector, block, home``: a block of queries, and the block of vectors to search first (-1: none)."""
        rows = freeze(_assigned(queries, self.top))
        done = []
        for level in self.levels:
            parents = level.select("node").distinct()
            done.append(rows.join(parents, F.col("cell") == F.col("node"), "left_anti"))
            below = rows.join(parents, F.col("cell") == F.col("node")).select("node", "key", "vector")
            rows = freeze(_assigned_below(below, level, self.metric))
        for part in done:
            rows = rows.unionByName(part)
        asked = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / self.block_rows).cast("bigint").alias("n_asked"))
        rows = rows.join(self.leaves, "cell", "left").join(asked, "cell")
        home = F.when(F.col("n_blocks") > 0, block_of(F.col("cell"), F.col("n_blocks"), "home")).otherwise(F.lit(-1))
        return rows.select("key", "vector", block_of(F.col("cell"), F.col("n_asked")).alias("block"), home.cast("bigint").alias("home"))

    def targets(self, queries: DataFrame, floor: float | None, probes: int | None, n_groups: int) -> DataFrame:
        """``key, vector, q_block, worst, t_group, t_blocks``: the blocks other than its home that a query must visit, by group.

        ``queries``: ``key, vector, q_block, home, worst``, the last one the score of the k-th found so far.
        """
        top, metric = self.top, self.metric

        def first(batches):
            for batch in batches:
                yield from top.visits(batch, floor, probes, n_groups)

        def deeper(asked: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
            if asked.empty or cells.empty:
                return pd.DataFrame(columns=[c.split()[0] for c in _VISIT.split(", ")])
            return pd.concat(Siblings.of(metric, cells).visits(asked, floor, probes, n_groups), ignore_index=True)

        found = freeze(queries.mapInPandas(first, _VISIT))
        parts = []
        for level in self.levels:
            parts.append(found)
            asked = found.select("key", "vector", "q_block", "home", "worst", F.explode("nodes").alias("node"))
            found = freeze(_with_children(asked, level, deeper, _VISIT))
        for part in parts:
            found = found.unionByName(part)
        by_group = F.inline(F.arrays_zip("t_groups", "starts", "counts")).alias("t_group", "start", "count")
        return found.select("key", "vector", "q_block", "worst", "t_blocks", by_group).withColumn(
            "t_blocks", F.slice("t_blocks", F.col("start").cast("int"), F.col("count").cast("int"))).drop("start", "count")


def block_of(cell: Column, n_blocks: Column, *salt: str) -> Column:
    """A block of the cell, by hash of the key."""
    within = F.shiftright(hash32(F.col("key"), *(salt or ("block",))) * n_blocks, 32)
    return (F.shiftleft(cell.cast("bigint"), BLOCK_BITS) + within).cast("bigint")


def _assigned(df: DataFrame, top: Siblings) -> DataFrame:
    def assign(batches):
        for batch in batches:
            yield top.assign(batch)

    return df.select("key", "vector").mapInPandas(assign, _PLACED)


def _with_children(rows: DataFrame, level: DataFrame, work, schema: str) -> DataFrame:
    """Bring rows (with a ``node``) and the cells below that node together, a slice of rows at a time."""
    slices = freeze(rows.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / _SLICE_ROWS).cast("bigint").alias("n_slices")))
    number = F.shiftright(hash32(F.col("key"), "slice") * F.col("n_slices"), 32).cast("bigint")
    left = rows.join(slices, "node").withColumn("slice", number).drop("n_slices")
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_slices") - 1))
    right = level.join(slices, "node").withColumn("of_slice", copies).withColumnRenamed("node", "of_node").drop("n_slices")
    return left.groupBy("node", "slice").cogroup(right.groupBy("of_node", "of_slice")).applyInPandas(work, schema)


def _assigned_below(rows: DataFrame, level: DataFrame, metric: str) -> DataFrame:
    def assign(part: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if part.empty or cells.empty:
            return pd.DataFrame(columns=["key", "vector", "cell", "radius"])
        bounds = {c: 0 for c in ("lo", "hi", "n_blocks", "split") if c not in cells}
        return Siblings.of(metric, cells.assign(**bounds).sort_values("cell")).assign(part)

    return _with_children(rows, level, assign, _PLACED)


def _sizes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("lo"), F.max("radius").alias("hi"))


def _pivots_below(placed: DataFrame, large: DataFrame, block_rows: int, max_pivots: int) -> DataFrame:
    """``node, cell, pivot``: for each large cell some of its vectors, those of the least hashes."""
    fan = F.least(F.lit(max_pivots), F.ceil(F.col("n") / block_rows))
    draw = hash32(F.col("key"), "pivot")
    # about twice as many as needed are sorted, whatever the cell holds
    few = placed.join(large.select("cell", "n"), "cell").filter(
        draw.cast("double") * F.col("n") < (2 * fan + 64) * F.lit(float(TWO_32)))
    no = F.row_number().over(Window.partitionBy("cell").orderBy(draw, "key"))
    few = few.select("cell", "vector", fan.alias("fan"), no.alias("no")).filter("no <= fan")
    return few.select(
        F.col("cell").alias("node"), ((F.col("cell") + 1) * MAX_PIVOTS + F.col("no") - 1).alias("cell"), F.col("vector").alias("pivot"))


def build(corpus: DataFrame, metric: str, block_rows: int = BLOCK_ROWS, max_pivots: int = MAX_PIVOTS) -> tuple[CellTree, DataFrame]:
    """The tree of distinct vectors ``key, vector``, and the vectors as ``key, vector, block``."""
    if not 1 <= max_pivots <= MAX_PIVOTS:
        raise ValueError(f"pivots must be 1 to {MAX_PIVOTS}")
    n = corpus.count()
    wanted = max(1, min(max_pivots, math.ceil(n / block_rows)))
    # a top-n by hash: bounded by MAX_PIVOTS rows
    chosen = corpus.orderBy(hash32(F.col("key")), "key").limit(wanted).toPandas()
    pivots = matrix(chosen["vector"], metric) if len(chosen) else np.zeros((1, 1))
    n_top = len(pivots)
    nothing = np.zeros(n_top)
    placed = freeze(_assigned(corpus, Siblings(metric, np.arange(n_top), pivots, nothing, nothing, nothing, nothing)))
    sizes = freeze(_sizes(placed))
    r_min, r_max, n_blocks = np.full(n_top, np.inf), np.full(n_top, -np.inf), np.zeros(n_top, np.int64)
    for row in sizes.collect():  # one row per pivot of the first level
        r_min[row.cell], r_max[row.cell], n_blocks[row.cell] = row.lo, row.hi, math.ceil(row.n / block_rows)

    parts, levels = [], []
    split = np.zeros(n_top, bool)
    leaves = sizes.select("cell", F.ceil(F.col("n") / block_rows).cast("bigint").alias("n_blocks"))
    for _ in range(MAX_LEVELS - 1):
        large = sizes.filter(F.col("n") > SPLIT_BLOCKS * block_rows)
        if large.isEmpty():
            break
        below = freeze(_pivots_below(placed, large, block_rows, max_pivots))
        parents = freeze(below.select("node").distinct())
        is_parent = F.col("cell") == F.col("node")
        if levels:
            marked = levels[-1].drop("split").join(parents.select(F.col("node").alias("cell"), F.lit(True).alias("split")), "cell", "left")
            levels[-1] = freeze(marked.withColumn("split", F.coalesce("split", F.lit(False))))
        else:
            split[[r.node for r in parents.collect()]] = True  # at most one row per pivot of the first level
        parts.append(placed.join(parents, is_parent, "left_anti"))
        rows = placed.join(parents, is_parent).select("node", "key", "vector")
        placed = freeze(_assigned_below(rows, below, metric))
        sizes = freeze(_sizes(placed))
        count = F.coalesce(F.ceil(F.col("n") / block_rows).cast("bigint"), F.lit(0).cast("bigint"))
        levels.append(freeze(below.join(sizes, "cell", "left").select(
            "node", "cell", "pivot", F.coalesce("lo", F.lit(float("inf"))).alias("lo"), F.coalesce("hi", F.lit(float("-inf"))).alias("hi"),
            count.alias("n_blocks"), F.lit(False).alias("split"))))
        leaves = leaves.join(parents, is_parent, "left_anti").unionByName(
            sizes.select("cell", F.ceil(F.col("n") / block_rows).cast("bigint").alias("n_blocks")))
    for part in parts:
        placed = placed.unionByName(part)
    leaves = freeze(leaves) if levels else leaves
    tree = CellTree(metric, block_rows, Siblings(metric, np.arange(n_top), pivots, r_min, r_max, n_blocks, split), tuple(levels), leaves)
    blocked = placed.join(leaves, "cell").select("key", "vector", block_of(F.col("cell"), F.col("n_blocks")).alias("block"))
    return tree, blocked
