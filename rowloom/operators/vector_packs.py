"""Search of all vectors in all others, with nothing written per pair.

Some thousand vectors of neighbouring blocks make one row, a pack. Packs are written once; every pair of a pack of
queries and a pack of vectors then meets in a task that reads both, so what lies on disk grows with the vectors,
however many blocks their queries have to visit. Which blocks a query visits is found where the packs meet, from the
pivots and rings of the cells (:mod:`~rowloom.operators.vector_cells`) that come with the pack. A task keeps the best of
each query over all the packs that it reads, and returns only these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.operators.vector_cells import BLOCK_BITS, MAX_PIVOTS, ROUNDED, SCORE_DIGITS, CellTree, Siblings, normal, tiles
from rowloom.session import freeze, shuffle_partitions

# vectors of a pack, queries of a pack, and packs of vectors that a task reads
PACK_ROWS = 4096
ASKED_ROWS = 1024
_TASK_PACKS = 32
# candidates are cut to the best when there are more of them than this share of what is kept
_SURPLUS = 0.5
# where more than so many times k vectors of a pack are candidates, its k best are picked at once
_CROWD = 4

_SIBLINGS = "of_pack bigint, nodes binary, cells binary, pivots binary, lo binary, hi binary, n_blocks binary, split binary"
_FOUND = "key string, nbr string, score double"


def packs(df: DataFrame, numbers: dict[str, type], by: str, n: int, rows: int) -> DataFrame:
    """``pack, keys, vectors`` and the columns ``numbers``, each the bytes of an array; rows stand in the order of ``by``, then key."""
    laid = df.select(by, "key", "vector", *(c for c in numbers if c != by)).repartitionByRange(max(1, math.ceil(n / rows)), by, "key")
    laid = laid.sortWithinPartitions(by, "key")

    def pack(batches):
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        whole = pd.concat(parts, ignore_index=True)  # a partition is about one pack
        for no, at in enumerate(np.array_split(np.arange(len(whole)), max(1, round(len(whole) / rows)))):
            part = whole.iloc[at]
            blobs = {c: [part[c].to_numpy(dtype=kind).tobytes()] for c, kind in numbers.items()}
            vectors = np.array(part["vector"].tolist(), dtype=np.float32).tobytes()
            yield pd.DataFrame({"pack": [(TaskContext.get().partitionId() << 24) + no], "keys": [part["key"].tolist()], "vectors": [vectors], **blobs})

    columns = "".join(f", {c} binary" for c in numbers)
    return freeze(laid.mapInPandas(pack, f"pack bigint, keys array<string>, vectors binary{columns}"))


def corpus_packs(tree: CellTree, right: DataFrame, n: int) -> DataFrame:
    """Packs of ``key, vector, block``, each with the cells below the first level that its blocks' ways lead through, and their siblings."""
    plain = packs(right, {"block": np.int64}, "block", n, PACK_ROWS)
    if not tree.levels:
        return plain
    below = None
    for level in tree.levels:
        below = level if below is None else below.unionByName(level)

    def ways(batches):
        for batch in batches:
            for no, blocks in zip(batch["pack"], batch["block"]):
                nodes = _nodes(np.frombuffer(blocks, np.int64) >> BLOCK_BITS)
                yield pd.DataFrame({"pack": no, "node": nodes})

    def gather(no: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(["node", "cell"])
        blob = lambda c, kind: [cells[c].to_numpy(dtype=kind).tobytes()]
        return pd.DataFrame({
            "of_pack": [no[0]], "nodes": blob("node", np.int64), "cells": blob("cell", np.int64),
            "pivots": [np.array(cells["pivot"].tolist(), dtype=np.float32).tobytes()], "lo": blob("lo", float), "hi": blob("hi", float),
            "n_blocks": blob("n_blocks", np.int64), "split": blob("split", bool)})

    nodes = plain.select("pack", "block").mapInPandas(ways, "pack bigint, node bigint")
    siblings = nodes.join(below, "node").groupBy("pack").applyInPandas(gather, _SIBLINGS)
    return freeze(plain.join(siblings, F.col("pack") == F.col("of_pack"), "left").drop("of_pack"))


def _nodes(cells: np.ndarray) -> np.ndarray:
    """The cells above the given ones, at all levels."""
    found, cells = [], np.unique(cells)
    while len(cells := np.unique(cells[cells >= MAX_PIVOTS] // MAX_PIVOTS - 1)):
        found.append(cells)
    return np.concatenate(found) if found else cells


def search(asked: DataFrame, corpus: DataFrame, tree: CellTree, k: int, metric: str, floor: float | None, probes: int | None) -> DataFrame:
    """``key, nbr, score``: of each query the k best of every task in the blocks other than its home, if none is better than ``worst``.

    ``asked``: packs with ``home`` and ``worst`` (NaN: not known). ``corpus``: :func:`corpus_packs`.
    """
    n_asked, n_packs = asked.count(), corpus.count()
    per_task = min(n_packs, math.ceil(shuffle_partitions(asked.sparkSession) / max(1, n_asked)))
    tasks = max(1, math.ceil(n_packs / _TASK_PACKS), per_task)
    top, deep = tree.top, bool(tree.levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}
                if at is None or at.no != row["q_pack"].as_py():
                    if at is not None:
                        yield at.result()
                    at = _Asked(row, top, k, metric, floor, probes)
                at.compare(row, deep)
        if at is not None:
            yield at.result()

    left = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("pack", "keys", "vectors")], "home", "worst")
    # every task reads its packs of vectors again for each pack of queries
    return left.hint("shuffle_replicate_nl").crossJoin(corpus.coalesce(tasks)).mapInArrow(run, _FOUND)


def _numbers(value: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=kind)


def _rows(value: pa.Scalar, n: int, metric: str) -> np.ndarray:
    return normal(_numbers(value, np.float32).reshape(n, -1).astype(np.float64), metric)


class _Asked:
    """A pack of queries, and the best found for each so far."""

    def __init__(self, row: dict, top: Siblings, k: int, metric: str, floor: float | None, probes: int | None):
        self.no, self.keys = row["q_pack"].as_py(), row["q_keys"].values
        self.top, self.k, self.metric, self.floor, self.probes = top, k, metric, floor, probes
        n = len(self.keys)
        self.vectors = _rows(row["q_vectors"], n, metric)
        self.home = _numbers(row["home"], np.int64)
        worst = _numbers(row["worst"], np.float64)
        self.worst = np.where(np.isnan(worst), -np.inf, worst)
        self.chosen = None if probes is None else _chosen(top, self.vectors, probes)
        nothing = np.zeros(0, np.int64)
        self.best = (nothing, np.zeros(0), np.zeros(0, object))  # row, score, name
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def compare(self, row: dict, deep: bool) -> None:
        names = row["keys"].values
        blocks, block_no = np.unique(_numbers(row["block"], np.int64), return_inverse=True)
        cells, cell_no = np.unique(blocks >> BLOCK_BITS, return_inverse=True)
        below = _below(row, self.metric) if deep and row["cells"].is_valid else {}
        open_cells = self._open(cells, below)
        if not open_cells.any():
            return
        vectors = _rows(row["vectors"], len(names), self.metric)
        for part in tiles(len(self.home), len(names)):
            asked = open_cells[part][:, cell_no] & (blocks[None, :] != self.home[part][:, None])
            rows, used = np.flatnonzero(asked.any(1)), asked.any(0)[block_no]
            if len(rows) == 0:
                continue
            cols = slice(None) if used.all() else np.flatnonzero(used)
            scores = _raw(self.vectors[part][rows], vectors[cols], self.metric)
            asked = asked[rows]
            if not asked.all():
                scores[~asked[:, block_no[cols]]] = -np.inf
            self._keep(rows + part.start, scores, names, np.arange(len(names))[cols])
            if sum(len(f[0]) for f in self.fresh) > _SURPLUS * self.k * len(self.home):
                self._cut()

    def _open(self, cells: np.ndarray, below: dict[int, Siblings]) -> np.ndarray:
        """Which queries may find something in which cells: all cells on the way there must be open."""
        out = np.ones((len(self.home), len(cells)), bool)
        above = cells // MAX_PIVOTS - 1  # -1: a cell of the first level
        deep = np.flatnonzero(above >= 0)
        if len(deep):
            nodes, at = np.unique(above[deep], return_inverse=True)
            out[:, deep] = self._open(nodes, below)[:, at]
        for node in np.unique(above):
            here = np.flatnonzero(above == node)
            siblings = self.top if node < 0 else below[int(node)]
            at = np.searchsorted(siblings.cells, cells[here])
            few = siblings.take(at)
            limit = few.limits(self.worst, self.floor)
            for part in tiles(len(self.home), len(here)):
                found = few.may_hold(few.distances(self.vectors[part]), limit[part])
                if self.probes is not None:
                    found &= (self.chosen[part] if node < 0 else _chosen(siblings, self.vectors[part], self.probes))[:, at]
                out[part, here] &= found
        return out

    def _keep(self, rows: np.ndarray, scores: np.ndarray, names: pa.Array, cols: np.ndarray) -> None:
        """Candidates that score as much as the k-th found before them, as scores are rounded."""
        limit, n = self.worst[rows] - ROUNDED, scores.shape[1]
        hits = scores >= limit[:, None]
        many = np.flatnonzero(hits.sum(1) > _CROWD * self.k)
        if len(many) and n > self.k:
            kth = np.partition(np.nan_to_num(scores[many], nan=-np.inf), n - self.k, axis=1)[:, n - self.k]
            hits[many] &= scores[many] >= (kth - 2 * ROUNDED)[:, None]
        at, col = np.nonzero(hits & np.isfinite(scores))
        score = _rounded(scores[at, col], self.metric)
        good = score >= self.worst[rows[at]]
        if self.floor is not None:
            good &= score > self.floor
        if good.any():
            name = names.take(pa.array(cols[col[good]])).to_numpy(zero_copy_only=False)
            self.fresh.append((rows[at[good]], score[good], name))

    def _cut(self) -> None:
        """The k best of each query stay, of equal ones those of the first names."""
        if not self.fresh:
            return
        rows, score, name = (np.concatenate(x) for x in zip(self.best, *self.fresh))
        self.fresh = []
        by_name = np.unique(name.astype(str), return_inverse=True)[1]
        order = np.lexsort((by_name, -score, rows))
        rows, score, name = rows[order], score[order], name[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        kept = place < self.k
        last = place == self.k - 1
        self.worst[rows[last]] = np.maximum(self.worst[rows[last]], score[last])
        self.best = (rows[kept], score[kept], name[kept])

    def result(self) -> pa.RecordBatch:
        self._cut()
        rows, score, name = self.best
        return pa.RecordBatch.from_arrays(
            [self.keys.take(pa.array(rows)).cast(pa.string()), pa.array(name, pa.string()), pa.array(score, pa.float64())], names=["key", "nbr", "score"])


def _raw(q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """Scores before they are rounded."""
    if metric == "cosine":
        return q @ r.T
    return -((q * q).sum(1)[:, None] + (r * r).sum(1)[None, :] - 2 * q @ r.T)


def _rounded(scores: np.ndarray, metric: str) -> np.ndarray:
    return np.round(scores, SCORE_DIGITS) if metric == "cosine" else -np.round(np.maximum(-scores, 0.0), SCORE_DIGITS)


def _chosen(siblings: Siblings, vectors: np.ndarray, probes: int) -> np.ndarray:
    """The nearest ``probes`` cells of each query."""
    out = np.zeros((len(vectors), len(siblings.cells)), bool)
    for part in tiles(len(vectors), len(siblings.cells)):
        out[part] = siblings.nearest(siblings.distances(vectors[part]), probes)
    return out


def _below(row: dict, metric: str) -> dict[int, Siblings]:
    nodes, cells = _numbers(row["nodes"], np.int64), _numbers(row["cells"], np.int64)
    pivots = _rows(row["pivots"], len(cells), metric)
    lo, hi, n_blocks, split = (_numbers(row[c], kind) for c, kind in (("lo", float), ("hi", float), ("n_blocks", np.int64), ("split", bool)))
    ends = np.append(np.flatnonzero(np.diff(nodes, prepend=-1)), len(nodes))
    parts = (slice(a, b) for a, b in zip(ends[:-1], ends[1:]))
    return {int(nodes[p.start]): Siblings(metric, cells[p], pivots[p], lo[p], hi[p], n_blocks[p], split[p]) for p in parts}
