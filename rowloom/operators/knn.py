"""Exact and approximate nearest neighbours without comparing all pairs.

Vectors are assigned to the nearest of some pivots, in a tree of cells (:mod:`~rowloom.operators.vector_cells`),
and the cells so made are cut into blocks of bounded size. Each block first searches itself, which bounds the distance of every
query's k-th neighbour; then a query visits only blocks whose cell can, by the triangle inequality,
hold something nearer. The result is the exact one. With ``probes`` a query visits only the cells
nearest to it, at each level of the tree, which is the approximate search.

With few probes a query is sent to the blocks that it visits. Otherwise these may be most of all, so nothing is sent
per query and block: packs of queries meet packs of vectors (:mod:`~rowloom.operators.vector_packs`).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.hashing import hash32
from rowloom.operators import vector_packs
from rowloom.operators.vector_cells import BLOCK_ROWS, MAX_PIVOTS, SCORE_DIGITS, build, group_of, matrix, tiles
from rowloom.session import freeze

# with so many probes or fewer, queries are sent to the blocks that they visit
_FEW_PROBES = 16


def _scores(q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """Larger is nearer: cosine, or minus the squared distance."""
    if metric == "cosine":
        return np.round(q @ r.T, SCORE_DIGITS)
    square = (q * q).sum(1)[:, None] + (r * r).sum(1)[None, :] - 2 * q @ r.T
    return -np.round(np.maximum(square, 0.0), SCORE_DIGITS)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k best of each row; earlier columns win ties."""
    n = scores.shape[1]
    if n > k:
        limit = np.partition(scores, n - k, axis=1)[:, n - k]
        rows, cols = np.nonzero((scores >= limit[:, None]) & np.isfinite(scores))
    else:
        rows, cols = np.nonzero(np.isfinite(scores))
    order = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - first < k
    return rows[keep], cols[keep]


def _search(queries: pd.DataFrame, corpus: pd.DataFrame, k: int, metric: str, floor: float | None) -> pd.DataFrame:
    empty = pd.DataFrame({"key": [], "nbr": [], "score": []}).astype({"key": str, "nbr": str, "score": float})
    if queries.empty or corpus.empty:
        return empty
    corpus = corpus.sort_values("key", kind="stable")
    names, vectors = corpus["key"].to_numpy(dtype=object), matrix(corpus["vector"], metric)
    blocks, block_no = np.unique(corpus["block"].to_numpy(dtype=np.int64), return_inverse=True)
    # queries that ask for the same blocks stand together
    queries = queries.sort_values("q_block", kind="stable")
    found = []
    for part in tiles(len(queries), len(corpus)):
        batch = queries.iloc[part]
        counts = batch["t_blocks"].map(len).to_numpy()
        targets = np.concatenate(batch["t_blocks"].to_list())
        at = np.minimum(np.searchsorted(blocks, targets), len(blocks) - 1)
        asked = np.zeros((len(batch), len(blocks)), bool)
        held = blocks[at] == targets  # a block may hold nothing
        asked[np.repeat(np.arange(len(batch)), counts)[held], at[held]] = True
        near = np.flatnonzero(asked.any(0)[block_no])
        scores = _scores(matrix(batch["vector"], metric), vectors[near], metric)
        scores[~asked[:, block_no[near]]] = -np.inf
        if floor is not None:
            scores[scores <= floor] = -np.inf
        # k others were found already that score as much
        worst = batch["worst"].to_numpy(dtype=np.float64)[:, None]
        scores[scores < np.where(np.isnan(worst), -np.inf, worst)] = -np.inf
        rows, cols = _best(scores, k)
        keys = batch["key"].to_numpy(dtype=object)
        found.append(pd.DataFrame({"key": keys[rows], "nbr": names[near[cols]], "score": scores[rows, cols]}))
    return pd.concat(found, ignore_index=True)


_RESULT = "key string, nbr string, score double"


def knn(
    queries: DataFrame,
    corpus: DataFrame | None = None,
    k: int = 10,
    metric: str = "cosine",
    floor: float | None = None,
    probes: int | None = None,
    block_rows: int = BLOCK_ROWS,
    max_pivots: int = MAX_PIVOTS,
) -> DataFrame:
    """``key, nbr, score, rank``: the k nearest vectors of ``corpus`` for every query.

    Both inputs are ``key, vector``. The score is the cosine, or the squared distance with
    ``metric='l2'``; only scores above ``floor`` count (cosine). A key is never its own neighbour.
    Order is by score, then key. ``probes`` limits the cells that a query visits (approximate).

    Equal vectors are searched once: of a group of copies only the k + 1 first keys can be among
    any key's k nearest, and all its members share one answer.
    """
    return _Search(queries, corpus, k, metric, floor, block_rows, max_pivots).nearest(probes)


class _Search:
    """All that a search needs besides the number of probes: vectors in blocks, and what each query finds in its home block."""

    def __init__(
        self, queries: DataFrame, corpus: DataFrame | None, k: int = 10, metric: str = "cosine", floor: float | None = None,
        block_rows: int = BLOCK_ROWS, max_pivots: int = MAX_PIVOTS,
    ):
        if metric not in ("cosine", "l2"):
            raise ValueError(f"unknown metric {metric!r}")
        if floor is not None and metric != "cosine":
            raise ValueError("a floor needs the cosine metric")
        self.k, self.metric, self.floor = k, metric, floor
        self.asked = _hashed(queries)
        self.stored = freeze(_copies(self.asked if corpus is None else _hashed(corpus), k + 1))
        self.wanted = self.stored if corpus is None else freeze(_copies(self.asked, 1))
        self.distinct = _Distinct(
            self.wanted.select("key", "vector"), None if corpus is None else self.stored.select("key", "vector"),
            k + 1, metric, floor, block_rows, max_pivots)

    def nearest(self, probes: int | None = None) -> DataFrame:
        k, found = self.k, self.distinct.nearest(probes)
        # (k + 1) vectors with (k + 1) names each, cut to (k + 1) names
        named = found.join(self.stored.select(F.col("key").alias("nbr"), "names"), "nbr").select(
            "key", "score", F.explode("names").alias("nbr")
        )
        lists = _ranked(named, k + 1).groupBy("key").agg(
            F.array_sort(F.collect_list(F.struct("rank", "nbr", "score"))).alias("found")
        )
        answers = self.wanted.select("v1", "v2", "key").join(lists, "key").drop("key")
        others = F.slice(F.filter("found", lambda e: e["nbr"] != F.col("key")), 1, k)
        score = F.col("e.score") if self.metric == "cosine" else -F.col("e.score")
        return (
            self.asked.select("key", "v1", "v2")
            .join(answers, ["v1", "v2"])
            .select("key", F.posexplode(others).alias("at", "e"))
            .select("key", F.col("e.nbr").alias("nbr"), score.alias("score"), (F.col("at") + 1).alias("rank"))
        )


def _hashed(df: DataFrame) -> DataFrame:
    """Add two 64-bit hashes that stand for the vector."""
    vector = F.col("vector").cast("array<float>")
    return df.select(
        "key", vector.alias("vector"), F.xxhash64(vector).alias("v1"), F.xxhash64(F.lit("2"), vector).alias("v2")
    )


def _copies(df: DataFrame, n_names: int) -> DataFrame:
    """One row per distinct vector: its first key as ``key``, and its first ``n_names`` keys."""
    window = Window.partitionBy("v1", "v2").orderBy("key")
    first = df.withColumn("_no", F.row_number().over(window)).filter(F.col("_no") <= n_names)
    return first.groupBy("v1", "v2").agg(
        F.min("key").alias("key"),
        F.min_by("vector", "key").alias("vector"),
        F.array_sort(F.collect_list("key")).alias("names"),
    )


class _Distinct:
    """``key, nbr, score`` for distinct vectors; a key may find itself. Larger scores are nearer."""

    def __init__(
        self, queries: DataFrame, corpus: DataFrame | None, k: int, metric: str, floor: float | None, block_rows: int, max_pivots: int
    ):
        same = corpus is None
        self.k, self.metric, self.floor = k, metric, floor
        self.tree, right = build(queries if same else corpus, metric, block_rows, max_pivots)
        self.right = freeze(right)
        left = self.right.withColumn("home", F.col("block")) if same else freeze(self.tree.place(queries))
        self.left = left.withColumnRenamed("block", "q_block")
        self.n_asked, self.n_stored = queries.count(), (queries if same else corpus).count()
        self.q_groups, self.t_groups = (max(1, math.ceil(n / BLOCK_ROWS)) for n in (self.n_asked, self.n_stored))
        # first pass: every query searches one block of the cell it lies in
        asked_home = self.left.filter("home >= 0").select(
            "key", "vector", F.lit(None).cast("double").alias("worst"), "q_block", group_of(F.col("home"), self.t_groups).alias("t_group"),
            F.array("home").alias("t_blocks"))
        if same:
            asked_home = asked_home.withColumn("q_group", F.col("t_group"))
        else:
            # as many slices of queries as a group of blocks needs, so that it is not copied once per group of queries
            slices = asked_home.groupBy("t_group").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("bigint").alias("n_slices"))
            number = F.shiftright(hash32(F.col("key"), "slice") * F.col("n_slices"), 32).cast("bigint")
            asked_home = asked_home.join(slices, "t_group").withColumn("q_group", number).drop("n_slices")
        self.near = freeze(_join_groups(asked_home, self.right, self.t_groups, k, metric, floor))
        self._packs: tuple[DataFrame, DataFrame] | None = None

    def _bounded(self) -> DataFrame:
        """The queries, as ``worst`` with the score of the k-th found in the first pass."""
        kth = self.near.groupBy("key").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("worst"))
        return self.left.join(kth, "key", "left").select(
            "key", "vector", "q_block", "home", F.when(F.col("found") >= self.k, F.col("worst")).alias("worst")
        )

    def nearest(self, probes: int | None) -> DataFrame:
        if self.tree.single():
            return self.near
        # second pass: only blocks that may hold something nearer
        if probes is not None and probes <= _FEW_PROBES:
            asked = self.tree.targets(self._bounded(), self.floor, probes, self.t_groups)
            asked = asked.withColumn("q_group", group_of(F.col("q_block"), self.q_groups))
            far = _join_groups(asked, self.right, self.t_groups, self.k, self.metric, self.floor)
        else:
            if self._packs is None:
                asked = vector_packs.packs(
                    self._bounded(), {"home": np.int64, "worst": np.float64}, "q_block", self.n_asked, vector_packs.ASKED_ROWS)
                self._packs = asked, vector_packs.corpus_packs(self.tree, self.right, self.n_stored)
            far = vector_packs.search(*self._packs, self.tree, self.k, self.metric, self.floor, probes)
        return _ranked(self.near.unionByName(far), self.k).drop("rank")


def _join_groups(asked: DataFrame, right: DataFrame, t_groups: int, k: int, metric: str, floor: float | None) -> DataFrame:
    """Search groups of queries in groups of blocks; of a group, each query is compared with the blocks that it asks for."""
    pairs = asked.select(F.col("q_group").alias("from_group"), F.col("t_group").alias("to_group")).distinct()
    corpus = right.select(
        group_of(F.col("block"), t_groups).alias("to_group"), F.col("block").alias("c_block"), F.col("key").alias("c_key"), F.col("vector").alias("c_vector")
    ).join(pairs, "to_group")

    def search(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        return _search(queries, vectors.rename(columns={"c_block": "block", "c_key": "key", "c_vector": "vector"}), k, metric, floor)

    return (
        asked.groupBy("q_group", "t_group")
        .cogroup(corpus.groupBy("from_group", "to_group"))
        .applyInPandas(search, _RESULT)
    )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("key").orderBy(F.col("score").desc(), "nbr")
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Per key of ``exact``: ``n_near`` neighbours and the share ``recall`` of them in ``found``; the same over all keys.

    Both are results of :func:`knn` with the same k; a neighbour as near as the last exact one counts as found.
    """
    last = exact.groupBy("key").agg(F.count(F.lit(1)).alias("n_near"), F.max_by("score", "rank").alias("last"), F.min_by("score", "rank").alias("first"))
    near = F.when(F.col("last") <= F.col("first"), F.col("score") >= F.col("last")).otherwise(F.col("score") <= F.col("last"))
    hits = found.join(last.select("key", "last", "first"), "key").filter(near).groupBy("key").agg(F.count(F.lit(1)).alias("n_found"))
    each = freeze(last.join(hits, "key", "left").select(
        "key", "n_near", (F.least(F.coalesce("n_found", F.lit(0)), "n_near") / F.col("n_near")).alias("recall")))
    total = each.agg(F.sum("n_near").alias("n_all"), (F.sum(F.col("recall") * F.col("n_near")) / F.sum("n_near")).alias("recall_all"))
    return each.join(F.broadcast(total), F.lit(True))  # one row


def probes_for(
    queries: DataFrame, corpus: DataFrame | None = None, k: int = 10, goal: float = 0.95, n_sample: int = 256, **search
) -> int:
    """The least power of two of ``probes`` with which ``n_sample`` queries, picked by hash, reach a recall of ``goal``.

    The sample only sets the number of probes; it is searched in the whole corpus, once exactly and once per trial.
    """
    stored = queries if corpus is None else corpus
    sample = freeze(queries.select("key", "vector").orderBy(hash32(F.col("key"), "sample"), "key").limit(n_sample))
    trial = _Search(sample, stored, k, **search)
    exact = freeze(trial.nearest())
    probes = 1
    while probes < MAX_PIVOTS:  # so many probes leave no cell out
        row = recall(trial.nearest(probes), exact).first()
        if row is None or row.recall_all >= goal:
            break
        probes *= 2
    return probes


def record_vectors(vectors: DataFrame) -> DataFrame:
    """Only the vectors of rows (``idx__<number>``)."""
    return vectors.filter(F.col("key").rlike("^idx__[0-9]+$"))


def record_neighbours(vectors: DataFrame, k: int, floor: float = 0.5, limit_k: bool = True, **search) -> DataFrame:
    """Nearest rows of every row by cosine, from ``10 k`` neighbours, above ``floor``."""
    found = knn(record_vectors(vectors), k=10 * k, floor=floor, **search)
    return found.filter(F.col("rank") <= k) if limit_k else found


def mixed_neighbours(vectors: DataFrame, targets: DataFrame, k: int, floor: float = 0.5, **search) -> DataFrame:
    """For rows in ``targets``: of the ``10 k`` nearest of *all* keys, the first k rows above ``floor``."""
    asked = vectors.join(targets.select("key").distinct(), "key", "left_semi")
    found = knn(asked, vectors, k=10 * k, **search).filter(
        (F.col("score") > floor) & F.col("nbr").startswith("idx__")
    )
    window = Window.partitionBy("key").orderBy("rank")
    kept = found.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= k)
    return kept.select("key", "nbr", "score", F.col("place").alias("rank"))


def extend_index(index: DataFrame, vectors: DataFrame, refresh: bool = True) -> DataFrame:
    """Add the rows that ``index`` lacks; with ``refresh`` known rows take their current vector."""
    current = record_vectors(vectors)
    if refresh:
        return index.join(current.select("key"), "key", "left_anti").unionByName(current)
    return index.unionByName(current.join(index.select("key"), "key", "left_anti"))
