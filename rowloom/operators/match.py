"""Candidates, bounded similarity lists, pairs, and column matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.text import id_number
from rowloom.functions.vectors import cosine
from rowloom.session import freeze


def cross_source_candidates(neighbours: DataFrame, n_items: int, n_candidates: int) -> DataFrame:
    """Of each row's neighbours those from the other source, then the first ``n_candidates``."""
    side, other = id_number(F.col("key")) < n_items, id_number(F.col("nbr")) < n_items
    window = Window.partitionBy("key").orderBy("rank")
    return (
        neighbours.filter(side != other)
        .withColumn("place", F.row_number().over(window))
        .filter(F.col("place") <= n_candidates)
        .select("key", "nbr", "score", F.col("place").alias("rank"))
    )


def mutual(candidates: DataFrame, n_top: int) -> DataFrame:
    """Candidates that also have the key among their own first ``n_top``."""
    back = candidates.filter(F.col("rank") <= n_top).select(F.col("nbr").alias("key"), F.col("key").alias("nbr"))
    return candidates.join(back, ["key", "nbr"], "left_semi")


def from_source(neighbours: DataFrame, source_num: int, column: str = "nbr") -> DataFrame:
    """Keep neighbours whose number is at most ``source_num``; 0 keeps all."""
    return neighbours.filter(id_number(F.col(column)) <= source_num) if source_num > 0 else neighbours


def beyond_source(entries: DataFrame, source_num: int, column: str = "id") -> DataFrame:
    return entries.filter(id_number(F.col(column)) > source_num)


# --- similarity lists -----------------------------------------------------------------------


def symmetric(pairs: DataFrame) -> DataFrame:
    """Each pair from both ends: target with candidate, candidate with target."""
    ends = F.array(
        F.struct(F.col("id").alias("id"), F.col("word").alias("word")),
        F.struct(F.col("word").alias("id"), F.col("id").alias("word")),
    )
    others = [c for c in pairs.columns if c not in ("id", "word")]
    return pairs.select(F.inline(ends), *others)


def similarity_list(pairs: DataFrame, n: int) -> DataFrame:
    """``id, word, score, rank`` from ``id, word, score, seq``: the n best entries per id.

    A word counts once per id, with the score seen first. Rank-limited windows cut every id to n
    rows before the shuffle, so a popular id costs no more than others.
    """
    return top_entries(_first_scores(pairs), n)


def _first_scores(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("id", "word").agg(F.min_by("score", "seq").alias("score"))


def merge_lists(old: DataFrame, new: DataFrame, n: int) -> DataFrame:
    """Insert new pairs (``id, word, score, seq``) into a list; present entries keep their score."""
    known = old.select("id", "word", "score")
    fresh = _first_scores(new).join(known, ["id", "word"], "left_anti")
    return top_entries(known.unionByName(fresh), n)


def top_entries(entries: DataFrame, n: int, with_score: bool = True) -> DataFrame:
    """The n largest entries by (score, word)."""
    window = Window.partitionBy("id").orderBy(F.col("score").desc(), F.col("word").desc())
    top = entries.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)
    return top.select("id", "word", "score", "rank") if with_score else top.select("id", "word", "rank")


def nested_list(entries: DataFrame) -> DataFrame:
    """``id, similarity``: one array per id, best first (at most the list size long)."""
    packed = F.array_sort(F.collect_list(F.struct("rank", "score", "word")))
    return entries.groupBy("id").agg(
        F.transform(packed, lambda e: F.struct(e["score"].alias("score"), e["word"].alias("word"))).alias("similarity")
    )


def flat_list(nested: DataFrame) -> DataFrame:
    return nested.select("id", F.posexplode("similarity").alias("at", "e")).select(
        "id", F.col("e.word").alias("word"), F.col("e.score").alias("score"), (F.col("at") + 1).alias("rank")
    )


def common_neighbours(entries: DataFrame, id_a: str, id_b: str) -> DataFrame:
    """Words in the lists of both ids, with both scores."""
    a = entries.filter(F.col("id") == id_a).select("word", F.col("score").alias("score_a"))
    b = entries.filter(F.col("id") == id_b).select("word", F.col("score").alias("score_b"))
    return a.join(b, "word")


# --- pairs ----------------------------------------------------------------------------------


def ordered_pairs(df: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct ``lo, hi`` row numbers."""
    a, b = id_number(F.col(left)), id_number(F.col(right))
    return df.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()


def match_pairs(candidates: DataFrame) -> DataFrame:
    return ordered_pairs(candidates, "key", "nbr")


def truth_pairs(truth: DataFrame) -> DataFrame:
    return ordered_pairs(truth, "item", "match")


def predicted_pairs(entries: DataFrame, n: int, digits: int) -> DataFrame:
    """Pairs whose rounded score is one of the n highest distinct ones of the id; all for n <= 0."""
    if n > 0:
        window = Window.partitionBy("id").orderBy(F.round("score", digits).desc())
        entries = entries.withColumn("level", F.dense_rank().over(window)).filter(F.col("level") <= n)
    return ordered_pairs(entries, "id", "word")


# --- columns --------------------------------------------------------------------------------


def infer_prefixes(columns: list[str]) -> list[str] | None:
    """The (at most two) source prefixes of column names; None when there are more."""
    prefixes = sorted({c.split("_")[0] for c in columns})
    return prefixes if len(prefixes) <= 2 else None


def column_candidates(vectors: DataFrame, columns: list[str]) -> DataFrame:
    """``left_col, right_col, distance, rank`` for columns of different prefix, nearest first.

    ``columns`` is the schema of the table, so pairs are names exploded from it and looked up.
    """
    known = vectors.filter(F.col("key").isin(columns)).select("key", "vector")
    wanted = known.select(
        F.col("key").alias("left_col"),
        F.col("vector").alias("left_vec"),
        F.explode(F.array(*[F.lit(c) for c in columns])).alias("right_col"),
    ).filter(
        (F.col("left_col") != F.col("right_col"))
        & ~F.col("right_col").startswith(F.substring_index("left_col", "_", 1))
    )
    right = known.select(F.col("key").alias("right_col"), F.col("vector").alias("right_vec"))
    distances = wanted.join(right, "right_col").select(
        "left_col", "right_col", (1 - cosine(F.col("left_vec"), F.col("right_vec"))).alias("distance")
    )
    window = Window.partitionBy("left_col").orderBy("distance", "right_col")
    return distances.withColumn("rank", F.row_number().over(window))


#: Nearest open candidates of a column that one round looks at.
AHEAD = 32


def _nearest_columns(pairs: DataFrame, matched: list[str], ahead: int) -> dict[str, tuple[int, list[tuple[str, int | None]]]]:
    """For each column the number of candidates left, and the nearest ``ahead`` of them.

    Each comes with the rank that the column has had among the candidate's own list, null if it is not in it.
    """
    left = pairs
    if matched:
        gone = pairs.sparkSession.createDataFrame([(c,) for c in matched], "gone string")
        for side in ("left_col", "right_col"):
            left = left.join(gone, F.col(side) == F.col("gone"), "left_anti")
    order = Window.partitionBy("left_col").orderBy("rank")
    near = left.withColumn("place", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("left_col")))
    back = pairs.select(F.col("right_col").alias("left_col"), F.col("left_col").alias("right_col"), F.col("rank").alias("back"))
    near = near.filter(F.col("place") <= ahead).join(back, ["left_col", "right_col"], "left")
    lists = near.groupBy("left_col").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "right_col", "back"))).alias("near"))
    return {r.left_col: (r.n, [(e.right_col, e.back) for e in r.near]) for r in lists.collect()}


def match_columns(candidates: DataFrame, max_rank: int = 3, ahead: int = AHEAD) -> DataFrame:
    """``left_col, right_col``: greedy matching of columns, in name order.

    A column takes its nearest open candidate for which it is itself the nearest one left. Both
    then leave all lists. A column that found nothing counts one miss per candidate, and drops out
    at its next turn with more than ``max_rank`` misses.

    One round of Spark ranks the candidates that are left and returns the nearest ``ahead`` of each column. Turns
    are taken from these short lists until one of them may lack an entry that counts; then the next round begins.
    So rounds are few, and the driver holds no more than ``ahead`` names per column of the schema. The
    result does not depend on ``ahead``.
    """
    spark = candidates.sparkSession
    ahead = max(ahead, max_rank + 1)
    pairs = freeze(candidates.select("left_col", "right_col", "rank"))
    found: list[tuple[str, str]] = []
    matched: set[str] = set()
    state = _nearest_columns(pairs, [], ahead)
    misses = dict.fromkeys(state, 0)
    queue = sorted(state)
    still_open = set(queue)

    def rest(column: str) -> tuple[list[tuple[str, int | None]], bool]:
        """What is left of a column's short list, and whether that is all."""
        n, near = state.get(column, (0, []))
        return [e for e in near if e[0] not in matched], n <= len(near)

    def index() -> dict[str, dict[str, int | None]]:
        """For each column those that have it as their nearest, with their ranks in its own list."""
        out: dict[str, dict[str, int | None]] = {}
        for column in state:
            if column not in matched:
                point(out, column)
        return out

    def point(out: dict[str, dict[str, int | None]], column: str) -> bool:
        """Enter a column below its nearest; whether that was known."""
        near, whole = rest(column)
        if near:
            out.setdefault(near[0][0], {})[column] = near[0][1]
        return bool(near) or whole

    nearest_to = index()
    while queue:
        for item in queue:
            if item not in still_open:
                continue
            near, whole = rest(item)
            if not whole and len(near) <= max_rank:
                state = _nearest_columns(pairs, sorted(matched), ahead)
                nearest_to = index()
                near, whole = rest(item)
            if misses[item] > max_rank or not near:
                still_open.discard(item)
                continue
            options = {c: rank for c, rank in nearest_to.get(item, {}).items() if rank is not None and c in still_open}
            if not options:
                misses[item] += len(near)  # of a list that goes on these are over max_rank already
                continue
            partner = min(options, key=lambda c: (options[c], c))
            found.append((item, partner))
            matched |= {item, partner}
            still_open -= {item, partner}
            moved = [c for gone in (item, partner) for c in nearest_to.pop(gone, {}) if c not in matched]
            if not all([point(nearest_to, c) for c in moved]):
                state = _nearest_columns(pairs, sorted(matched), ahead)
                nearest_to = index()
        queue = [c for c in queue if c in still_open]
    rows = [tuple(sorted(pair)) for pair in found]
    return spark.createDataFrame(rows, "left_col string, right_col string")


def column_vectors(vectors: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """Vectors of columns with ``cid__`` removed; with a truth only the columns it names."""
    named = vectors.filter(F.col("key").startswith("cid__")).select(
        F.expr("substring(key, 6)").alias("key"), "vector"
    )
    if truth is None:
        return named
    wanted = truth.select(F.explode(F.array("left_col", "right_col")).alias("key")).distinct()
    return named.join(wanted, "key", "left_semi")
