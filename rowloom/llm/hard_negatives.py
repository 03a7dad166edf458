"""Hard negatives by an exact integer product of matrices in residue numbers.

The score of two rows is the inner product of their integer components. Blocks of anchors are multiplied
with blocks of rows modulo several small primes: residues are taken around zero, so that sums of products
stay below 2^24 and float32 holds them exactly (longer vectors are multiplied in pieces). The residues of
a score are put together by the Chinese remainder theorem in digits around zero, which gives its sign too.
As many primes are used as the largest squared length of a vector asks for.

Two passes: the first takes each anchor's best rows of its own label (its positives), the second the best
rows of other labels whose score lies in a window that a positive's score sets. Both join blocks of anchors
with strips of blocks of rows, so that every anchor meets every row; a pair of cells returns a few rows per
anchor, whose best are taken in the end. No cell grows with the data or with a label.

Cases: rows with a null label, a null vector or a null or non-finite component take no part, nor do vectors
of another length than most. Components of 2^16 or more stop the job, and so do vectors whose scores could pass
57 bits. Rows that repeat an id or a vector are rows of their own; a row is never its own positive. A row without
id is no anchor and comes last among equal scores. Extra columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.common import col, written
from rowloom.llm.registry import query, table
from rowloom.llm.vectors import common_length, floors, longs, matrix, sound
from rowloom.session import shuffle_partitions

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: Rows of a block, the most anchors of a block, and the bytes of components that one strip of blocks holds.
ROWS, ANCHORS, STRIP_BYTES = 1024, 4096, 16 << 20
#: Partial results that a cell holds before it leaves out what is not among the best.
_HELD = 1 << 18
#: Rows of a partition before blocks are cut.
_PARTITION = 65_536
_NO_ID = (1 << 63) - 1
#: Primes below 1024: 64 products of residues around zero stay below 2^24.
_PRIMES = [p for p in range(1023, 700, -2) if all(p % q for q in range(3, 32, 2))]
_EXACT = 1 << 24


def primes_for(largest: int) -> list[int]:
    """So many primes that their product exceeds all values from -largest to largest; two at least."""
    need, found = 2 * largest + 1, _PRIMES[:2]
    while math.prod(found) <= need:
        found = _PRIMES[:len(found) + 1]
    return found


def _residues(table: np.ndarray, prime: int) -> np.ndarray:
    """Residues around zero, in float32."""
    half = prime // 2
    return ((table + half) % prime - half).astype(np.float32)


def products(a: np.ndarray, b: np.ndarray, primes: list[int]) -> np.ndarray:
    """Exact inner products of the rows of two whole-number matrices, if below half the primes' product."""
    total = np.zeros((len(a), len(b)), np.int64)
    digits: list[np.ndarray] = []
    for prime in primes:
        x, y = _residues(a, prime), _residues(b, prime)
        step = max(1, (_EXACT - 1) // (prime // 2) ** 2)
        rest = np.zeros(total.shape, np.int64)
        for start in range(0, a.shape[1], step):
            rest += (x[:, start:start + step] @ y[:, start:start + step].T).astype(np.int64)
        # the digit of this prime: what the value so far lacks, over the product of the primes before
        value, scale = np.zeros(total.shape, np.int64), 1
        for digit, before in zip(digits, primes):
            value += digit * (scale % prime)
            scale *= before
        half = prime // 2
        digit = ((rest - value) % prime * pow(scale, -1, prime) + half) % prime - half
        total += digit * np.int64((scale + (1 << 63)) % (1 << 64) - (1 << 63))  # modulo 2^64; the end value fits
        digits.append(digit)
    return total


def _blocks(rows: DataFrame, size: int, extra: str = "") -> DataFrame:
    """Blocks ``part, seq, n, r, k, g, x`` of ``rows (r, k, g, x)``, and of one more list of longs."""
    names = ["r", "k", "g", "x", *([extra] if extra else [])]
    width = {"x": "int", extra: "long"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            nonlocal seq
            data = pa.Table.from_batches(held).combine_chunks()
            out = [pa.array([part]), pa.array([seq]), pa.array([data.num_rows], pa.int64())]
            for name in names:
                values = data.column(name).combine_chunks()
                values = values.flatten() if name in width else values
                kind = np.int32 if width.get(name) == "int" else np.int64
                out.append(pa.array([values.to_numpy(zero_copy_only=False).astype(kind).tobytes()], pa.binary()))
            held.clear()
            seq += 1
            return pa.RecordBatch.from_arrays(out, ["part", "seq", "n", *names])

        for batch in batches:
            while batch.num_rows:
                room = size - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == size:
                    yield block()
        if held:
            yield block()

    return rows.select(*names).mapInArrow(run, "part long, seq long, n long, " + ", ".join(f"{n} binary" for n in names))


class _Block:
    """The rows of a block, in the order of their ids."""

    def __init__(self, row: dict, length: int, extra: str = "") -> None:
        self.r, self.k, self.g = (np.frombuffer(row[c], np.int64) for c in "rkg")
        self.x = np.frombuffer(row["x"], np.int32).reshape(-1, length).astype(np.int64)
        self.more = np.frombuffer(row[extra], np.int64).reshape(len(self.r), -1) if extra else None


def _first(anchor: np.ndarray, limit: int) -> np.ndarray:
    """Of rows sorted by ``anchor``, those among the first ``limit`` of each."""
    start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    return np.arange(len(anchor)) - np.repeat(start, np.diff(np.r_[start, len(anchor)])) < limit


def _best(score: np.ndarray, wanted: np.ndarray, k: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's best wanted scores: the higher first, then the smaller id."""
    a, b = np.nonzero(wanted)
    order = np.lexsort((k[b], -score[a, b], a))
    order = order[_first(a[order], limit)] if len(order) else order
    return a[order], b[order]


def _kept(columns: list[np.ndarray], by: int, limit: int) -> list[np.ndarray]:
    """Of rows ``key, ..., score, id, number`` the first of each key, which has ``by`` columns."""
    order = np.lexsort((columns[by + 2], columns[by + 1], -columns[by], *columns[by - 1::-1]))
    keys = np.stack([c[order] for c in columns[:by]], 1)
    new = np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)][:len(order)]
    order = order[_first(np.cumsum(new), limit)] if len(order) else order
    return [c[order] for c in columns]


def _met(rows: DataFrame, anchors: DataFrame, length: int, primes: list[int], find, by: list[str], limit: int, extra: str = "") -> DataFrame:
    """The best of what ``find(anchor block, slice, row block, scores)`` returns for all blocks of anchors and rows.

    Both kinds of blocks are dealt to cells, one for each block of anchors and each strip of rows; a cell
    holds one block of anchors and a strip of bounded bytes, so its size doesn't depend on the data.
    """
    spark = rows.sparkSession
    row_blocks, anchor_blocks = rows.count(), anchors.count()
    most = max(1, STRIP_BYTES // (4 * ROWS * max(length, 1)))
    strips = -(-row_blocks // min(most, max(1, row_blocks * anchor_blocks // shuffle_partitions(spark)))) if row_blocks else 1

    def numbered(blocks: DataFrame) -> DataFrame:
        counts = blocks.groupBy("part").agg(F.count("*").alias("c"))
        # one row per partition, so the window without partitions is as small as the partition count
        before = counts.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before"))
        return blocks.join(F.broadcast(before), "part").withColumn("no", F.col("before") + F.col("seq")).drop("before")

    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n, 1) - 1).cast("long")))
    cell = F.struct("a", "s").alias("cell")
    fill = [F.lit(None).cast("binary").alias(extra)] if extra else []
    names = ["n", "r", "k", "g", "x", *([extra] if extra else [])]
    left = numbered(anchors).withColumnsRenamed({"no": "a"}).withColumn("s", every(strips)).select(cell, F.lit(0).alias("side"), *names)
    right = numbered(rows).withColumn("s", F.col("no") % strips).withColumn("a", every(anchor_blocks))
    right = right.select(cell, F.lit(1).alias("side"), *[c for c in names if c != extra], *fill)

    names_out = [*by, "score", "k", "o"]

    def run(group: pa.Table) -> pa.Table:
        held = [np.zeros(0, np.int64)] * len(names_out)
        sides = group.column("side").to_pylist()
        own = None
        for i in np.argsort(sides, kind="stable"):  # the one block of anchors comes first
            if sides[i] == 0:
                own = _Block(group.slice(i, 1).to_pylist()[0], length, extra)
                continue
            if own is None:
                break
            other = _Block(group.slice(i, 1).to_pylist()[0], length)
            for start in range(0, len(own.r), ROWS):
                piece = slice(start, start + ROWS)
                found = find(own, piece, other, products(own.x[piece], other.x, primes))
                held = [np.concatenate(c) for c in zip(held, found, strict=True)]
                if len(held[0]) > _HELD:
                    held = _kept(held, len(by), limit)
        return pa.Table.from_arrays([pa.array(c) for c in _kept(held, len(by), limit)], names=names_out)

    return left.union(right).groupBy("cell").applyInArrow(run, ", ".join(f"{n} long" for n in names_out))


def _ranked(found: DataFrame, by: list[str], limit: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "k", "o")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def mine(
    vectors: DataFrame, *, anchors: Column, relabel: Column | None = None, id: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100), scale: int = SCALE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` says which rows are anchors. A negative's score lies from ``low`` to ``high`` of the positive's,
    each given as a pair of whole numbers (50, 100 for a half). ``relabel`` replaces the label first.
    """
    rows = vectors.filter(sound(vector) & col(label).isNotNull())
    rows = rows.select(
        F.coalesce(col(id).cast("long"), F.lit(_NO_ID)).alias("k"), F.coalesce(relabel if relabel is not None else col(label), col(label)).alias("g"),
        (F.coalesce(anchors, F.lit(False)) & col(id).isNotNull()).alias("anchor"), col(vector).alias("v"))
    length = common_length(rows, "v")
    rows = rows.filter(F.size("v") == length).select("k", F.xxhash64("g").alias("g") if not _whole(rows, "g") else F.col("g").cast("long"), "anchor", floors("v", scale).alias("x"))
    n = rows.count()
    parts = max(-(-n // _PARTITION), min(-(-n // ROWS), shuffle_partitions(vectors.sparkSession)), 1)
    rows = written(rows.repartition(parts).withColumn("r", F.monotonically_increasing_id()), "rows")
    square = F.aggregate("x", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    largest = rows.agg(F.max(square).alias("m")).first().m or 0
    if largest >= 1 << 56:
        raise ValueError("the vectors are too long for exact scores in 64 bits")
    primes = primes_for(largest)
    blocks = written(_blocks(rows, ROWS), "blocks")

    def same(own, piece, other, score):
        wanted = (own.g[piece, None] == other.g) & (own.r[piece, None] != other.r)
        a, b = _best(score, wanted, other.k, positives)
        return own.r[piece][a], score[a, b], other.k[b], other.r[b]

    def window(own, piece, other, score):
        """The best negatives of each positive. Scores outside all windows are left out first."""
        goal = own.more[piece]  # scores of the positives in falling order, filled up with the last one
        lowest = goal.min(axis=1)[:, None]
        wanted = (own.g[piece, None] != other.g) & (score * low[1] >= lowest * low[0])
        a, b = np.nonzero(wanted)
        s = score[a, b]
        order = np.lexsort((other.k[b], -s, a))
        a, b, s = a[order], b[order], s[order]
        out = []
        for j in range(goal.shape[1]):
            near = (s * low[1] >= goal[a, j] * low[0]) & (s * high[1] <= goal[a, j] * high[0])
            near = np.flatnonzero(near)
            near = near[_first(a[near], negatives)] if len(near) else near
            out.append((own.r[piece][a[near]], np.full(len(near), j), s[near], other.k[b[near]], other.r[b[near]]))
        return tuple(np.concatenate(c) for c in zip(*out))

    chosen = rows.filter("anchor").select("r", "k", "g", "x")
    spread = chosen.count()
    spread = max(-(-spread // ANCHORS), min(-(-spread // 256), shuffle_partitions(vectors.sparkSession)), 1)
    found = _met(blocks, written(_blocks(chosen.repartition(spread), ANCHORS), "anchors"), length, primes, same, ["r"], positives)
    best = written(_ranked(found, ["r"], positives), "positives")
    goals = best.groupBy("r").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda p: p.score).alias("goals"))
    goals = goals.withColumn("goals", F.concat("goals", F.array_repeat(F.element_at("goals", -1), F.lit(positives) - F.size("goals"))))
    chosen = written(chosen.join(goals, "r"), "goals")
    found = _met(blocks, written(_blocks(chosen.repartition(spread), ANCHORS, "goals"), "anchors"), length, primes, window, ["r", "j"], negatives, "goals")
    found = _ranked(found, ["r", "j"], negatives)
    best = best.select(F.col("r").alias("br"), (F.col("rank") - 1).cast("long").alias("bj"), F.col("k").alias("bk"), F.col("score").alias("bs"))
    names = chosen.select(F.col("r").alias("ar"), F.col("k").alias("ak"))
    found = found.join(best, (F.col("r") == F.col("br")) & (F.col("j") == F.col("bj"))).join(names, F.col("r") == F.col("ar"))
    given = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return found.select(
        F.col("ak").alias("anchor_id"), given("bk").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        given("k").alias("negative_id"), F.col("bs").alias("positive_score"), F.col("score").alias("negative_score"))


def _whole(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


_SQL = """
    WITH k AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
      FROM k a JOIN k b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, other_id AS positive_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, other_id))::INT AS rank,
      other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3"""


@query("op13_hard_negatives", _SQL)
def op13_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), anchors=F.col("vec_id") % 50 == 0, relabel=moved)
