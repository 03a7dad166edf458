"""Near duplicates among vectors by an epsilon grid order join.

Vectors are scaled to length one, so that a cosine of ``least`` is a distance of epsilon = sqrt(2 - 2 least).
They are turned to their principal directions; the leading coordinates give a grid of cells as wide as epsilon,
and all vectors of a label are sorted by their cells, the first direction first. The sorted sequence is cut into
blocks, blocks into intervals of 8, these into intervals of 64, and so on. The join begins with the largest
intervals and goes down to the parts of every pair that is not provably distant: the boxes around two intervals
are further apart than epsilon. Pairs of blocks that are left go on in the same way inside a task, down to
intervals of ``LEAF`` vectors, whose cosines are computed in double precision.

A task returns, of the links between two blocks, how many each vector has and a forest that connects the
same vectors, never the links themselves, so a group of near copies gives rows in proportion to its vectors.
Equal vectors of a label are compared once; their copies are counted. Directions are found on at most ``SAMPLE``
vectors, and only the work depends on them. Data without any structure lets few blocks be skipped.

Cases: vectors that are null, zero or hold null or non-finite components, and those without label, link with
nothing. Vectors of different lengths don't link either. Repeated rows are rows of their own, and link if sound.
A component is named by its least id; rows without id take part, and a component of such rows alone has a null
name. A row is kept if its id is the name (of repeated rows all are). Extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import col, written
from rowloom.llm.components import components
from rowloom.llm.registry import query, table
from rowloom.llm.vectors import sound
from rowloom.session import shuffle_partitions

LEAST = 0.98
#: Leading directions that make the grid and the boxes; vectors that they are found on.
DIRECTIONS, SAMPLE = 16, 4096
#: Vectors of a block and of the smallest interval; intervals that make up the next larger one.
BLOCK, LEAF, FAN = 4096, 128, 8
#: Room for rounding in distances, which are bounds only; a cosine so near the threshold is summed again exactly.
_ROUNDING, _NEAR = 1e-9, 1e-12


def _raw(values: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """Vectors of several lengths as rows, filled up with zeros; each scaled by a power of two, against overflow."""
    out = np.zeros((len(length), width))
    out[np.arange(width) < length[:, None]] = values
    top = np.abs(out).max(axis=1, initial=0.0)
    return np.ldexp(out, -np.frexp(top)[1][:, None])


def unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(axis=1))[:, None]


def _exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    dot, aa, bb = (math.fsum((x * y).tolist()) for x, y in ((a, b), (a, a), (b, b)))
    return dot / math.sqrt(aa * bb)


def _apart(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Squared distance of two boxes."""
    gap = np.maximum(np.maximum(a[0] - b[1], b[0] - a[1]), 0.0)
    return float((gap * gap).sum())


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of ``i`` and ``j``; ``root`` names each one's set by its least member."""
    while len(i):
        a, b = root[i], root[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


class _Sequence:
    """The vectors of a block, in grid order, with the boxes of its intervals."""

    def __init__(self, raw: np.ndarray, turned: np.ndarray, copies: np.ndarray) -> None:
        self.raw, self.turned, self.copies = raw, turned, copies
        self.unit = unit(raw)

    def box(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        return self.turned[lo:hi].min(axis=0), self.turned[lo:hi].max(axis=0)


def join(a: _Sequence, b: _Sequence, least: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each vector of ``a`` and of ``b``, and the sets that they connect (``b`` numbered after ``a``).

    With ``same`` the two are one block, and pairs are counted once.
    """
    counts = np.zeros(len(a.raw), np.int64), np.zeros(len(b.raw), np.int64)
    shift = 0 if same else len(a.raw)
    root = np.arange(shift + len(b.raw))
    far = 2 - 2 * least + _ROUNDING
    open_ = [(0, len(a.raw), 0, len(b.raw))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        if same and b1 <= a0 or _apart(a.box(a0, a1), b.box(b0, b1)) > far:
            continue
        if max(a1 - a0, b1 - b0) > LEAF:
            cut = lambda lo, hi: [(lo, hi)] if hi - lo <= LEAF else [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
            open_ += [(*x, *y) for x in cut(a0, a1) for y in cut(b0, b1)]
            continue
        cosine = a.unit[a0:a1] @ b.unit[b0:b1].T
        linked = cosine >= least
        for i, j in np.argwhere(np.abs(cosine - least) < _NEAR):
            linked[i, j] = _exact_cosine(a.raw[a0 + i], b.raw[b0 + j]) >= least
        if same:
            linked &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)
        if not linked.any():
            continue
        counts[0][a0:a1] += linked @ b.copies[b0:b1]
        counts[1][b0:b1] += linked.T @ a.copies[a0:a1]
        i, j = np.nonzero(linked)
        unite(root, i + a0, j + b0 + shift)
    return *counts, root


def directions(sample: np.ndarray, most: int) -> np.ndarray:
    """The leading principal directions, as orthonormal columns."""
    values, turned = np.linalg.eigh(np.cov(sample.T).reshape(sample.shape[1], -1)) if len(sample) > 1 else (None, np.eye(sample.shape[1]))
    return turned[:, ::-1][:, :most]


def _sequences(vectors: DataFrame, width: int, axes: np.ndarray, epsilon: float) -> DataFrame:
    """Blocks of vectors in grid order, ``part, seq, label, length, u, w, raw``, with their boxes ``lo, hi``."""
    m = axes.shape[1]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            turned = unit(_raw(batch.column(3).flatten().to_numpy(zero_copy_only=False), length, width)) @ axes
            cell = (np.floor(turned / epsilon).clip(-32768, 32767).astype(np.int64) + 32768).astype(">u2")
            rows = cell.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([rows[i:i + 2 * m] for i in range(0, len(rows), 2 * m)], pa.binary())], ["u", "label", "w", "v", "cell"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("label", pa.string()), ("length", pa.int32()), ("u", pa.binary()), ("w", pa.binary()),
                            ("raw", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))])

        def block() -> pa.RecordBatch:
            nonlocal seq
            data = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            size = data.column("length")[0].as_py()
            values = data.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            turned = unit(_raw(values, np.full(data.num_rows, size), width)) @ axes
            u, w = (data.column(c).to_numpy().astype(np.int64).tobytes() for c in "uw")
            row = [part, seq, data.column("label")[0].as_py(), size, u, w, values.tobytes(), turned.min(axis=0).tolist(), turned.max(axis=0).tolist()]
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("length").to_pylist(), strict=True))
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for lo, hi in zip(starts, [*starts[1:], len(keys)], strict=True):
                if held and keys[lo] != (held[0].column("label")[0].as_py(), held[0].column("length")[0].as_py()):
                    yield block()
                while lo < hi:
                    take = min(hi - lo, BLOCK - sum(b.num_rows for b in held))
                    held.append(batch.slice(lo, take))
                    lo += take
                    if sum(b.num_rows for b in held) == BLOCK:
                        yield block()
        if held:
            yield block()

    kind = vectors.schema["v"].dataType.simpleString()
    found = vectors.select("u", "label", "w", "v").mapInArrow(cells, f"u long, label string, w long, v {kind}, cell binary")
    found = found.withColumn("length", F.size("v"))
    n = found.count()
    parts = max(-(-n // (4 * BLOCK)), min(-(-n // 256), shuffle_partitions(vectors.sparkSession)), 1)
    order = ["label", "length", "cell", "u"]
    found = found.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return found.mapInArrow(pack, "part long, seq long, label string, length int, u binary, w binary, raw binary, lo array<double>, hi array<double>")


def _pairs(blocks: DataFrame, far: float, m: int) -> DataFrame:
    """Pairs ``x <= y`` of blocks whose boxes (of ``m`` sides) are not provably distant, from the largest intervals down."""
    last = blocks.agg(F.max("part").alias("part"), F.max("seq").alias("seq")).first()
    bits = int(last.seq or 0).bit_length()
    step = FAN.bit_length() - 1
    number = F.shiftleft(F.col("part"), bits) + F.col("seq")
    level = blocks.select("label", "length", number.alias("z"), "lo", "hi")
    levels = [level]
    edge = lambda c, f: F.array(*(f(F.col(c)[i]) for i in range(m)))
    for _ in range(-(-(bits + int(last.part or 0).bit_length()) // step)):
        level = level.groupBy("label", "length", F.shiftright("z", step).alias("z")).agg(edge("lo", F.min).alias("lo"), edge("hi", F.max).alias("hi"))
        levels.append(level)
    top = levels.pop()
    pairs = top.select("label", "length", F.col("z").alias("x"), F.col("z").alias("y"))
    while levels:
        below = levels.pop()
        side = lambda s: below.select(
            F.col("label").alias(f"label_{s}"), F.col("length").alias(f"length_{s}"), F.col("z").alias(f"z{s}"), F.shiftright("z", step).alias(f"up{s}"),
            F.col("lo").alias(f"lo{s}"), F.col("hi").alias(f"hi{s}"))
        on = lambda s, c: (F.col("label") == F.col(f"label_{s}")) & (F.col("length") == F.col(f"length_{s}")) & (F.col(c) == F.col(f"up{s}"))
        gap = F.zip_with(F.arrays_zip("lox", "hix"), F.arrays_zip("loy", "hiy"), lambda p, q: F.greatest(p.lox - q.hiy, q.loy - p.hix, F.lit(0.0)))
        near = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= far
        pairs = pairs.join(side("x"), on("x", "x")).join(side("y"), on("y", "y") & (F.col("zx") <= F.col("zy")) & near)
        pairs = written(pairs.select("label", "length", F.col("zx").alias("x"), F.col("zy").alias("y")), "intervals")
    return pairs.select(F.shiftright("x", bits).alias("xp"), F.col("x").bitwiseAND((1 << bits) - 1).alias("xs"),
                        F.shiftright("y", bits).alias("yp"), F.col("y").bitwiseAND((1 << bits) - 1).alias("ys"))


def links(vectors: DataFrame, least: float) -> DataFrame:
    """``a, n, b``: how many links a vector ``a`` has in a pair of blocks, or (``n`` null) that it is connected with ``b``.

    ``vectors`` has ``u`` (a number), ``label`` (text, not null), ``v`` (a sound vector), ``w`` (how many copies).
    """
    width = vectors.agg(F.max(F.size("v")).alias("d")).first().d or 1
    kind = np.float64 if vectors.schema["v"].dataType.elementType.simpleString() == "double" else np.float32
    sample = vectors.orderBy(F.xxhash64("v"), "u").limit(SAMPLE).select("v").toPandas().v.tolist()
    length = np.array([len(x) for x in sample], np.int64)
    values = np.concatenate(sample) if sample else np.zeros(0)
    axes = directions(unit(_raw(values, length, width)), DIRECTIONS)
    epsilon = math.sqrt(max(2 - 2 * least, 1e-12))
    blocks = written(_sequences(vectors, width, axes, epsilon), "blocks")
    pairs = _pairs(blocks, epsilon * epsilon + _ROUNDING, axes.shape[1])
    pairs = pairs.select(F.explode(F.array(*(F.struct(F.col(f"{s}p").alias("part"), F.col(f"{s}s").alias("seq"), F.lit(i).alias("side")) for i, s in enumerate("xy")))).alias("b"),
                         F.struct("xp", "xs", "yp", "ys").alias("pair"))
    pairs = pairs.select("pair", "b.part", "b.seq", "b.side").filter("side = 0 or pair.xp <> pair.yp or pair.xs <> pair.ys")
    # the blocks go to their pairs once, each pair is one group of two blocks
    dealt = pairs.join(blocks.select("part", "seq", "length", "u", "w", "raw"), ["part", "seq"])

    def run(group: pa.Table) -> pa.Table:
        sides = sorted(group.to_pylist(), key=lambda r: r["side"])

        def sequence(row: dict) -> _Sequence:
            count = len(row["u"]) // 8
            values = np.frombuffer(row["raw"], kind).astype(np.float64)
            raw = _raw(values, np.full(count, row["length"]), width)
            return _Sequence(raw, unit(raw) @ axes, np.frombuffer(row["w"], np.int64))

        names = [np.frombuffer(row["u"], np.int64) for row in sides]
        first = sequence(sides[0])
        same = len(sides) == 1
        x, y, root = join(first, first if same else sequence(sides[1]), least, same)
        u = names[0] if same else np.concatenate(names)
        n = x + y if same else np.concatenate((x, y))
        counted, moved = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(root)))
        none = np.zeros(0, np.int64)
        a = pa.array(np.concatenate((u[counted], u[moved])))
        n = pa.concat_arrays([pa.array(n[counted]), pa.nulls(len(moved), pa.int64())])
        b = pa.concat_arrays([pa.nulls(len(counted), pa.int64()), pa.array(u[root[moved]] if len(moved) else none)])
        return pa.Table.from_arrays([a, n, b], names=["a", "n", "b"])

    return written(dealt.groupBy("pair").applyInArrow(run, "a long, n long, b long"), "links")


def near_vectors(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST) -> DataFrame:
    """``id, n_links, component_id, kept`` of each row: how many other rows are linked with it directly, and the
    least id that links lead to."""
    able = sound(vector) & F.exists(col(vector), lambda x: x != 0) & col(label).isNotNull()
    kind = "double" if vectors.schema[vector].dataType.elementType.simpleString() not in ("float", "double") else None
    v = col(vector).cast("array<double>") if kind else col(vector)
    rows = vectors.select(col(id).alias("k"), F.when(able, col(label).cast("string")).alias("label"), F.when(able, v).alias("v"))
    mark = [F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(1), "v", "label").alias("h2")]  # 128 bits stand for a vector
    narrow = written(rows.select("k", F.col("label").isNotNull().alias("able"), *mark), "rows")
    one = rows.filter("label is not null").groupBy("label", "v").agg(F.min("k").alias("name"), F.count("*").alias("w"))
    one = written(one.withColumn("u", F.monotonically_increasing_id()), "vectors")
    found = links(one.select("u", "label", "v", "w"), least)
    counts = found.filter("n is not null").groupBy("a").agg(F.sum("n").alias("n"))
    groups = components(found.filter("b is not null").select("a", "b"))
    single = one.select("u", "name", "w", *mark).join(groups, F.col("u") == F.col("node"), "left").join(counts, F.col("u") == F.col("a"), "left")
    single = written(single.select("h1", "h2", "name", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("component", "u").alias("c")), "single")
    names = written(single.groupBy("c").agg(F.min("name").alias("least")), "names")
    single = written(single.join(names, "c").select("h1", "h2", "n", "least"), "named")
    full = narrow.filter("able").join(single, ["h1", "h2"]).select("k", "n", "least")
    alone = narrow.filter("not able").select("k", F.lit(0).cast("long").alias("n"), F.col("k").alias("least"))
    return full.union(alone).select(F.col("k").alias(id), F.col("n").alias("n_links"), F.col("least").alias("component_id"), F.col("k").eqNullSafe(F.col("least")).alias("kept"))


_SQL = """
    WITH RECURSIVE k AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM k a JOIN k b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
    r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1),
    n AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""


@query("op11_vector_links", _SQL)
def op11_vector_links(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
