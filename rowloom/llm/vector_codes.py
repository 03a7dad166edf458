"""Product codes of vectors, with codebooks whose nearest entries are found by equal-average search.

Components become integers, vectors are cut into consecutive parts, and each part position has a
codebook. The entries of a codebook are sorted by the sum of their components. From the place of a
part's own sum the search goes outward to both sides, always to the entry of the nearer sum, and ends
when the squared gap of the sums over the length of a part strictly exceeds the best distance so far:
by the inequality of Cauchy and Schwarz no entry further out is nearer or as near.

A round assigns all parts and replaces each entry by the floor of the mean of its parts. Tasks add up
their parts by entry first, so only sums by entry are shuffled; the codebooks (``parts`` x ``entries``
entries, whatever the data) are the only thing that driver and tasks share.

Cases: vectors that are null or hold null or non-finite components are dropped, and so are vectors of
another length than most (a tie goes to the longer). Components of 2^16 or more stop the job, and so
does a length that ``parts`` does not divide. Repeated rows are rows of their own; rows without id come
after all others when the first codebook is chosen, equal ids are taken in the order of their vectors.
With fewer rows than entries the codebook has an entry a row; no row gives no codes. Rows without label
are a group of their own. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import col, written
from rowloom.llm.registry import query, table
from rowloom.llm.vectors import common_length, floors, matrix, sound

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that a task works on at once.
_ROWS = 4096


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest entry of each point (the lowest of a tie), and the squared distance to it."""
    n, width = points.shape
    k = len(book)
    order = np.argsort(book.sum(axis=1), kind="stable")
    entries = book[order]
    sums = entries.sum(axis=1)
    own = points.sum(axis=1)
    right = np.searchsorted(sums, own)
    left = right - 1
    far = np.iinfo(np.int64).max
    best, number = np.full(n, far), np.full(n, k)
    rows = np.arange(n)
    while len(rows):
        l, r, o = left[rows], right[rows], own[rows]
        below = np.where(l >= 0, o - sums[l], far)
        above = np.where(r < k, sums[np.minimum(r, k - 1)] - o, far)
        down = below <= above
        gap = np.where(down, below, above)
        there = gap < far
        gap[~there] = 0
        # in whole numbers: gap^2 / width > best is the same as ceil(gap^2 / width) > best
        there &= -(-gap * gap // width) <= best[rows]
        rows, down = rows[there], down[there]
        at = np.where(down, l[there], r[there])
        gaps = points[rows] - entries[at]
        distance = (gaps * gaps).sum(axis=1)
        entry = order[at]
        better = (distance < best[rows]) | ((distance == best[rows]) & (entry < number[rows]))
        best[rows[better]], number[rows[better]] = distance[better], entry[better]
        left[rows[down]] -= 1
        right[rows[~down]] += 1
    return number, best


def _assigned(batches: Iterator[pa.RecordBatch], column: int, books: np.ndarray):
    """Slices of the batches, with the parts of their vectors, the entry of each part and its distance."""
    parts, _, width = books.shape
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            piece = batch.slice(start, _ROWS)
            points = matrix(piece.column(column), parts * width, np.int64).reshape(-1, parts, width)
            found = [nearest(points[:, p], books[p]) for p in range(parts)]
            yield piece, points, np.stack([x for x, _ in found], 1), np.stack([x for _, x in found], 1)


def _means(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * k, width + 1), np.int64)  # the sums, and how many
        for _, points, entry, _ in _assigned(batches, 0, books):
            slot = (entry + np.arange(parts) * k).reshape(-1)
            np.add.at(total, slot, np.pad(points.reshape(-1, width), ((0, 0), (0, 1)), constant_values=1))
        at = np.repeat(total[:, width] > 0, width + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(at)), pa.array(total.reshape(-1)[at])], ["place", "total"])

    sums = rows.select("x").mapInArrow(run, "place long, total long").groupBy("place").agg(F.sum("total").alias("total"))
    total = np.zeros(parts * k * (width + 1), np.int64)
    for place, value in sums.collect():  # as many numbers as the codebooks have, whatever the data
        total[place] = value
    total = total.reshape(parts, k, width + 1)
    count = total[:, :, width:]
    return np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), books)


def _kept(vectors: DataFrame, id: str, vector: str, label: str, scale: int) -> tuple[DataFrame, int]:
    rows = vectors.filter(sound(vector)).select(col(id).alias("k"), col(label).alias("g"), col(vector).alias("v"))
    length = common_length(rows, "v")
    return rows.filter(F.size("v") == length).select("k", "g", floors("v", scale).alias("x")), length


def fit(
    vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> np.ndarray:
    """Codebooks by part, entry and position; they begin as the parts of the rows of the least ids."""
    rows, length = _kept(vectors, id, vector, label, scale)
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    first = rows.orderBy(F.col("k").asc_nulls_last(), "x").limit(entries).select("x").collect() if length else []
    books = np.array([r.x for r in first], np.int64).reshape(len(first), parts, length // parts).transpose(1, 0, 2)
    for _ in range(rounds if first else 0):
        books = _means(rows, books)
    return books


def encode(
    vectors: DataFrame, books: np.ndarray, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE,
) -> DataFrame:
    """``id, label, code, error`` of each kept row: two hex digits a part, and the summed squared distances."""
    rows, length = _kept(vectors, id, vector, label, scale)
    kinds = f"k {rows.schema['k'].dataType.simpleString()}, g {rows.schema['g'].dataType.simpleString()}, code string, error long"
    if length and books.size == 0:
        raise ValueError("codebooks without entries can't encode vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, _, entry, distance in _assigned(batches, 2, books) if books.size else ():
            digits = entry.astype(np.uint8).tobytes().hex()
            width = 2 * entry.shape[1]
            code = [digits[i:i + width] for i in range(0, len(digits), width)]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(code, pa.string()), pa.array(distance.sum(axis=1))], ["k", "g", "code", "error"])

    found = rows.mapInArrow(run, kinds)
    return found.select(col("k").alias(id), col("g").alias(label), "code", "error")


def decode(codes: DataFrame, books: np.ndarray, *, code: str = "code", name: str = "vector", scale: int = SCALE) -> DataFrame:
    """``codes`` with the vector that each code stands for."""
    parts, k, width = books.shape
    entries = F.array(*(F.array(*(F.lit(float(x)) for x in entry)) for entry in (books.reshape(parts * k, width) / scale)))
    number = lambda p: F.conv(F.substring(col(code), 2 * p + 1, 2), 16, 10).cast("int") + p * k + 1
    return codes.withColumn(name, F.flatten(F.array(*(F.element_at(entries, number(p)) for p in range(parts)))))


def label_errors(codes: DataFrame, *, label: str = "label", name: str = "label_error") -> DataFrame:
    """``codes`` with the error summed over each label; rows without label are one group."""
    sums = codes.groupBy(col(label).alias("_g")).agg(F.sum("error").alias("_e"))
    return codes.join(sums, col(label).eqNullSafe(F.col("_g"))).withColumn(name, F.col("_e")).drop("_g", "_e")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, in decimal, with commas between."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def _sql() -> str:
    rounds = []
    for r in range(ROUNDS + 1):
        rounds.append(f"""
        a{r} AS (SELECT p.vec_id, p.part, p.v, min(list_sum(list_transform(list_zip(p.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {ENTRIES} + b.entry) AS best
          FROM p JOIN b{r} b ON p.part = b.part GROUP BY p.vec_id, p.part, p.v)""")
        if r < ROUNDS:
            mean = ", ".join(f"floor(sum(v[{i}])::DOUBLE / count(*))::BIGINT" for i in range(1, 5))
            rounds.append(f"""
        m{r} AS (SELECT part, best % {ENTRIES} AS entry, [{mean}] AS c FROM a{r} GROUP BY 1, 2),
        b{r + 1} AS (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON b.part = m.part AND b.entry = m.entry)""")
    return f"""
        WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        p AS (SELECT vec_id, part, x[part * 4 + 1 : part * 4 + 4] AS v FROM k, range({PARTS}) r(part)),
        f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < {ENTRIES}),
        b0 AS (SELECT part, entry, v AS c FROM p JOIN f USING (vec_id)),{",".join(rounds)},
        e AS (SELECT vec_id, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY part) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} GROUP BY 1),
        d AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN k USING (vec_id), d"""


@query("op12_vector_codes", _sql())
def op12_vector_codes(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    books = fit(vectors)
    codes = label_errors(written(encode(vectors, books), "codes"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
