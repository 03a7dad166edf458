"""Near duplicates by DartMinHash signatures, banding and an exact check.

Darts are thrown by hash at each element (a word shingle of the document): in every slab of the
element's weight axis a Poisson process of ranks, each dart with a position in the slab and one of
``k`` coordinates. A document takes the darts that lie below its elements' weights, and keeps the
earliest per coordinate. Two documents agree in a coordinate with the probability of their weighted
Jaccard similarity, and a document of any length needs about k ln k + 2k darts.

Runs of ``rows`` coordinates are the bands. In each bucket of a band all members are compared with its
least and its largest member; that leaves few components. Then members of different components that
share a bucket are compared with each other. Left out are pairs that cannot be similar, as too many
of their shingles stand in no other set in question, or whose longer signatures differ by over five standard
deviations more than those of similar sets. Pairs inside one component need no check, as they could
not change it. All comparisons are exact, on the whole shingle sets.

With 20 bands of 5 coordinates a pair of similarity 0.8 shares a bucket with probability 0.9996.

Cases: equal texts are one class and are compared once. A null text is a class of its own, a text
without words has no near copies, a text of fewer words than a shingle has one shingle of all. A class
is named by its least document id; rows without id are copies like others, and a class of such rows
alone has a null name. Extra columns of any name pass through :func:`keep_one` unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import blocks, col, fresh, sifted, written
from rowloom.llm.components import components
from rowloom.llm.registry import query, table
from rowloom.llm.words import U64, mix, shingles, words_of

BANDS, ROWS = 20, 5
SHINGLE = 5
SIMILARITY = 0.8
#: Coordinates of the longer signatures that pairs of different components are sifted by.
SKETCH = 512
#: Darts or elements that a task holds at once; their number follows the sets, not the bytes of text.
DARTS = 1 << 18
#: Signatures that a task holds at once, whatever the length of their texts.
SETS = 2048
#: Bits of the map that texts are sifted by before they are shuffled: 4 MB are broadcast, whatever the data.
SIEVE_BITS = 1 << 25
_SLAB, _DART, _PLACE, _BAND = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, U64(0x8EBC6AF09C88C6E3), 0x589965CC75374CC3


def _times(n: int, factor: int) -> np.uint64:
    return U64(n * factor & 0xFFFFFFFFFFFFFFFF)


def dart_signatures(elements: np.ndarray, weights: np.ndarray, begin: np.ndarray, k: int) -> np.ndarray:
    """Signature of each set of weighted elements (hashes); zeros for an empty set.

    Works on so many sets at once that they have about ``DARTS`` darts, and on ``DARTS`` elements of a larger set.
    """
    sets = len(begin) - 1
    out = np.zeros((sets, k), U64)
    most = max(1, int(DARTS / (k * (math.log(k) + 2))))
    for start in range(0, sets, most):
        stop = min(start + most, sets)
        cut = slice(begin[start], begin[stop])
        _signatures(elements[cut], weights[cut], begin[start:stop + 1] - begin[start], k, out[start:stop])
    return out


def _signatures(elements: np.ndarray, weights: np.ndarray, begin: np.ndarray, k: int, out: np.ndarray) -> None:
    sets = len(out)
    owner = np.repeat(np.arange(sets), np.diff(begin))
    total = np.bincount(owner, weights, sets)
    with np.errstate(divide="ignore"):
        limit = k * (math.log(k) + 2) / total  # ranks looked at first; about k ln k + 2k darts
    open_ = np.flatnonzero(total > 0)
    signature = out.reshape(-1)
    while len(open_):
        chosen = np.zeros(sets, bool)
        chosen[open_] = True
        at = np.flatnonzero(chosen[owner] & (weights > 0))
        best = np.full(sets * k, np.inf)
        for start in range(0, len(at), DARTS):
            part = at[start:start + DARTS]
            for slot, rank, dart in _throw(elements[part], weights[part], owner[part], limit, k):
                np.minimum.at(best, slot, rank)
                first = rank == best[slot]
                signature[slot[first]] = dart[first]
        open_ = open_[np.isinf(best.reshape(sets, k)[open_]).any(axis=1)]
        limit[open_] *= 2


def _throw(elements, weights, owner, limit, k):
    """Coordinate slot, rank and number of all darts below the weights and up to the rank limits, a few at a time."""
    slab, low, width = 0, 0.0, 1.0
    while len(elements):
        key = mix(elements ^ _times(slab, _SLAB))
        rank, w, o, n = np.zeros(len(key)), weights, owner, 0
        while len(key):
            n += 1
            dart = mix(key + _times(n, _DART))
            rank = rank - np.log1p(-(dart >> U64(11)).astype(np.float64) * 2.0**-53) / width
            alive = rank < limit[o]
            key, dart, rank, w, o = key[alive], dart[alive], rank[alive], w[alive], o[alive]
            place = mix(dart ^ _PLACE)
            inside = low + (place & U64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * width < w
            coordinate = ((place >> U64(32)) * U64(k)) >> U64(32)
            yield (o * k + coordinate.astype(np.int64))[inside], rank[inside], dart[inside]
        slab, low, width = slab + 1, low + width, max(1.0, low + width)
        heavy = weights > low
        elements, weights, owner = elements[heavy], weights[heavy], owner[heavy]


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(signatures), bands), U64)
    for b in range(bands):
        total = np.full(len(signatures), _times(b + 1, _BAND), U64)
        for r in range(rows):
            total = mix(total * U64(_SLAB) + signatures[:, b * rows + r])
        out[:, b] = total
    return out


def _digest(text: str):
    """128 bits that stand for a text."""
    return F.substring(F.unhex(F.sha2(col(text), 256)), 1, 16)


def _name(id: str) -> Column:
    """An id as text that is never null, so that a join and the distinct rows after it share one shuffle."""
    return F.coalesce(col(id).cast("string"), F.lit(""))


def _lists(table: np.ndarray) -> pa.ListArray:
    ends = np.arange(0, table.size + 1, table.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(table.reshape(-1).view(np.int64)))


def _band_rows(texts: DataFrame, bands: int, rows: int, shingle: int, weighted: bool) -> DataFrame:
    """``d, buckets`` of ``texts (d, t)``, once for each text of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1, most=SETS):
                names = part.column(0).to_pylist()
                first = list({name: i for i, name in reversed(list(enumerate(names)))}.values())
                part = part.take(pa.array(sorted(first), pa.int64()))
                elements, times, begin = shingles(words_of(part.column(1)), shingle)
                weights = times.astype(np.float64) if weighted else np.ones(len(times))
                full = np.flatnonzero(np.diff(begin))
                signatures = dart_signatures(elements, weights, begin, bands * rows)[full]
                buckets = _lists(band_hashes(signatures, bands, rows))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(full)), buckets], ["d", "buckets"])

    return texts.mapInArrow(run, "d binary, buckets array<long>")


def _sets(texts: DataFrame, shingle: int, weighted: bool) -> DataFrame:
    """``d, s``: the sorted shingle hashes (and, if weighted, their counts) as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1):
                elements, times, begin = shingles(words_of(part.column(1)), shingle)
                packed = [elements[a:b].tobytes() + (times[a:b].tobytes() if weighted else b"") for a, b in zip(begin, begin[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["d", "s"])

    return texts.mapInArrow(run, "d binary, s binary")


def similarity(a: bytes, b: bytes, weighted: bool) -> float:
    """Jaccard similarity of two packed sets."""
    x, y = np.frombuffer(a, U64), np.frombuffer(b, U64)
    if not weighted:
        if len(x) > len(y):
            x, y = y, x
        shared = int((np.append(y, ~y[-1])[np.searchsorted(y, x)] == x).sum()) if len(x) else 0
        return shared / max(1, len(x) + len(y) - shared)
    (x, p), (y, q) = np.split(x, 2), np.split(y, 2)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(p[i], q[j]).sum())
    return shared / max(1, int(p.sum()) + int(q.sum()) - shared)


def _verified(pairs: DataFrame, sets: DataFrame, least: float, weighted: bool) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar."""
    left = sets.select(F.col("d").alias("a"), F.col("s").alias("x"))
    right = sets.select(F.col("d").alias("b"), F.col("s").alias("y"))
    short, long = F.least(F.octet_length("x"), F.octet_length("y")), F.greatest(F.octet_length("x"), F.octet_length("y"))
    both = pairs.join(left, "a").join(right, "b")
    both = both if weighted else both.filter(short >= long * least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similarity(x, y, weighted) >= least for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _pair(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _sketch(signatures: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, 16 to a number; the last number is filled up with zeros."""
    bits = (signatures & U64(15)).astype(U64)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 16))).reshape(len(bits), -(-signatures.shape[1] // 16), 16)
    return np.bitwise_or.reduce(bits << (np.arange(16, dtype=U64) * U64(4)), axis=2)


def _apart(x: str, y: str, numbers: int) -> Column:
    """In how many coordinates two sketches differ."""
    total = F.lit(0)
    for i in range(numbers):
        z = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(0x1111111111111111))
        total = total + F.bit_count(z)
    return total


def _most_apart(k: int, least: float) -> int:
    """Differing coordinates that similar sets have at most, but for one pair in about three million (five standard deviations)."""
    p = (1 - least) * 15 / 16
    return math.ceil(k * p + 5 * math.sqrt(k * p * (1 - p)))


def _mixed(members: DataFrame, groups: DataFrame) -> DataFrame:
    """``bucket, d, c`` of the buckets whose members belong to several groups."""
    known = members.join(groups, F.col("d") == F.col("node"), "left").withColumn("c", F.coalesce("component", "d"))
    known = written(known.select("bucket", "d", "c"), "known")
    mixed = known.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("bucket")
    return known.join(written(mixed, "mixed"), "bucket")


def _details(loose: DataFrame, sets: DataFrame, weighted: bool) -> DataFrame:
    """``d, n, m, z``: size of each set in question, how much of it stands in another one too (more it
    cannot share with any), and a longer signature in four bits a coordinate."""
    own = written(sets.join(loose.select("d").distinct(), "d", "left_semi"), "own")

    def unpacked(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
        pairs = [np.split(x, 2) if weighted else (x, np.ones(len(x), np.int64)) for x in found]
        begin = np.concatenate(([0], np.cumsum([len(x) for x, _ in pairs])))
        return np.concatenate([x for x, _ in pairs]), np.concatenate([w for _, w in pairs]), begin

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1, most=SETS):
                x, w, begin = unpacked(part)
                lists = _lists(_sketch(dart_signatures(x.view(U64), w.astype(np.float64), begin, SKETCH)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.add.reduceat(w, begin[:-1])), lists], ["d", "n", "z"])

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1):
                x, w, begin = unpacked(part)
                owner = pa.array(np.repeat(np.arange(len(begin) - 1), np.diff(begin)))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(w), part.column(0).take(owner)], ["h", "w", "d"])

    single = own.mapInArrow(elements, "h long, w long, d binary").groupBy("h").agg(
        F.count("*").alias("k"), F.max("w").alias("w"), F.min("d").alias("one")).filter("k = 1")
    single = single.groupBy("one").agg(F.sum("w").alias("single"))
    found = own.mapInArrow(sketch, "d binary, n long, z array<long>")
    return found.join(single, F.col("d") == F.col("one"), "left").select("d", "n", (F.col("n") - F.coalesce("single", F.lit(0))).alias("m"), "z")


def links(
    texts: DataFrame, *, least: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, weighted: bool = False,
) -> DataFrame:
    """``node, component`` of the near-duplicate graph of ``texts (d, k, t)``: digest, id, text."""
    found = written(_band_rows(texts.select("d", "t"), bands, rows, shingle, weighted), "signatures")
    found = found.select(F.explode("buckets").alias("bucket"), "d")
    shared = found.groupBy("bucket").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).filter("lo <> hi")
    members = written(found.join(written(shared, "buckets"), "bucket").distinct(), "members")
    tried = members.select("d", F.explode(F.array("lo", "hi")).alias("l")).filter("d <> l").select(*_pair("d", "l")).distinct()
    tried = written(tried, "star")

    one = members.select("d").distinct().join(texts.groupBy("d").agg(F.min("k").alias("k")), "d")
    one = written(one, "nodes").select(F.col("d").alias("d2"), _name("k").alias("n2"))
    # an inner join, as Spark would move a semi join in front of the sieve; one has each text once
    own = sifted(texts.select("d", _name("k").alias("n"), "t"), ["d", "n"], one, ["d2", "n2"], SIEVE_BITS).join(one, (F.col("d") == F.col("d2")) & (F.col("n") == F.col("n2")))
    own = own.dropDuplicates(["d", "n"])
    sets = written(_sets(own.select("d", "t"), shingle, weighted), "sets")

    close = written(_verified(tried, sets, least, weighted), "close")
    # what is still in different groups is compared pair by pair, unless the two cannot be similar
    loose = written(_mixed(members.select("bucket", "d"), components(close)), "loose")
    own = loose.groupBy("d").agg(F.collect_set("bucket").alias("all"))  # one bucket a band at most
    details = _details(loose, sets, weighted).filter(F.col("m") >= least * F.col("n")).join(own, "d")
    loose = loose.join(written(details, "details"), "d")
    loose = written(loose, "loose2")
    other = loose.select(*(F.col(c).alias(f"{c}2") for c in loose.columns))
    shared = F.least("m", "m2")
    near = (shared >= least * (F.col("n") + F.col("n2") - shared)) & (_apart("z", "z2", SKETCH // 16) <= _most_apart(SKETCH, least))
    near = near & (F.array_min(F.array_intersect("all", "all2")) == F.col("bucket"))  # a pair once, not in each bucket
    rest = loose.join(other, (F.col("bucket") == F.col("bucket2")) & (F.col("c") < F.col("c2")) & near)
    rest = written(rest.select(*_pair("d", "d2")).distinct().join(tried, ["a", "b"], "left_anti"), "rest")
    return components(close.union(_verified(rest, sets, least, weighted)))


def classes(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", least: float = SIMILARITY, shingle: int = SHINGLE,
    bands: int = BANDS, rows: int = ROWS, weighted: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``k, d`` of each row with a text, and for each text ``d`` its class.

    The class is given by ``class_id`` and ``class_d``, the document kept for it, and ``text_id``
    is the least id of the documents with this very text.
    """
    texts = docs.filter(col(text).isNotNull()).select(_digest(text).alias("d"), col(id).alias("k"), col(text).alias("t"))
    narrow = written(texts.select("d", "k"), "digests")
    groups = links(texts, least=least, shingle=shingle, bands=bands, rows=rows, weighted=weighted)
    single = narrow.groupBy("d").agg(F.min("k").alias("text_id"), F.count("*").alias("copies"))
    single = single.join(groups, F.col("d") == F.col("node"), "left").withColumn("c", F.coalesce("component", "d"))
    single = written(single.select("d", "c", "text_id", "copies"), "texts")
    best = single.groupBy("c").agg(
        F.min(F.struct(F.col("text_id").isNull().alias("none"), "text_id", "d")).alias("best"),
        F.count("*").alias("class_texts"), F.sum("copies").alias("class_docs"))
    best = written(best.select("c", F.col("best.text_id").alias("class_id"), F.col("best.d").alias("class_d"), "class_texts", "class_docs"), "classes")
    return narrow, written(single.join(best, "c").select("d", "text_id", "class_id", "class_d", "class_texts", "class_docs"), "labels")


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: its id, ``class_id``, ``text_id`` (least id with this very text), and how many
    different texts and documents the class has."""
    narrow, labels = classes(docs, id=id, text=text, **options)
    one = F.lit(1).cast("long")
    found = narrow.join(labels, "d").select(F.col("k").alias(id), "class_id", "text_id", "class_texts", "class_docs")
    alone = docs.filter(col(text).isNull()).select(col(id).alias(id), col(id).alias("class_id"), col(id).alias("text_id"), one.alias("class_texts"), one.alias("class_docs"))
    return found.union(alone)


def keep_one(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class: that of the least id. Null texts all stay."""
    _, labels = classes(docs, id=id, text=text, **options)
    digest, name = fresh(docs, "digest"), fresh(docs, "name")
    best = labels.filter("d = class_d").select(F.col("d").alias(f"{digest}_kept"), _name("class_id").alias(f"{name}_kept"))
    full = docs.filter(col(text).isNotNull()).withColumns({digest: _digest(text), name: _name(id)})
    kept = full.join(best, (col(digest) == col(f"{digest}_kept")) & (col(name) == col(f"{name}_kept")), "left_semi")
    kept = kept.dropDuplicates([digest, name]).drop(digest, name)
    return kept.union(docs.filter(col(text).isNull()))


@query("op2_near_duplicates")
def op2_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
