"""Document fingerprints by one-permutation MinHash.

The hash of each distinct word shingle picks a bin and a value; a bin keeps its least value. Empty bins
are filled by optimal densification: a fixed sequence of bins, chosen by hash for each empty bin, is
tried until one is found that was not empty. ``BITS`` low bits of each bin are packed. Two fingerprints
agree by chance in one bin of 2^``BITS``; the likeness is corrected for that, and is an estimate of the
Jaccard similarity of the shingle sets.

Cases: a text without words (null, empty, signs only) has an empty fingerprint, whose likeness is 1 to
another empty one and 0 to all others; a text of fewer words than a shingle has one shingle of all.
Documents are in the order of their ids, rows without id first, equal ids by a hash of their texts; the
document after the last is the first, so a single document is its own next. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rowloom.llm.common import blocks, col, text_hash, written
from rowloom.llm.registry import query, table
from rowloom.llm.words import U64, mix, shingles, words_of

BINS = 256
BITS = 4
SHINGLE = 5
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)
_SEED = U64(0x2545F4914F6CDD1D)


def bin_minima(elements: np.ndarray, begin: np.ndarray, bins: int) -> np.ndarray:
    """Least value per bin of each set of hashes, empty bins filled; sets without elements stay empty."""
    sets = len(begin) - 1
    hashes = mix(elements ^ _SEED)
    bin_ = ((hashes >> U64(32)) * U64(bins)) >> U64(32)
    best = np.full(sets * bins, _EMPTY, U64)
    owner = np.repeat(np.arange(sets), np.diff(begin))
    np.minimum.at(best, owner * bins + bin_.astype(np.int64), hashes & U64(0xFFFFFFFF))
    filled = best != _EMPTY
    open_ = np.flatnonzero(~filled & np.repeat(np.diff(begin) > 0, bins))
    attempt = 0
    while len(open_):
        attempt += 1
        own = (open_ % bins).astype(U64)
        other = mix(own * U64(0x9E3779B97F4A7C15) + U64(attempt)) % U64(bins)
        source = open_ - open_ % bins + other.astype(np.int64)
        found = filled[source]
        best[open_[found]] = best[source[found]]
        open_ = open_[~found]
    return best.reshape(sets, bins)


def pack(minima: np.ndarray, bits: int) -> np.ndarray:
    """Low bits of scrambled minima, packed to bytes."""
    low = (mix(minima) & U64((1 << bits) - 1)).astype(np.uint8)
    planes = (low[:, :, None] >> np.arange(bits, dtype=np.uint8)) & 1
    return np.packbits(planes.reshape(len(low), low.shape[1] * bits), axis=1)


def fingerprints(texts: list[str | None], *, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> list[bytes]:
    elements, _, begin = shingles(words_of(pa.array(texts, pa.string())), shingle)
    packed = pack(bin_minima(elements, begin, bins), bits)
    return [packed[i].tobytes() if begin[i + 1] > begin[i] else b"" for i in range(len(texts))]


def likeness(a: bytes, b: bytes, bits: int = BITS) -> float:
    """Estimated similarity of two fingerprints, from 0 to 1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    differ = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(-1, bits).any(axis=1)
    chance = 2.0**-bits
    return float(min(1.0, max(0.0, (1.0 - differ.mean() - chance) / (1.0 - chance))))


def edited(text: str, following: str) -> str:
    """The last quarter of a text, in code points, replaced by as much of the beginning of the next."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _rows(texts: list[str], following: list[str], prints: list[bytes], next_prints: list[bytes]) -> list[list]:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    other = fingerprints(changed)
    return [
        [len(t) for t in texts],
        [hashlib.sha256(c.encode()).hexdigest() for c in changed],
        prints,
        other,
        [likeness(a, b) for a, b in zip(prints, other, strict=True)],
        [likeness(a, b) for a, b in zip(prints, next_prints, strict=True)],
    ]


_COLUMNS = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and the likeness to it and to the
    next document's.

    Documents are dealt to ranges of ids once. Only the first and the last document of each range leave
    their task: two rows per partition, which are put together afterwards.
    """
    narrow = docs.select(col(id).alias("k"), text_hash(text).alias("r"), F.coalesce(col(text), F.lit("")).alias("t"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = narrow.repartitionByRange(parts, "k", "r").sortWithinPartitions("k", "r")
    names = [f.split()[0] for f in _COLUMNS.split(", ")]
    fields = [T.StructField("k", narrow.schema["k"].dataType), *T.StructType.fromDDL(_COLUMNS).fields]
    schema = T.StructType([*fields, *T.StructType.fromDDL("part int, edge string, t string").fields])
    types = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]

    def edge(key: pa.Array, text: str, kind: str, print_: bytes) -> pa.RecordBatch:
        values = [None, None, print_, None, None, None]
        return pa.RecordBatch.from_arrays(
            [key, *(pa.array([v], t) for v, t in zip(values, types, strict=True)),
             pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([kind]), pa.array([text])], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, text and fingerprint of the row before
        for batch in batches:
            for block in blocks(batch, 2):
                keys, texts = block.column(0), block.column(2).to_pylist()
                prints = fingerprints(texts)
                if last is None:
                    yield edge(keys.slice(0, 1), texts[0], "head", prints[0])
                else:
                    keys = pa.concat_arrays([last[0], keys])
                    texts, prints = [last[1], *texts], [last[2], *prints]
                columns = _rows(texts[:-1], texts[1:], prints[:-1], prints[1:])
                n = len(texts) - 1
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(0, n), *(pa.array(c, t) for c, t in zip(columns, types, strict=True)),
                         pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], schema.names)
                last = (keys.slice(n, 1), texts[-1], prints[-1])
        if last is not None:
            yield edge(last[0], last[1], "tail", last[2])

    done = written(ordered.mapInArrow(run, schema), "fingerprints")
    # two rows a partition: each tail's next document is the head of the next filled partition
    edges = done.filter("edge is not null")
    heads = edges.filter("edge = 'head'")
    order = Window.orderBy("part")
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pick = F.struct(F.col("t").alias("nt"), F.col("fingerprint").alias("np"))
    heads = heads.select(F.col("part").alias("p"), F.coalesce(F.lead(pick).over(order), F.first(pick).over(everything)).alias("n"))
    tails = edges.filter("edge = 'tail'").join(heads, F.col("part") == F.col("p")).select("k", "t", "fingerprint", "n.nt", "n.np")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, 1):
                own = block.to_pydict()
                columns = _rows(own["t"], own["nt"], own["fingerprint"], own["np"])
                yield pa.RecordBatch.from_arrays([block.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["k", *names])

    whole = done.filter("edge is null").select("k", *names).union(tails.mapInArrow(close, T.StructType(fields)))
    return whole.withColumnRenamed("k", id)


@query("op10_fingerprints")
def op10_fingerprints(spark, sf_dir):
    found = compare_with_next(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
