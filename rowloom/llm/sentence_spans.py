"""Substring dedup by sliding sentence spans.

Texts are cut into sentences: after ``.``, ``!``, ``?`` or a line break between two words. A sentence of
more than ``LONG`` words is cut further, after words chosen by their hash, so that equal text is cut
alike wherever it stands. Every run of ``span`` consecutive sentences is hashed (by the words, so case
and punctuation do not matter) and joined over all documents. Its first place, by document id and
position, stays; the sentences of all others are covered. So are runs of ``RUN`` words, whatever
sentences they stand in: of each ``NEXT`` neighbouring runs the one of the least hash is joined, so a
repeated passage of ``RUN + NEXT - 1`` = 51 words or more always has a run in common with its first
place, and at most ``NEXT - 1`` of its words at either end are not covered. Covered stretches with
fewer than ``min_words`` words stay, all longer ones are removed.

Cases: a null text stays null; an empty or wordless text stays as it is; rows of equal id and text are
one document and are cut alike; a row without id comes before all others; a text of fewer sentences
than a span has none. A document that only repeats others becomes empty, and its row stays. Extra
columns of any name pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.common import blocks, col, fresh, sifted, text_hash, written
from rowloom.llm.registry import query, table
from rowloom.llm.words import U64, WORD_BASE, Words, mix, windows, words_of

SPAN = 2
MIN_WORDS = 25
LONG = 40
#: One word in so many ends a piece of a long sentence.
CUT = 12
#: Words of a run, and of how many neighbouring runs one is joined.
RUN = 40
NEXT = 12
#: Added to the first word of a run, to tell its place from the number of a sentence.
WORD_PLACE = 1 << 30
#: Bits of the map that spans are sifted by before they are written: 16 MB are broadcast, whatever the data.
SIEVE_BITS = 1 << 27
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True


def sentences(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of each sentence, and where each text's sentences begin among them."""
    n = len(w.hash)
    marks = np.concatenate(([0], np.cumsum(_END[w.buffer])))
    begins = np.zeros(n, bool)
    begins[w.first[:-1][w.counts > 0]] = True
    if n:
        begins[1:] |= marks[w.start[1:]] > marks[w.end[:-1]]
    first = np.flatnonzero(begins)
    length = np.diff(np.append(first, n))
    long = np.repeat(length > LONG, length)
    if long.any():
        begins[1:] |= long[:-1] & long[1:] & (w.hash[:-1] % U64(CUT) == 0)
        first = np.flatnonzero(begins)
    return first, np.searchsorted(first, w.first)


def _span_hashes(w: Words, first: np.ndarray, begin: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``span`` sentences inside one text, and its first sentence."""
    if not len(first):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    ends = np.append(first[1:], len(w.hash))
    place = np.arange(len(w.hash)) - np.repeat(first, ends - first)
    powers = np.multiply.accumulate(np.concatenate((np.ones(1, U64), np.full(int(place.max()), WORD_BASE, U64))))
    one = mix(np.add.reduceat(w.hash * powers[place], first) + (ends - first).astype(U64))
    total = np.full(max(0, len(one) - span + 1), U64(span), U64)
    for j in range(span):
        total = mix(total * WORD_BASE + one[j : j + len(total)])
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    at = np.flatnonzero(owner[: len(total)] == owner[span - 1 :][: len(total)])
    return total[at], at


def _run_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of the least of each ``NEXT`` neighbouring runs of ``RUN`` words, the last of equal ones."""
    found, at = windows(w, RUN)
    n = len(found) - NEXT + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    least, place = found[:n].copy(), np.arange(n)
    for j in range(1, NEXT):
        lower = found[j : j + n] <= least
        least[lower] = found[j : j + n][lower]
        place[lower] = np.flatnonzero(lower) + j
    owner = w.owner[at]
    chosen = np.unique(place[owner[:n] == owner[NEXT - 1 :]])
    return found[chosen], at[chosen]


def spans(docs: DataFrame, *, id: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """``h, k, r, p``: hash of every span, id and text hash of its document, number of its first sentence.

    For runs of words ``p`` is ``WORD_PLACE`` plus the number of the first word.
    """
    narrow = docs.filter(col(text).isNotNull()).select(col(id).alias("k"), text_hash(text).alias("r"), col(text).alias("t"))
    schema = T.StructType([T.StructField("h", T.LongType()), *narrow.schema.fields[:2], T.StructField("p", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 2):
                w = words_of(part.column(2))
                first, begin = sentences(w)
                found, at = _span_hashes(w, first, begin, span)
                runs, word = _run_hashes(w)
                for hashes, places, base, zero in ((found, at, begin, 0), (runs, word, w.first, WORD_PLACE)):
                    owner = np.searchsorted(base, places, "right") - 1
                    who = part.select([0, 1]).take(pa.array(owner)).columns
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes.view(np.int64)), *who, pa.array((places - base[owner] + zero).astype(np.int32))], schema.names)

    return narrow.mapInArrow(run, schema)


def repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """``k, r, places``: the places of all non-first spans and runs of a document."""
    found = spans(docs, id=id, text=text, span=span)
    # most hashes occur once: they are counted alone, and hashed again rather than written with their places
    again = written(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("h").alias("a")), "again")
    found = written(sifted(found, ["h"], again, ["a"], SIEVE_BITS), "spans")
    # rows of equal id and text have equal places, so they are first together
    first = found.groupBy("h").agg(F.min(F.struct("k", "r", "p")).alias("f"), F.max(F.struct("k", "r", "p")).alias("g"))
    first = written(first.filter("f <> g").select("h", "f"), "first")
    again = found.join(first, "h").filter("struct(k, r, p) <> f")
    return again.groupBy("k", "r").agg(F.collect_set("p").alias("places"))


def _covered(w: Words, first: np.ndarray, begin: np.ndarray, text: int, places: list[int], span: int, min_words: int) -> list[tuple[int, int]]:
    """Byte spans of a text that go: covered stretches with ``min_words`` words or more."""
    a, b = int(w.first[text]), int(w.first[text + 1])
    begins = np.append(first, len(w.hash))
    at = np.array(places)
    word = at >= WORD_PLACE
    sentence, run = at[~word] + begin[text], at[word] - WORD_PLACE + a
    marks = np.zeros(b - a + 1, np.int64)
    np.add.at(marks, np.concatenate((begins[sentence], run)) - a, 1)
    np.add.at(marks, np.concatenate((begins[np.minimum(sentence + span, begin[text + 1])], run + RUN)) - a, -1)
    flags = np.concatenate(([0], np.cumsum(marks[:-1]) > 0, [0])).astype(np.int8)
    out = []
    for i, j in zip(np.flatnonzero(np.diff(flags) == 1) + a, np.flatnonzero(np.diff(flags) == -1) + a, strict=True):
        if j - i >= min_words:
            low = w.start[i] if i > a else w.offset[text]
            high = w.start[j] if j < b else w.offset[text + 1]
            out.append((int(low - w.offset[text]), int(high - w.offset[text])))
    return out


def remove_repeats(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", span: int = SPAN, min_words: int = MIN_WORDS, removed: str | None = None,
) -> DataFrame:
    """``docs`` with the repeated sentences cut out of ``text``.

    With ``removed``, a column of that name gets the byte spans cut out, as ``begin:end`` in order.
    """
    found = written(repeats(docs, id=id, text=text, span=span), "repeats")
    row, key, hash_, places = (fresh(docs, n) for n in ("row_hash", "key", "key_hash", "places"))
    found = found.select(F.col("k").alias(key), F.col("r").alias(hash_), F.col("places").alias(places))
    full = docs.withColumn(row, text_hash(text))
    full = full.join(found, col(id).eqNullSafe(col(key)) & (col(row) == col(hash_)), "left").select(*map(col, docs.columns), col(places))
    at = docs.columns.index(text)
    extra = [T.StructField(removed, T.StringType())] if removed else []
    schema = T.StructType([*docs.schema.fields, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, at):
                yield _without(part, at, span, min_words, schema.names)

    return full.mapInArrow(run, schema)


def _without(part: pa.RecordBatch, at: int, span: int, min_words: int, names: list[str]) -> pa.RecordBatch:
    """A batch whose last column lists the covered places, with its texts cut."""
    lists = part.column(part.num_columns - 1)
    hit = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)).tolist()
    texts, cut = part.column(at).to_pylist() if hit else None, [""] * part.num_rows
    if hit:
        chosen = part.column(at).take(pa.array(hit))
        w = words_of(chosen)
        first, begin = sentences(w)
        for n, i in enumerate(hit):
            gone = _covered(w, first, begin, n, lists[i].as_py(), span, min_words)
            if gone:
                data, last, kept = texts[i].encode(), 0, []
                for a, b in gone:
                    kept.append(data[last:a])
                    last = b
                texts[i] = b"".join([*kept, data[last:]]).decode()
                cut[i] = " ".join(f"{a}:{b}" for a, b in gone)
    columns = [pa.array(texts, part.column(at).type) if n == at and hit else part.column(n) for n in range(part.num_columns - 1)]
    return pa.RecordBatch.from_arrays(columns + ([pa.array(cut)] if len(names) > len(columns) else []), names)


@query("op7_sentence_spans")
def op7_sentence_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length("text").cast("long").alias("bytes_before"))
    cut = remove_repeats(docs, removed="removed")
    return cut.select("doc_id", "bytes_before", F.octet_length("text").cast("long").alias("bytes_after"), "removed", "text")
