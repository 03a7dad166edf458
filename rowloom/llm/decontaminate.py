"""Benchmark decontamination by word windows.

The windows of all benchmark items (13 consecutive words; an item of fewer words, but not none, is
one window) form a hash set. A scan of the documents looks up every word window in it, compares the
words of each hit, and marks the words inside as hit.

The set, as arrays, is broadcast only while its built size is within ``broadcast_bytes``. Beyond that the
windows of the documents are joined to those of the items by a 128-bit hash, whose words are not compared.

Cases: a null or wordless text has no hits; a null or wordless item has no windows; an item without
id marks words, but is not counted or named; items of the same id count once; repeated documents
each get their own row; without items nothing is hit. Columns other than id and text are not read by
:func:`contamination` and pass through :func:`remove` unchanged.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.common import blocks, col, fresh, text_hash, written
from rowloom.llm.registry import query, table
from rowloom.llm.words import LOWER, U64, Words, mix, windows, words_of

WINDOW = 13
BROADCAST_BYTES = 64 << 20
#: Of the built set: a window has a hash, two places, an item and the place of its items; an item its name.
WINDOW_BYTES = 36
ITEM_BYTES = 64
#: A document is contaminated if at least one in so many of its words is hit.
HIT_SHARE = 20

FINDINGS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class WindowSet:
    """Different windows of the items in arrays, by length, and the numbers of the items that hold them.

    ``names`` are the ids of the items, sorted as strings; an item without id has the number -1. The words
    of all items, joined by spaces, are kept once to compare the words of a hit.
    """

    def __init__(self, rows: list[tuple], window: int):
        self.names = sorted({str(item) for item, _ in rows if item is not None})
        number = {name: i for i, name in enumerate(self.names)}
        numbers = np.array([-1 if item is None else number[str(item)] for item, _ in rows], np.int32)
        w = words_of(pa.array([text for _, text in rows], pa.string()))
        lowered = LOWER[w.buffer].tobytes()
        self.words = b" ".join([lowered[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)])
        sizes = w.end - w.start
        start = np.cumsum(sizes + 1) - sizes - 1
        self.by_length = {}
        for length in range(1, window + 1):
            hashes, at = windows(w, length)
            owner = np.searchsorted(w.first, at, "right") - 1
            if length < window:
                whole = w.counts[owner] == length
                hashes, at, owner = hashes[whole], at[whole], owner[whole]
            if len(at):
                last = at + length - 1
                self.by_length[length] = self._grouped(hashes, start[at], start[last] + sizes[last], numbers[owner])

    def _grouped(self, hashes, begin, end, item) -> tuple[np.ndarray, ...]:
        """Hash, first and last byte of each different window, and where its items begin among all ``item``."""
        order = np.argsort(hashes, kind="stable")
        hashes, begin, end, item = hashes[order], begin[order], end[order], item[order]
        text = lambda i: self.words[begin[i] : end[i]]
        new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        again = np.flatnonzero(~new)
        if any(text(i) != text(i - 1) for i in again.tolist()):  # two texts of one hash: order its windows by text
            order = np.array(sorted(range(len(hashes)), key=lambda i: (hashes[i], text(i))))
            hashes, begin, end, item = hashes[order], begin[order], end[order], item[order]
            new[again] = [text(i) != text(i - 1) for i in again.tolist()]
        first = np.flatnonzero(new)
        return hashes[first], begin[first], end[first], np.append(first, len(item)), item

    def find(self, length: int, hash: int, at: int, text: bytes) -> int:
        """Number of the window among those of its length, or -1; ``at`` is the first one of its hash."""
        hashes, begin, end, *_ = self.by_length[length]
        while at < len(hashes) and hashes[at] == hash:
            if self.words[begin[at] : end[at]] == text:
                return at
            at += 1
        return -1

    def named(self, found: set[tuple[int, int]]) -> tuple[int, str]:
        """How many items hold the windows (length and number), and the digest of their ids."""
        held = [np.zeros(0, np.int32)]
        for length, at in found:
            *_, first, item = self.by_length[length]
            held.append(item[first[at] : first[at + 1]])
        numbers = np.unique(np.concatenate(held))
        names = [self.names[i] for i in numbers[numbers >= 0].tolist()]
        return len(names), hashlib.sha256(",".join(names).encode()).hexdigest()


def phrase(w: Words, lowered: bytes, at: int, length: int) -> bytes:
    return b" ".join([lowered[w.start[i] : w.end[i]] for i in range(at, at + length)])


def scan(texts: pa.Array, known: WindowSet) -> dict[str, list]:
    """Findings for each text of a block, and the byte spans that are hit."""
    w = words_of(texts)
    lowered = LOWER[w.buffer].tobytes()
    change = np.zeros(len(w.hash) + 1, np.int64)
    items: dict[int, set] = defaultdict(set)
    for length, (hashes, *_) in known.by_length.items():
        found, at = windows(w, length)
        likely = np.zeros(1 << 20, bool)  # by 20 bits of the hash, so that few windows need a search
        likely[(hashes >> U64(44)).astype(np.int64)] = True
        chosen = np.flatnonzero(likely[(found >> U64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(hashes, found[chosen]), len(hashes) - 1)
        same = hashes[place] == found[chosen]
        chosen, place = chosen[same], place[same]
        owners = np.searchsorted(w.first, at[chosen], "right") - 1
        for i, h, p, owner in zip(at[chosen].tolist(), found[chosen], place.tolist(), owners.tolist(), strict=True):
            number = known.find(length, h, p, phrase(w, lowered, i, length))
            if number >= 0:
                change[i] += 1
                change[i + length] -= 1
                items[owner].add((length, number))
    hit = np.cumsum(change[:-1]) > 0
    sums = np.concatenate(([0], np.cumsum(hit)))
    n_hit = sums[w.first[1:]] - sums[w.first[:-1]]
    named = [known.named(items.get(i, set())) for i in range(len(texts))]
    return {
        "n_words": w.counts.tolist(),
        "n_hit": n_hit.tolist(),
        "n_items": [n for n, _ in named],
        "items_sha256": [h for _, h in named],
        "contaminated": ((n_hit > 0) & (HIT_SHARE * n_hit >= w.counts)).tolist(),
        "spans": [_spans(w, hit, i) for i in range(len(texts))],
    }


def _spans(w: Words, hit: np.ndarray, text: int) -> list[tuple[int, int]]:
    """Byte spans of a text from the first to the last word of each stretch of hit words."""
    a, b = int(w.first[text]), int(w.first[text + 1])
    if not hit[a:b].any():
        return []
    flags = np.concatenate(([False], hit[a:b], [False]))
    begin = np.flatnonzero(flags[1:] & ~flags[:-1]) + a
    end = np.flatnonzero(flags[:-1] & ~flags[1:]) + a - 1
    base = int(w.offset[text])
    return [(int(w.start[i]) - base, int(w.end[j]) - base) for i, j in zip(begin, end, strict=True)]


def _small(items: DataFrame, item: str, text: str, limit: int) -> bool:
    """Whether the built set of windows is within ``limit`` bytes: texts, ids, and ``WINDOW_BYTES`` a word."""
    word = F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")
    size = F.octet_length(col(text)) + F.regexp_count(col(text), word) * WINDOW_BYTES
    name = F.octet_length(col(item).cast("string")) + ITEM_BYTES
    total = items.agg(F.sum(F.coalesce(size, F.lit(0)) + F.coalesce(name, F.lit(ITEM_BYTES)))).first()[0] or 0
    return total <= limit


def _window_set(items: DataFrame, item: str, text: str, window: int):
    rows = [tuple(r) for r in items.select(col(item), col(text)).collect()]
    return items.sparkSession.sparkContext.broadcast(WindowSet(rows, window))


def contamination(
    docs: DataFrame, items: DataFrame, *, id: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per document: its id and the findings (``FINDINGS``)."""
    if not _small(items, item, item_text, broadcast_bytes):
        return _joined(docs, items, id, text, item, item_text, window)
    known = _window_set(items, item, item_text, window)
    narrow = docs.select(col(id).alias(id), col(text).alias("t"))
    names = [f.split()[0] for f in FINDINGS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1):
                found = scan(part.column(1), known.value)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(found[n]) for n in names)], [id, *names])

    schema = T.StructType([narrow.schema[0], *T.StructType.fromDDL(FINDINGS).fields])
    return narrow.mapInArrow(run, schema)


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    data = text.encode()
    kept, at = [], 0
    for begin, end in spans:
        kept.append(data[at:begin])
        at = end
    return b"".join([*kept, data[at:]]).decode()


def remove(
    docs: DataFrame, items: DataFrame, *, what: str = "documents", id: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` without its contaminated documents, or (``what="spans"``) without their hit words."""
    if what not in ("documents", "spans"):
        raise ValueError("what must be documents or spans")
    if not _small(items, item, item_text, broadcast_bytes):
        if what == "spans":
            return _spans_cut(docs, _hits(docs, items, id, text, item, item_text, window), id, text)
        flag, row = fresh(docs, "found"), fresh(docs, "row_hash")
        found = _joined(docs, items, id, text, item, item_text, window, row).filter("contaminated")
        found = found.select(col(id).alias(flag), col(row).alias(f"{flag}_hash")).distinct()
        same = col(id).eqNullSafe(col(flag)) & (text_hash(text) == col(f"{flag}_hash"))
        return docs.join(found, same, "left_anti")
    known = _window_set(items, item, item_text, window)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, place):
                found = scan(part.column(place), known.value)
                bad = found["contaminated"]
                if what == "documents":
                    yield part.filter(pa.array([not x for x in bad], pa.bool_()))
                else:
                    texts = part.column(place).to_pylist()
                    texts = [_cut(t, s) if x else t for t, x, s in zip(texts, bad, found["spans"], strict=True)]
                    yield part.set_column(place, part.schema.field(place), pa.array(texts, part.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)


def _window_rows(df: DataFrame, key: list[str], lengths, whole_short: bool, window: int) -> DataFrame:
    """Windows of each text by two hashes. ``df``: the key columns, then the text ``t``."""
    fields = [df.schema[k] for k in key]
    schema = T.StructType([*fields, *T.StructType.fromDDL("n_words long, at long, length int, h1 long, h2 long").fields])

    def run(batches):
        for batch in batches:
            for part in blocks(batch, len(key)):
                w = words_of(part.column(len(key)))
                second = w._replace(hash=mix(w.hash ^ U64(0x5851F42D4C957F2D)))
                for length in range(1, window + 1) if whole_short else lengths:
                    h1, at = windows(w, length)
                    h2, _ = windows(second, length)
                    owner = np.searchsorted(w.first, at, "right") - 1
                    if whole_short and length < window:
                        keep = w.counts[owner] == length
                        h1, h2, at, owner = h1[keep], h2[keep], at[keep], owner[keep]
                    keys = part.select(range(len(key))).take(pa.array(owner)).columns
                    yield pa.RecordBatch.from_arrays(
                        [*keys, pa.array(w.counts[owner], pa.int64()), pa.array(at - w.first[owner], pa.int64()),
                         pa.array(np.full(len(at), length, np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))],
                        schema.names)

    return df.mapInArrow(run, schema)


def _hits(docs, items, id, text, item, item_text, window) -> DataFrame:
    """``k, h, at, length, item``: windows of the documents that an item holds, by id and hash of the text."""
    wanted = written(
        _window_rows(items.select(col(item).alias("item"), col(item_text).alias("t")), ["item"], (), True, window)
        .select("item", "length", "h1", "h2").distinct(), "windows")
    lengths = [r[0] for r in wanted.select("length").distinct().collect()]  # at most ``window`` numbers
    narrow = docs.select(col(id).alias("k"), text_hash(text).alias("h"), col(text).alias("t")).dropDuplicates(["k", "h"])
    hits = _window_rows(narrow, ["k", "h"], lengths, False, window).join(wanted, ["length", "h1", "h2"])
    return written(hits.select("k", "h", "at", "length", "item").distinct(), "hits")


def _spans_cut(docs: DataFrame, hits: DataFrame, id: str, text: str) -> DataFrame:
    """``docs`` with the hit words of contaminated documents cut out of their texts."""
    flag = fresh(docs, "found")
    # a list of one text's windows, no longer than the text
    marks = hits.groupBy("k", "h").agg(F.collect_set(F.struct("at", "length")).alias("marks"))
    marks = marks.select(F.col("k").alias(flag), F.col("h").alias(f"{flag}_hash"), F.col("marks").alias(f"{flag}_marks"))
    same = col(id).eqNullSafe(col(flag)) & (text_hash(text) == col(f"{flag}_hash"))
    joined = docs.join(marks, same, "left").select(*(col(c) for c in docs.columns), f"{flag}_marks")
    place, n = docs.columns.index(text), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for i, found in enumerate(batch.column(n).to_pylist()):
                if found:
                    w = words_of(batch.column(place).slice(i, 1))
                    hit = np.zeros(len(w.hash), bool)
                    for mark in found:
                        hit[mark["at"] : mark["at"] + mark["length"]] = True
                    if HIT_SHARE * int(hit.sum()) >= len(hit):
                        texts[i] = _cut(texts[i], _spans(w, hit, 0))
            kept = batch.select(range(n))
            yield kept.set_column(place, kept.schema.field(place), pa.array(texts, kept.schema.field(place).type))

    return joined.mapInArrow(run, docs.schema)


def _joined(docs, items, id, text, item, item_text, window, row="row_hash") -> DataFrame:
    """As :func:`contamination`, for item sets of any size; ``row`` is added as a column."""
    hits = _hits(docs, items, id, text, item, item_text, window)
    narrow = docs.select(col(id).alias("k"), text_hash(text).alias("h"), col(text).alias("t"))
    words = hits.select("k", "h", F.explode(F.sequence("at", F.col("at") + F.col("length") - 1)).alias("p")).distinct()
    words = words.groupBy("k", "h").agg(F.count("*").alias("n_hit"))
    names = hits.filter("item is not null").select("k", "h", F.col("item").cast("string").alias("item")).distinct()
    names = names.groupBy("k", "h").agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = words.join(names, words["k"].eqNullSafe(names["k"]) & (words["h"] == names["h"]), "left").select(
        words["k"].alias("fk"), words["h"].alias("fh"), "n_hit", "items")
    counted = narrow.select("k", "h", F.size(F.expr(
        r"regexp_extract_all(coalesce(t, ''), '([^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+)', 1)")).cast("long").alias("n_words"))
    out = counted.join(found, F.col("k").eqNullSafe(F.col("fk")) & (F.col("h") == F.col("fh")), "left")
    hit, listed = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("k").alias(id), F.col("h").alias(row), "n_words", hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), ((hit > 0) & (HIT_SHARE * hit >= F.col("n_words"))).alias("contaminated"))


_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
dw AS (SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.n = iw.n),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {HIT_SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op9_decontaminate", OP9_SQL)
def op9_decontaminate(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
