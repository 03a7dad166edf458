"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams (1 to 3 characters, words padded by a space) of a language.
A document is given the language whose profile has the least out-of-place distance to the document's
own list: the sum of the differences in rank, and ``PROFILE`` for each n-gram that the profile lacks.
Equal frequencies are ordered by length and code points, equal distances by the name of the language.

Profiles are learned from all labelled documents and whole texts.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing
could be learned. A text that shares no n-gram with any profile has score 0. Rows without a label
are not learned from. Repeated documents are judged alike, each in its own row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rowloom.llm.common import blocks, col
from rowloom.llm.registry import query, table

PROFILE = 400
MAX_LANGUAGES = 1000
UNKNOWN = "und"
#: Positions whose n-grams are sorted at once.
PIECE = 1 << 20
#: Bytes of text whose n-grams are put together at once; they take some 25 times as much.
COUNTED = 1 << 18


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _reduced(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.diff(np.append(at, len(keys))) if counts is None else np.add.reduceat(counts, at)


def _together(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Several lists of n-grams as one."""
    keys, counts = (np.concatenate(x) for x in zip(*lists, strict=True))
    return _reduced(keys, counts) if len(keys) else (keys, counts)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of a text as numbers of three code points each, in order, and their frequencies."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.where(letter, codes, 32)[keep]
    space = np.array([32], np.uint32)
    codes = np.concatenate((space, codes, space) if letter[-1] else (space, codes)).astype(np.int64)
    total = None
    for a in range(0, len(codes), PIECE):
        c = codes[a : a + PIECE + 2]
        one = c[: PIECE][c[: PIECE] != 32]
        two = (c[:-1] << 21 | c[1:])[:PIECE]
        three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[:PIECE]
        part = _reduced(np.concatenate((one, two, three)))
        total = part if total is None else _reduced(*(np.concatenate(x) for x in zip(total, part, strict=True)))
    return total


def _most_frequent(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.argsort(-counts, kind="stable")[:size]]


def fit(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", where: Column | None = None,
    profile: int = PROFILE,
) -> dict[str, np.ndarray]:
    """Profile of each language: its n-grams, the most frequent first. A language without a letter has none."""
    known = docs.filter(col(lang).isNotNull() & col(text).isNotNull() & (F.lit(True) if where is None else where))
    known = known.select(col(lang).alias("l"), col(text).alias("t"))
    if known.select("l").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1):
                found: dict[str, list] = {}
                for piece in blocks(part, 1, COUNTED):
                    own: dict[str, list] = {}
                    for name, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                        own.setdefault(name, []).append(ngrams(t))
                    for name, lists in own.items():
                        found.setdefault(name, []).append(_together(lists))
                for name, lists in found.items():
                    keys, counts = _together(lists)
                    if len(keys):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * len(keys)), pa.array(keys), pa.array(counts)], ["l", "g", "n"])

    grams = known.mapInArrow(count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    # the most frequent of each of 16 parts first, so that no task orders all n-grams of a language
    best = grams.withColumn("part", F.pmod("g", F.lit(16)))
    for groups in (("l", "part"), ("l",)):
        order = Window.partitionBy(*groups).orderBy(F.desc("n"), "g")
        best = best.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= profile)
    found = {}
    for row in best.orderBy("l", "r").toPandas().groupby("l"):  # ``profile`` rows a language
        found[row[0]] = row[1]["g"].to_numpy(np.int64)
    return found


class Ranks:
    """Profiles as one table of ranks, for looking up many n-grams at once."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.names = sorted(profiles)
        self.size = size
        self.keys = np.unique(np.concatenate([np.zeros(0, np.int64), *profiles.values()]))
        self.ranks = np.full((len(self.names), len(self.keys) + 1), -1, np.int64)
        for i, name in enumerate(self.names):
            self.ranks[i, np.searchsorted(self.keys, profiles[name])] = np.arange(len(profiles[name]))

    def judge(self, text: str | None) -> tuple[str, float]:
        keys = _most_frequent(*ngrams(text), self.size)
        if not len(keys) or not self.names:
            return UNKNOWN, 0.0
        place = np.searchsorted(self.keys, keys)
        known = np.append(self.keys, -1)[place] == keys
        ranks = self.ranks[:, np.where(known, place, len(self.keys))]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(keys)))).sum(axis=1)
        best = int(np.argmin(apart))
        return self.names[best], 1.0 - float(apart[best]) / float(self.size * len(keys))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], *, text: str = "text", profile: int = PROFILE) -> DataFrame:
    """``docs`` with the columns ``lang_pred`` and ``score`` in place of ``text``."""
    ranks = docs.sparkSession.sparkContext.broadcast(Ranks(profiles, profile))
    place = docs.columns.index(text)
    others = [i for i in range(len(docs.columns)) if i != place]
    fields = [docs.schema[i] for i in others]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, place):
                found = [ranks.value.judge(t) for t in part.column(place).to_pylist()]
                columns = [pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in others), *columns], schema.names)

    return docs.mapInArrow(run, schema)


def keep_known(docs: DataFrame, profiles: dict[str, np.ndarray], *, text: str = "text", profile: int = PROFILE) -> DataFrame:
    """``docs`` without those of no known language: no letter, or no n-gram in any profile.

    Without any profile nothing can be judged, and only documents without a letter go.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(Ranks(profiles, profile))

    def known(texts: pa.Array) -> pa.Array:
        keep: list[bool] = []
        for part in blocks(pa.RecordBatch.from_arrays([texts], ["t"]), 0):
            if profiles:
                keep += [ranks.value.judge(t)[1] > 0 for t in part.column(0).to_pylist()]
            else:
                keep += [any(map(str.isalpha, t or "")) for t in part.column(0).to_pylist()]
        return pa.array(keep, pa.bool_())

    # only the texts go to Python, and only the verdicts come back
    return docs.filter(F.arrow_udf(known, "boolean")(col(text)))


def held_out(id: str = "doc_id") -> Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.crc32(col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


OP1_SQL = rf"""
WITH RECURSIVE bits AS (SELECT CAST(b AS UBIGINT) AS b, 0 AS k, CAST(b AS UBIGINT) AS v FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END) FROM bits WHERE k < 8),
step AS (SELECT b, v FROM bits WHERE k = 8),
crc AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS UBIGINT) AS c FROM documents
  UNION ALL SELECT doc_id, s, k + 1, xor(c >> 8, v) FROM crc JOIN step ON b = xor(c, ascii(substr(s, k + 1, 1))) % 256 WHERE k < length(s)),
docs AS (SELECT d.doc_id, lang, xor(c, 4294967295) % 4 = 2 AS held_out,
    ' ' || trim(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g')) || ' ' AS t
  FROM documents d JOIN crc ON d.doc_id = crc.doc_id AND k = length(s)),
chars AS (SELECT doc_id, unnest(string_split(t, '')) AS a, generate_subscripts(string_split(t, ''), 1) AS s FROM docs WHERE length(t) > 2),
places AS (SELECT doc_id, a, lead(a) OVER w AS b, lead(a, 2) OVER w AS c FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
grams AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, a AS g FROM places WHERE a <> ' '
  UNION ALL SELECT doc_id, a || b FROM places UNION ALL SELECT doc_id, a || b || c FROM places) WHERE g IS NOT NULL GROUP BY doc_id, g),
own AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(g), g) - 1 AS r FROM grams QUALIFY r < {PROFILE}),
learned AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(g), g) - 1 AS r
  FROM grams JOIN docs USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g QUALIFY r < {PROFILE}),
apart AS (SELECT doc_id, l.lang, sum(CASE WHEN p.r IS NULL THEN {PROFILE} ELSE abs(own.r - p.r) END) AS d, count(*) AS n
  FROM own CROSS JOIN (SELECT DISTINCT lang FROM learned) l LEFT JOIN learned p ON p.lang = l.lang AND p.g = own.g GROUP BY doc_id, l.lang),
best AS (SELECT doc_id, arg_min(lang, (d, lang)) AS lang, min(d) AS d, any_value(n) AS n FROM apart GROUP BY doc_id)
SELECT docs.doc_id, held_out, coalesce(best.lang, '{UNKNOWN}') AS lang_pred,
  CASE WHEN d IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - d::DOUBLE / ({PROFILE} * n)::DOUBLE END AS score
FROM docs LEFT JOIN best ON docs.doc_id = best.doc_id
"""


@query("op1_language", OP1_SQL)
def op1_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    profiles = fit(docs, where=~held_out())
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), profiles)
