"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut into chunks where a rolling hash of the last 16 bytes has zeros, so that equal passages
give equal chunks wherever they stand. Each chunk is encoded by itself, as if it were a text. Chunks that
several places share are encoded once: the ``dictionary`` chunks that save the most bytes are encoded in a
first pass and broadcast (bounded by their number and by ``LONGEST`` bytes each); all others are encoded
where they stand, once per task as long as its memo holds them.

Joins are repaired: the text around a cut is encoded anew, from a word boundary of the left chunk to one of
the right chunk, and the ids of both chunks give way to the new ones in between. The window reaches one
boundary further on either side than the word that is cut, and the ids there must agree with those of both
chunks; while they do not, it is widened boundary by boundary, in the end to the whole text. A boundary is a place where the
pre-tokenizer parts the text whatever stands around it: in front of white space, and where letters, digits
and signs meet (but for an apostrophe in front of letters). What lies between two boundaries is therefore
encoded as in the whole text, and ids that agree there agree everywhere. A chunk without boundaries gives
way as a whole, and the window goes on into the next one.

Encoding runs on ``tiktoken`` with the ranks of the given ``tokenizers`` file, which gives the same ids
several times faster; the file must be byte-level BPE with its merges in the order of their ids.
Special tokens of the file that stand in a text get their own ids, as in the ``tokenizers`` library.

Cases: a null or empty text has no ids; repeated documents are encoded alike; texts of any length are
worked on whole. Columns other than the text pass through unchanged.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.common import blocks, col, written
from rowloom.llm.registry import query, table
from rowloom.llm.words import mix, text_bytes

#: Bits of the rolling hash that are zero at a cut: chunks of about 512 bytes.
CUT_BITS = 9
DICTIONARY = 20_000
SHORTEST, LONGEST = 64, 4096
#: Encoded chunks that a task keeps for reuse.
MEMO = 20_000
#: The pre-tokenizer of byte-level BPE files that use the standard pattern (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
#: Kinds of ASCII characters; 0 is none of them.
_LETTER, _DIGIT, _SIGN, _WHITE = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x20] = _KIND[0x09:0x0E] = _WHITE
#: White space outside ASCII, in any version of Unicode (fixed values): U+0085, U+00A0, U+1680, U+180E,
#: U+2000 to U+200B, U+2028, U+2029, U+202F, U+205F and U+3000, by the last two bytes of their UTF-8.
_WIDE_WHITE = np.array(sorted({int.from_bytes(chr(c).encode()[-2:]) for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}))
#: Signs that end clauses where no spaces are written (fixed values): U+3001, U+3002 and U+FF0C, by their UTF-8.
_WIDE_SIGNS = np.array(sorted(int.from_bytes(c.encode()) for c in "\u3001\u3002\uff0c"))


class Codec:
    """Encoder and decoder of one ``tokenizers`` file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec.get("pre_tokenizer") or {}
        fits = (
            spec["model"]["type"] == "BPE" and split.get("type") == "ByteLevel" and spec.get("normalizer") is None
            and not split.get("add_prefix_space") and split.get("use_regex", True)
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec["added_tokens"])
        )
        if not fits:
            raise ValueError(f"{path} is no plain byte-level BPE file")
        # printable characters stand for their own bytes, the others follow from U+0100 on
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in own]
        byte = {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(other)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        merged = [vocab[bytes(byte[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))] for m in spec["model"]["merges"]]
        if merged != sorted(set(merged)):
            raise ValueError(f"the merges of {path} are not in the order of their ids")
        self.special = list(special)
        self.encoder = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens=special)
        self.tokens: list[bytes] = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in [*vocab.items(), *((s.encode(), i) for s, i in special.items())]:
            self.tokens[i] = token
        self.sizes = np.array([len(t) for t in self.tokens], np.int32)
        self.decimal = [str(i).encode() for i in range(len(self.tokens))]

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.encoder.encode(text, allowed_special="all")
        return self.encoder.encode_ordinary(text)

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def cuts_of(buffer: np.ndarray) -> np.ndarray:
    """Where the rolling hash cuts, each moved on to the begin of a character."""
    h = _GEAR[buffer]
    for step in (1, 2, 4, 8):  # the hash of 2, 4, 8 and then 16 bytes
        later = h[step:] + (h[:-step] << np.uint32(step))
        h = np.concatenate((h[:step], later))
    cuts = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    for _ in range(3):
        inside = cuts < len(buffer)
        inside[inside] = buffer[cuts[inside]] & 0xC0 == 0x80
        cuts = cuts + inside
    return np.unique(cuts)


def boundaries_of(buffer: np.ndarray, data: bytes, special: list[bytes]) -> np.ndarray:
    """Where the pre-tokenizer parts the text, whatever stands around it; none within special tokens."""
    before, after = buffer[:-1], buffer[1:]
    kind_b, kind_a = _KIND[before], _KIND[after]
    # white space takes no part in what stands before it, but may belong to what follows
    sure = (kind_b > 0) & (kind_b != _WHITE) & (kind_a > 0) & (kind_b != kind_a) & ~((before == 0x27) & (kind_a == _LETTER))
    wide = np.flatnonzero((before >= 0x80) & (kind_a == _WHITE))
    wide = wide[wide > 0]
    two = buffer[wide - 1].astype(np.int64) << 8 | buffer[wide]
    sure[wide[~np.isin(two, _WIDE_WHITE)]] = True
    # ideographs of U+5000 to U+8FFF are letters
    signs = np.flatnonzero((before >= 0x80) & (after >= 0xE5) & (after <= 0xE8))
    signs = signs[signs > 1]
    three = buffer[signs - 2].astype(np.int64) << 16 | buffer[signs - 1].astype(np.int64) << 8 | buffer[signs]
    sure[signs[np.isin(three, _WIDE_SIGNS)]] = True
    for token in special:
        at = data.find(token)
        while at >= 0:
            sure[at : at + len(token) - 1] = False
            at = data.find(token, at + 1)
    return np.flatnonzero(sure) + 1


def _chunks(buffer: np.ndarray, offset: np.ndarray) -> Iterator[list[int]]:
    """For each text where its chunks begin, and its end. A chunk has ``SHORTEST`` bytes at least, but for the last."""
    cuts = cuts_of(buffer)
    edges = np.searchsorted(cuts, offset)
    for i in range(len(offset) - 1):
        begin, end = int(offset[i]), int(offset[i + 1])
        places = [begin]
        for cut in cuts[edges[i] : edges[i + 1]].tolist():
            if cut - places[-1] >= SHORTEST and cut < end:
                places.append(cut)
        yield [*places, end]


def _parts(texts: pa.Array) -> Iterator[list[bytes]]:
    """The chunks of each text."""
    buffer, offset = text_bytes(texts)
    data = buffer.tobytes()
    for places in _chunks(buffer, offset):
        yield [data[a:b] for a, b in zip(places, places[1:]) if b > a]


def _reusable(part: bytes) -> bool:
    return SHORTEST <= len(part) <= LONGEST


def shared_chunks(docs: DataFrame, *, text: str = "text", dictionary: int = DICTIONARY) -> list[bytes]:
    """The chunks whose reuse saves the most bytes, ``dictionary`` of them (the last few by hash, so it may be some more or fewer)."""
    texts = docs.select(col(text).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, 0):
                found: dict[int, list[int]] = {}
                for parts in _parts(block.column(0)):
                    for part in filter(_reusable, parts):
                        found.setdefault(xxhash.xxh3_64_intdigest(part) >> 1, [0, len(part)])[0] += 1
                counts = [pa.array([v[j] for v in found.values()], pa.int64()) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), *counts], ["h", "n", "size"])

    saved = texts.mapInArrow(count, "h long, n long, size long").groupBy("h").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    saved = written(saved.filter("n > 1").select("h", ((F.col("n") - 1) * F.col("size")).alias("saved")), "chunks")
    level = F.floor(F.log2(F.col("saved").cast("double")) * 16).cast("int")
    levels = dict(tuple(r) for r in saved.groupBy(level.alias("l")).count().collect())  # about a thousand at most
    least, room = None, dictionary
    for l in sorted(levels, reverse=True):
        least, part = l, min(1.0, room / levels[l])
        room -= levels[l]
        if room <= 0:
            break
    if least is None or dictionary <= 0:
        return []
    # of the least level as many as there is room for, picked by their hashes
    fits = (level > least) | (level == least) & (F.shiftright("h", 33) < int(part * (1 << 30)))
    chosen = frozenset(r[0] for r in saved.filter(fits).select("h").collect())
    wanted = docs.sparkSession.sparkContext.broadcast(chosen)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, bytes] = {}
        for batch in batches:
            for block in blocks(batch, 0):
                for parts in _parts(block.column(0)):
                    for part in filter(_reusable, parts):
                        h = xxhash.xxh3_64_intdigest(part) >> 1
                        if h in wanted.value and h not in seen:
                            seen[h] = part
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.binary())], ["h", "c"])

    return [r[0] for r in texts.mapInArrow(pick, "h long, c binary").groupBy("h").agg(F.min("c").alias("c")).select("c").collect()]


class Encoded:
    """The ids of a stretch of text, and the place in it where each one ends."""

    __slots__ = ("ends", "ids")

    def __init__(self, code: Codec, ids: np.ndarray):
        self.ids = ids
        self.ends = np.cumsum(code.sizes[ids], dtype=np.int64)

    def between(self, low: int, high: int) -> np.ndarray | None:
        """The ids from byte ``low`` to byte ``high``; none if one of them reaches over either."""
        if low >= high:
            return self.ids[:0]
        first = 0 if low == 0 else int(np.searchsorted(self.ends, low)) + 1
        last = int(np.searchsorted(self.ends, high))
        whole = (low == 0 or self.ends[first - 1] == low) and last < len(self.ends) and self.ends[last] == high
        return self.ids[first : last + 1] if whole else None


def _same(a: np.ndarray | None, b: np.ndarray | None) -> bool:
    return a is not None and b is not None and np.array_equal(a, b)


def _repaired(data: bytes, places: list[int], bounds: list[int], part_of: Callable[[bytes], Encoded]) -> np.ndarray:
    """The ids of a text, from its chunks (which begin at ``places``) and the repaired joins between them.

    ``bounds`` are the boundaries in the text, with its begin and end.
    """
    chunks = [part_of(data[a:b]) for a, b in zip(places, places[1:])]
    out, last = [], len(bounds) - 1
    done, chunk, cut = 0, 0, 1  # the boundary up to which ids are out, and the chunk that it is in
    while cut < len(chunks):
        near = bisect_right(bounds, places[cut]) - 1
        far = bisect_left(bounds, places[cut])
        low, high = max(near - 1, done), min(far + 1, last)
        while True:
            while cut + 1 < len(chunks) and places[cut + 1] < bounds[high]:
                cut += 1  # the window goes on over the next cut
                far = bisect_left(bounds, places[cut])
                high = max(high, min(far + 1, last))
            begin, left, right = bounds[low], places[chunk], places[cut]
            new = part_of(data[begin : bounds[high]])
            kept = chunks[chunk].between(bounds[done] - left, begin - left)
            if (
                kept is not None
                and _same(new.between(0, bounds[near] - begin), chunks[chunk].between(begin - left, bounds[near] - left))
                and _same(new.between(bounds[far] - begin, bounds[high] - begin), chunks[cut].between(bounds[far] - right, bounds[high] - right))
            ):
                break
            if low == done and high == last:
                return part_of(data[places[0] : places[-1]]).ids
            low, high = max(low - 1, done), min(high + 1, last)
        out += [kept, new.ids]
        done, chunk, cut = high, cut, cut + 1
    rest = chunks[chunk].between(bounds[done] - places[chunk], places[-1] - places[chunk])
    return part_of(data[places[0] : places[-1]]).ids if rest is None else np.concatenate([*out, rest])


def _encoded_chunks(spark, chunks: list[bytes], path: str) -> dict[bytes, Encoded]:
    """The dictionary: each chunk encoded once, by the tasks of a small job."""

    def run(batches):
        for batch in batches:
            ids = [np.array(codec(path).encode(c.decode()), np.uint32).tobytes() for c in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["c", "ids"])

    rows = spark.createDataFrame([(c,) for c in chunks], "c binary").mapInArrow(run, "c binary, ids binary").collect()
    return {bytes(r[0]): bytes(r[1]) for r in rows}


def tokenize(
    docs: DataFrame, path: str, finish: Callable[[Codec, np.ndarray], tuple], schema: str, *, text: str = "text", dictionary: int = DICTIONARY,
) -> DataFrame:
    """``docs`` with the columns of ``schema`` in place of the text: ``finish`` of its ids."""
    spark = docs.sparkSession
    chunks = shared_chunks(docs, text=text, dictionary=dictionary)
    known = spark.sparkContext.broadcast(_encoded_chunks(spark, chunks, path) if chunks else {})
    place = docs.columns.index(text)
    others = [i for i in range(len(docs.columns)) if i != place]
    added = T.StructType.fromDDL(schema)
    whole = T.StructType([*(docs.schema[i] for i in others), *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        code, memo = codec(path), {}
        types = [to_arrow_type(f.dataType) for f in added.fields]

        def part_of(part: bytes) -> Encoded:
            found = memo.get(part)
            if found is None:
                if len(memo) >= MEMO:
                    memo.clear()
                ids = known.value.get(part)
                found = Encoded(code, np.array(code.encode(part.decode()), np.uint32) if ids is None else np.frombuffer(ids, np.uint32))
                if len(part) <= LONGEST:
                    memo[part] = found
            return found

        def ids_of(texts: pa.Array) -> Iterator[np.ndarray]:
            buffer, offset = text_bytes(texts)
            data = buffer.tobytes()
            sure = boundaries_of(buffer, data, [t.encode() for t in code.special])
            edges = np.searchsorted(sure, offset)
            for i, places in enumerate(_chunks(buffer, offset)):
                begin, end = places[0], places[-1]
                if begin == end:
                    yield np.zeros(0, np.uint32)
                    continue
                # a place at the very edge of a text has its neighbour in another text
                own = sure[edges[i] : edges[i + 1]]
                yield _repaired(data, places, [begin, *own[(own > begin) & (own < end)].tolist(), end], part_of)

        for batch in batches:
            for block in blocks(batch, place):
                rows = [finish(code, ids) for ids in ids_of(block.column(place))]
                columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*(block.column(i) for i in others), *columns], whole.names)

    return docs.mapInArrow(run, whole)


def encode(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids", **options) -> DataFrame:
    """``docs`` with the token ids of each text in place of it."""
    return tokenize(docs, path, lambda code, found: (found.astype(np.int32),), f"`{ids}` array<int>", text=text, **options)


def decode(docs: DataFrame, path: str, *, ids: str = "ids", text: str = "text") -> DataFrame:
    """``docs`` with the text of each list of ids in place of it; a null list gives a null text."""
    place = docs.columns.index(ids)
    schema = T.StructType([T.StructField(text, T.StringType()) if i == place else f for i, f in enumerate(docs.schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(place).to_pylist()
            texts = [None if x is None else codec(path).decode_bytes(x).decode("utf-8", "replace") for x in lists]
            yield batch.set_column(place, text, pa.array(texts, pa.string()))

    return docs.mapInArrow(run, schema)


def _digests(code: Codec, ids: np.ndarray) -> tuple[int, str, str]:
    """Number of ids, and the digests of their decimals and of the text they decode to."""
    listed = ids.tolist()
    decoded = code.decode_bytes(listed).decode("utf-8", "replace")
    decimal = b",".join(map(code.decimal.__getitem__, listed))
    return len(listed), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def digests(docs: DataFrame, path: str, **options) -> DataFrame:
    return tokenize(docs, path, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", **options)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op4_bpe")
def op4_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), default_path())
