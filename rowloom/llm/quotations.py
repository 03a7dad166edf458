"""Conversations without quotes, in the order of replies.

Lines that begin with ``>`` are quoted; their level is the number of such signs. Consecutive lines of a
level form a passage, whose words are hashed (so wrapping, case and punctuation do not matter), as are
its lines and sentences of ``LEAST`` words or more. A passage is joined to the latest earlier message of
its conversation that has the same words unquoted, as a whole, a paragraph, a line or a sentence. A
message replies to the latest message that its outermost linked quotes come from; a message without
such a link begins a thread. Threads are followed to their first message by pointer doubling.

Cases: a null text has no quotes and stays null; a text of quotes alone becomes empty; messages of equal
conversation and turn share their links; a null conversation or turn links nothing and begins a
thread; a quote of nothing earlier is only removed. Extra columns of any name pass through unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rowloom.llm.common import blocks, col, fresh, written
from rowloom.llm.registry import query, table
from rowloom.llm.words import U64, WORD_BASE, mix, words_of

LEAST = 4
#: Turns whose links are looked up together.
TURNS = 1000
_QUOTE = re.compile(r"[ \t]*((?:>[ \t]?)+)")
#: A line that introduces a quote, such as "On ... wrote:".
_SAID = re.compile(r"[^\n>]{0,200}\b(?:wrote|said|schrieb|écrit|escribió)[^\n>]{0,40}:[ \t]*")


def split_quotes(text: str | None) -> tuple[str | None, list[tuple[int, list[str]]]]:
    """The text without quotes and their introductions, and each quoted passage: level and lines."""
    if text is None or ">" not in text:
        return text, []
    own: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    before = 0
    for line in text.split("\n"):
        mark = _QUOTE.match(line)
        level = mark.group(1).count(">") if mark else 0
        if level:
            if level != before:
                quotes.append((level, []))
                if not before and own and _SAID.fullmatch(own[-1]):
                    own.pop()
            quotes[-1][1].append(line[mark.end() :])
        else:
            own.append(line)
        before = level
    return "\n".join(own).strip("\n"), quotes


_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _pieces(lines: list[str]) -> list[str]:
    """A passage as a whole, its paragraphs, lines and sentences."""
    whole = "\n".join(lines)
    paragraphs = re.split(r"\n[ \t]*\n", whole)
    return [whole, *paragraphs, *lines, *(s for p in paragraphs for s in _SENTENCE.split(p))]


def _hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the words of each text, and their number."""
    w = words_of(pa.array(texts, pa.string()))
    out = np.zeros(len(texts), U64)
    full = np.flatnonzero(w.counts)
    if len(full):
        place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], w.counts)
        powers = np.multiply.accumulate(np.concatenate((np.ones(1, U64), np.full(int(place.max()), WORD_BASE, U64))))
        out[full] = mix(np.add.reduceat(w.hash * powers[place], w.first[full]) + w.counts[full].astype(U64))
    return out, w.counts


def _places(df: DataFrame, quoted: bool) -> DataFrame:
    """``c, t, h`` (and ``level``): hashes of what a message says itself, or of what it quotes."""
    schema = T.StructType([*df.schema.fields[:2], *T.StructType.fromDDL("h long, level int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, 2):
                row, level, texts, whole = [], [], [], []
                for i, text in enumerate(block.column(2).to_pylist()):
                    own, quotes = split_quotes(text)
                    for n, lines in quotes if quoted else [(0, (own or "").split("\n"))]:
                        pieces = list(dict.fromkeys(_pieces(lines)))
                        row += [i] * len(pieces)
                        level += [n] * len(pieces)
                        whole += [j == 0 for j in range(len(pieces))]
                        texts += pieces
                hashes, counts = _hashes(texts)
                keep = np.flatnonzero((counts >= LEAST) | (np.array(whole, bool) & (counts > 0)))
                at = pa.array(np.array(row, np.int64)[keep])
                yield pa.RecordBatch.from_arrays(
                    [block.column(0).take(at), block.column(1).take(at), pa.array(hashes[keep].view(np.int64)),
                     pa.array(np.array(level, np.int32)[keep])], schema.names)

    return df.mapInArrow(run, schema)


def links(messages: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``c, t, parent``: the message that each quoting message replies to."""
    base = messages.select(col(conversation).alias("c"), col(turn).alias("t"), col(text).alias("x")).filter("c is not null and t is not null and x is not null")
    quotes = written(_places(base.filter(F.instr("x", ">") > 0), True).groupBy("c", "t", "h").agg(F.min("level").alias("level")), "quotes")
    wanted = written(quotes.select("c", "h").distinct(), "wanted")
    origins = _places(base, False).join(wanted, ["c", "h"], "left_semi").select("c", "t", "h").distinct()
    origins = written(origins, "origins")
    # latest earlier turn: within a range of turns, else the last one of the ranges before
    part = F.floor(F.col("t") / TURNS).alias("part")
    last = origins.groupBy("c", "h", part).agg(F.max("t").alias("last"))
    asked = quotes.select("c", "h", part).distinct()
    both = last.unionByName(asked.withColumn("last", F.lit(None).cast(last.schema["last"].dataType)))
    both = both.groupBy("c", "h", "part").agg(F.max("last").alias("last"))
    before = Window.partitionBy("c", "h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = written(both.select("c", "h", "part", F.max("last").over(before).alias("carried")), "carried")
    events = quotes.select("c", "h", "t", "level", F.lit(0).alias("kind")).unionByName(
        origins.select("c", "h", "t", F.lit(0).alias("level"), F.lit(1).alias("kind"))).withColumn("part", part)
    inside = Window.partitionBy("c", "h", "part").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, -1)
    found = events.withColumn("origin", F.max(F.when(F.col("kind") == 1, F.col("t"))).over(inside)).filter("kind = 0")
    found = found.join(carried, ["c", "h", "part"]).withColumn("origin", F.coalesce("origin", "carried")).filter("origin is not null")
    best = found.groupBy("c", "t").agg(F.max(F.struct((-F.col("level")).alias("l"), F.col("origin").alias("o"))).alias("best"))
    return best.select("c", "t", F.col("best.o").alias("parent"))


def threads(found: DataFrame) -> DataFrame:
    """``links`` with the first message of the thread, ``root``, and the ``depth`` below it."""
    state = written(found.select("c", "t", "parent", F.col("parent").alias("root"), F.lit(1).alias("depth")), "thread")
    while True:
        up = state.select("c", F.col("t").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        if not state.join(up, ["c", "root"], "left_semi").take(1):
            return state
        step = state.join(up, ["c", "root"], "left")
        state = written(step.select("c", "t", "parent", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "thread")


def without_quotes(messages: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``messages`` with the quotes cut out of ``text``, and ``n_quotes, parent_turn, root_turn, depth``.

    A conversation in the order of replies is ordered by ``root_turn, depth, turn``. If ``messages`` has a
    column of such a name already, the added one gets an underscore in front.
    """
    names = {n: fresh(messages, n) for n in ("n_quotes", "parent_turn", "root_turn", "depth")}
    found = written(threads(links(messages, conversation=conversation, turn=turn, text=text)), "threads")
    at = messages.columns.index(text)
    schema = T.StructType([*messages.schema.fields, T.StructField(names["n_quotes"], T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, at):
                parted = [split_quotes(t) for t in block.column(at).to_pylist()]
                columns = list(block.columns)
                columns[at] = pa.array([own for own, _ in parted], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(q) for _, q in parted], pa.int32())], schema.names)

    keys = {n: fresh(messages, f"link_{n}") for n in ("c", "t")}
    found = found.select(
        F.col("c").alias(keys["c"]), F.col("t").alias(keys["t"]), F.col("parent").alias(names["parent_turn"]),
        F.col("root").alias(names["root_turn"]), F.col("depth").alias(names["depth"]))
    parted = messages.mapInArrow(run, schema)
    parted = parted.join(found, (col(conversation) == col(keys["c"])) & (col(turn) == col(keys["t"])), "left").drop(*keys.values())
    return parted.withColumns({
        names["root_turn"]: F.coalesce(col(names["root_turn"]), col(turn)), names["depth"]: F.coalesce(col(names["depth"]), F.lit(0))})


@query("op5_quotations")
def op5_quotations(spark, sf_dir):
    return without_quotes(table(spark, sf_dir, "conversations"))
