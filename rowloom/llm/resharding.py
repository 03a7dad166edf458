"""Resharding by minimum-cost flow.

Old shards send bytes to new shards of given capacities; a byte that stays costs nothing, a moved byte
costs one. The flow over the two small sets of shards is solved on the driver and fixes how many bytes
each old shard gives to each new one. Blocks are runs of an old shard's documents in the order of their
size class, the largest first, so that large documents stay and the cuts fall between small ones. A
block's end is kept as a key, not as a position, so the documents find their new shard without a join,
and are shuffled once: to the (shard, part of shard) in which their slots are numbered and their file is
written.

Cases: a null text has no bytes of its own; rows of equal id and text stay together; rows without id are
in the order before all others; without documents no shard has any. Extra columns of any name are
written along.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowloom.llm.common import col, fresh, text_hash, written
from rowloom.llm.registry import query, table
from rowloom.session import ensure_checkpoint_dir

SHARDS, OLD_SHARDS = 40, 32
OVERHEAD = 16
#: Rows that one task orders at most, as far as hashing deals them evenly.
PART_ROWS = 1_000_000
MAX_PARTS = 4096


def minimum_cost_flow(supply: list[int], capacity: list[int], cost: np.ndarray) -> np.ndarray:
    """Units to send from each source to each sink, at the least total cost.

    Sends along the cheapest path that is left (Bellman-Ford on the residual network) until all is sent.
    """
    n, m = len(supply), len(capacity)
    flow = np.zeros((n, m), np.int64)
    left, room = np.array(supply, np.int64), np.array(capacity, np.int64)
    if left.sum() > room.sum():
        raise ValueError("the capacities are too small")
    while left.any():
        source = np.where(left > 0, 0.0, np.inf)
        sink, via, back = np.full(m, np.inf), np.full(m, -1), np.full(n, -1)
        while True:
            through = source[:, None] + cost
            best = through.min(axis=0)
            better = best < sink - 1e-9
            via[better], sink[better] = through.argmin(axis=0)[better], best[better]
            undo = np.where(flow > 0, sink[None, :] - cost, np.inf)
            best = undo.min(axis=1)
            worse = best < source - 1e-9
            if not worse.any():
                break
            back[worse], source[worse] = undo.argmin(axis=1)[worse], best[worse]
        end = int(np.argmin(np.where(room > 0, sink, np.inf)))
        path, j = [], end
        while True:
            i = int(via[j])
            path.append((i, j, 1))
            if back[i] < 0 or left[i] > 0 and source[i] == 0.0:
                break
            path.append((i, int(back[i]), -1))
            j = int(back[i])
        amount = min(int(left[i]), int(room[end]), *(int(flow[a, b]) for a, b, s in path if s < 0))
        for a, b, s in path:
            flow[a, b] += s * amount
        left[i] -= amount
        room[end] -= amount
    return flow


def _key(rows: int, old_shards: int) -> Column:
    """Place of a document in its old shard: size class, the largest first, a part by hash, id, text hash."""
    parts = max(1, min(MAX_PARTS, rows // (old_shards * PART_ROWS)))
    size_class = -F.floor(F.log2(F.col("size").cast("double")) * 4).cast("int")
    return F.struct(size_class.alias("c"), F.pmod(F.xxhash64("k", "h"), F.lit(parts)).cast("int").alias("b"), F.col("k").alias("k"), F.col("h").alias("h"))


def old_shard(id: str = "doc_id", shards: int = OLD_SHARDS) -> Column:
    """Default old layout: shards by a checksum of the id."""
    return F.coalesce(F.crc32(col(id).cast("string").cast("binary")) % shards, F.lit(0)).cast("int")


def plan(docs: DataFrame, shards: int, old_shards: int, old: Column | None = None, *, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """Blocks to move: ``old, shard, low, high`` (keys; the last block of a shard is open), and the rows counted.

    ``old`` gives the old shard of a document, from 0 to ``old_shards`` - 1.
    """
    size = F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("long") + OVERHEAD
    narrow = docs.select((old_shard(id, old_shards) if old is None else old).cast("int").alias("old"), col(id).alias("k"), text_hash(text).alias("h"), size.alias("size"))
    narrow = written(narrow, "sizes")
    supply, rows = [0] * old_shards, 0
    for o, n, total in narrow.groupBy("old").agg(F.count("*"), F.sum("size")).collect():
        supply[o] += total
        rows += n
    base, more = divmod(sum(supply), shards)
    capacity = [base + (j < more) for j in range(shards)]
    cost = np.ones((old_shards, shards))
    np.fill_diagonal(cost, 0)
    flow = minimum_cost_flow(supply, capacity, cost)
    cuts = []  # what stays comes first, so the smallest documents move
    for i in range(old_shards):
        at = 0
        for j in sorted(np.flatnonzero(flow[i]).tolist(), key=lambda j: (j != i, j)):
            cuts.append((i, j, at, at + int(flow[i, j])))
            at += int(flow[i, j])
    spark = docs.sparkSession
    cuts = F.broadcast(spark.createDataFrame(cuts, "o int, shard int, lo long, hi long"))  # old + new shards rows at most
    keyed = narrow.withColumn("key", _key(rows, old_shards))
    part = ("old", "key.c", "key.b")
    inside = Window.partitionBy(*part).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    parts = keyed.groupBy("old", F.col("key.c").alias("c"), F.col("key.b").alias("b")).agg(F.sum("size").alias("total"))
    before = Window.partitionBy("old").orderBy("c", "b").rowsBetween(Window.unboundedPreceding, -1)
    parts = written(parts.withColumn("before", F.coalesce(F.sum("total").over(before), F.lit(0))).drop("total"), "parts")
    placed = keyed.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        parts, (keyed["old"] == parts["old"]) & (F.col("key.c") == parts["c"]) & (F.col("key.b") == parts["b"])).drop(parts["old"])
    middle = F.col("before") + F.col("own") + F.shiftright("size", 1)
    ends = placed.join(cuts, (F.col("old") == F.col("o")) & (middle >= F.col("lo")) & (middle < F.col("hi")))
    ends = written(ends.groupBy("old", "shard").agg(F.min("key").alias("low"), F.min("lo").alias("at")), "ends")
    following = F.lead("low").over(Window.partitionBy("old").orderBy("at"))
    first = F.row_number().over(Window.partitionBy("old").orderBy("at")) == 1
    return ends.select("old", "shard", "low", following.alias("high"), first.alias("first")), rows


def assign(
    docs: DataFrame, shards: int = SHARDS, old_shards: int = OLD_SHARDS, old: Column | None = None, *, id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``docs`` with the columns ``old_shard``, ``shard``, ``size`` and ``slot`` (gapless from 0 in each shard).

    If ``docs`` has a column of such a name already, the added one gets an underscore in front.
    """
    blocks, rows = plan(docs, shards, old_shards, old, id=id, text=text)
    blocks = F.broadcast(written(blocks, "blocks"))  # old + new shards rows at most
    row = docs.select(
        F.struct(*map(col, docs.columns)).alias("doc"), (old_shard(id, old_shards) if old is None else old).cast("int").alias("old"),
        col(id).alias("k"), text_hash(text).alias("h"), (F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("long") + OVERHEAD).alias("size"))
    row = row.withColumn("key", _key(rows, old_shards))
    fits = (row["old"] == blocks["old"]) & (blocks["first"] | (F.col("key") >= F.col("low"))) & (F.col("high").isNull() | (F.col("key") < F.col("high")))
    row = row.join(blocks, fits).drop(blocks["old"]).drop("low", "high", "first", "key")
    parts = max(16, min(MAX_PARTS, rows // (shards * PART_ROWS)))
    row = row.withColumn("bucket", F.pmod(F.xxhash64("h", "k"), F.lit(parts)).cast("int"))
    counts = row.groupBy(F.col("shard").alias("s"), F.col("bucket").alias("b")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.select("s", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "counts")
    inside = Window.partitionBy("shard", "bucket").orderBy("k", "h")
    row = row.withColumn("slot", F.row_number().over(inside) - 1)
    row = row.join(F.broadcast(counts), (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b")))  # shards x 4096 rows at most
    added = {"old_shard": F.col("old"), "shard": F.col("shard"), "size": F.col("size"), "slot": (F.col("slot") + F.col("before")).cast("long")}
    return row.select("doc.*", *(c.alias(fresh(docs, name)) for name, c in added.items()))


def rewrite(assigned: DataFrame, path: str) -> None:
    """Write the files of each new shard that differs from the old shard of its number, under ``path/shard=N``."""
    sides = assigned.select(F.explode(F.array("shard", "old_shard")).alias("s"), (F.col("shard") != F.col("old_shard")).alias("moved"))
    touched = [r[0] for r in sides.filter("moved").select("s").distinct().collect()]  # numbers of shards
    assigned.filter(F.col("shard").isin(touched)).write.partitionBy("shard").parquet(path)


@query("op8_resharding")
def op8_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark)}/rowloom-{uuid.uuid4().hex}-shards"
    assigned = assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
    assigned.write.partitionBy("shard").parquet(path)
    shards = spark.read.schema("doc_id long, text string, old_shard int, size long, slot long, shard int").parquet(path)
    bytes_ = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    return shards.select(
        "doc_id", (F.octet_length(bytes_) + OVERHEAD).cast("long").alias("size"), F.crc32(bytes_).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
