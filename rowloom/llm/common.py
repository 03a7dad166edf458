"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.session import ensure_checkpoint_dir

#: Bytes of text that are worked on at once; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    It cuts the lineage, so that a lost executor costs no more than the reading of some files, and
    later joins see a plain scan whose large partitions Spark can split.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/rowloom-{uuid.uuid4().hex}-{label}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_hash(name: str) -> Column:
    """64-bit hash that tells apart rows which share an id; 0 for a null text."""
    return F.when(col(name).isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(col(name)))


def sifted(rows: DataFrame, on: list[str], wanted: DataFrame, by: list[str], bits: int) -> DataFrame:
    """The ``rows`` whose columns ``on`` may be among the columns ``by`` of ``wanted``, so that the others are not shuffled.

    Their hashes are looked up in a bitmap of ``bits``, which is broadcast. None that is wanted is missed; with more
    wanted rows more others come through, and the join that follows leaves them out.
    """
    def place(names: list[str]) -> Column:
        return F.pmod(F.xxhash64(*names), F.lit(bits)) + 1

    # dealt out by part, so that each part of the map is made once and not by every task
    found = wanted.select(place(by).alias("p")).withColumn("part", F.bitmap_bucket_number("p")).repartition("part").groupBy("part").agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    at = F.bitmap_bit_position(place(on))
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = (F.bitmap_bucket_number(place(on)) == F.col("part")) & (F.getbit(byte, (at % 8).cast("int")) == 1)
    return rows.join(F.broadcast(found), near).select(*rows.columns)


def blocks(batch: pa.RecordBatch, column: int, limit: int = BLOCK_BYTES, most: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` that hold about ``limit`` bytes in a text column, and ``most`` rows at most."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = min(max(start + 1, int(np.searchsorted(ends, before + limit, "right"))), start + most)
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()  # what earlier batches took
