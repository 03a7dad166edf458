"""Dense numbers and running sums that never put a whole hot group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.hashing import hash32
from rowloom.session import freeze, shuffle_partitions

# Rows of one group that a single task sorts; larger groups are split by hash.
GROUP_CHUNK = 200_000
# Keys that one task puts in order for running sums.
RANGE = 1 << 12


def dense_index(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Number all rows ``start, start+1, ...`` in the total order of ``order``.

    Rows are range-partitioned on the order columns and numbered inside each partition; the only
    global step adds up one row count per partition.
    """
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    local = freeze(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_local", F.monotonically_increasing_id())
    )
    part = F.shiftright(F.col("_local"), 33)
    row = F.col("_local").bitwiseAND((1 << 33) - 1)
    counts = local.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    # one row per partition, so the window without partitions is as small as the partition count
    offsets = counts.select(
        "_part",
        (
            F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        ).alias("_before"),
    )
    return (
        local.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.coalesce("_before", F.lit(0)) + row + F.lit(start))
        .drop("_local", "_part", "_before")
    )


def running_before(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows of a smaller ``key``, a whole number without repeats.

    Keys are summed up in ranges of ``RANGE`` keys, the ranges in ranges of ranges, and so on, so that no
    task orders more rows than a range has keys.
    """
    ends = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    low, width = (0, 0) if ends.lo is None else (ends.lo, ends.hi - ends.lo)
    return _before(df.withColumn("_at", (F.col(key) - F.lit(low)).cast("bigint")), value, name, width).drop("_at")


def _before(df: DataFrame, value: str, name: str, width: int) -> DataFrame:
    bits = RANGE.bit_length() - 1
    ranged = df.withColumn("_range", F.shiftright("_at", bits))
    order = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    inside = ranged.withColumn(name, F.coalesce(F.sum(value).over(order), none))
    if width < RANGE:
        return inside.drop("_range")
    ranges = ranged.groupBy(F.col("_range").alias("_at")).agg(F.sum(value).alias("_sum"))
    above = f"{name}_above"
    ranges = _before(ranges, "_sum", above, width >> bits).select(F.col("_at").alias("_range"), above)
    return inside.join(ranges, "_range").withColumn(name, F.col(name) + F.col(above)).drop("_range", above)


def group_totals(df: DataFrame, group: str, weight: Column | None = None) -> DataFrame:
    """Size, and optionally total weight, of every group (partial aggregation, no skew)."""
    aggregates = [F.count(F.lit(1)).alias("group_size")]
    if weight is not None:
        aggregates.append(F.sum(weight).alias("group_weight"))
    return df.groupBy(group).agg(*aggregates)


def number_in_groups(
    df: DataFrame, group: str, order: str, size: str, weight: str | None = None, chunk: int = GROUP_CHUNK
) -> DataFrame:
    """Add ``position`` (0-based, within ``group``) and, for a weight in whole numbers, ``weight_before``.

    ``size`` names a column with the group size. Rows are ordered by (hash of ``order``, ``order``), and
    groups of more than ``chunk`` rows are cut into ranges of that hash, so that one hot group is
    numbered by many tasks. As the ranges follow the order, ``chunk`` does not change any number.
    """
    buckets = F.ceil(F.col(size) / F.lit(chunk)).cast("bigint")
    bucketed = df.withColumn("_hash", hash32(F.col(order))).withColumn("_bucket", F.shiftright(F.col("_hash") * buckets, 32))
    window = Window.partitionBy(group, "_bucket").orderBy("_hash", order)
    numbered = bucketed.withColumn("_pos", (F.row_number().over(window) - 1).cast("bigint"))
    if weight is not None:
        before = window.rowsBetween(Window.unboundedPreceding, -1)
        numbered = numbered.withColumn("_wpos", F.sum(weight).over(before))

    # Only split groups have offsets: at most (2 x rows / chunk) rows.
    hot = bucketed.filter(F.col(size) > chunk)
    sums = [F.count(F.lit(1)).alias("_n")]
    if weight is not None:
        sums.append(F.sum(weight).alias("_w"))
    per_bucket = hot.groupBy(group, "_bucket").agg(*sums)
    earlier = (
        Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_bucket.select(
        group,
        "_bucket",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n_before"),
        *([F.sum("_w").over(earlier).alias("_w_before")] if weight is not None else []),
    )
    joined = numbered.join(offsets, [group, "_bucket"], "left").withColumn(
        "position", F.col("_pos") + F.coalesce("_n_before", F.lit(0).cast("bigint"))
    )
    if weight is not None:
        none = F.lit(0).cast("bigint")
        joined = joined.withColumn("weight_before", F.coalesce("_wpos", none) + F.coalesce("_w_before", none)).drop("_wpos", "_w_before")
    return joined.drop("_hash", "_bucket", "_pos", "_n_before")
