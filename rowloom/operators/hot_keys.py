"""Joins with a lookup table that don't put all rows of a frequent key into one task.

Keys that make up a share of the rows can only be few, so their part of the lookup table is broadcast,
whatever the size of the data. Their rows are dealt out by a hash of the row; all others are joined as usual.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.session import large

#: A key is frequent with at least one in so many rows; there can't be more such keys than that.
SHARE = 256
#: Items that the sketch of frequent keys keeps count of, whatever the data.
_TRACKED = 8192
_SPREAD = 1 << 20


def frequent(df: DataFrame, key: str) -> DataFrame:
    """The frequent values of a column, by a sketch of bounded size."""
    top = df.agg(F.expr(f"approx_top_k(`{key}`, {SHARE}, {_TRACKED})").alias("top"), F.count(key).alias("n"))
    return top.select("n", F.explode("top").alias("e")).filter(
        F.col("e.item").isNotNull() & (F.col("e.count") * SHARE >= F.col("n"))).select(F.col("e.item").alias(key))


def frequent_by_count(lookup: DataFrame, on: list[str], count: str) -> DataFrame:
    """The frequent keys of a lookup table that says how many rows each key has."""
    total = lookup.agg(F.sum(count).alias("_total"))  # one row
    return lookup.join(F.broadcast(total), F.lit(True)).filter(F.col(count) * SHARE >= F.col("_total")).select(*on)


def lookup_join(rows: DataFrame, lookup: DataFrame, on: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the other columns of ``lookup``, which has one row per key; ``hot`` holds frequent keys.

    The result doesn't depend on ``hot``, and no more than ``SHARE`` rows of it may be given.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown kind of join {how!r}")
    values = [c for c in lookup.columns if c not in on]
    few = lookup.join(F.broadcast(hot), on, "left_semi").select(
        *(F.col(c).alias(f"_hot_{c}") for c in on), *(F.col(v).alias(f"_few_{v}") for v in values), F.lit(True).alias("_is_hot"))
    same = lambda prefix: [F.col(c) == F.col(f"{prefix}{c}") for c in on]
    marked = rows.join(F.broadcast(few), same("_hot_"), "left")
    apart = F.col("_is_hot") | reduce(Column.__or__, [F.col(c).isNull() for c in on])  # a null finds nothing
    spread = F.when(apart, F.pmod(F.xxhash64(*rows.columns), F.lit(_SPREAD)) + 1).otherwise(F.lit(0).cast("bigint"))
    # always 0, but the optimizer doesn't know, so that it stays a key and frequent rows are dealt by their own number
    zero = F.pmod(F.xxhash64(*on), F.lit(1).cast("bigint"))
    rest = lookup.select(*(F.col(c).alias(f"_key_{c}") for c in on), zero.alias("_zero"), *(F.col(v).alias(f"_rest_{v}") for v in values))
    joined = marked.withColumn("_spread", spread).join(large(rest), [*same("_key_"), F.col("_spread") == F.col("_zero")], "left")
    if how == "inner":
        joined = joined.filter(F.col("_is_hot") | F.col("_zero").isNotNull())
    found = [F.when(F.col("_is_hot"), F.col(f"_few_{v}")).otherwise(F.col(f"_rest_{v}")).alias(v) for v in values]
    return joined.select(*rows.columns, *found)
