"""Time expressions for both timestamp types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970; times without a zone count as UTC, whatever the session says."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column))
    return F.unix_micros(column)


def epoch_seconds(df: DataFrame, column: str) -> Column:
    return F.floor(epoch_micros(df, column) / F.lit(1_000_000)).cast("bigint")
