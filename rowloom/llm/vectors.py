"""Helpers for columns of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import col

#: Components that become integers must be smaller than this, so that all sums fit 64 bits.
LARGEST = 1 << 16


def sound(vector: str) -> Column:
    """Is the vector there, and is each component a finite number?"""
    finite = F.forall(col(vector), lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(col(vector).isNotNull() & finite, F.lit(False))


def floors(vector: str, scale: int) -> Column:
    """``floor(scale * x)`` of each component; a component that is too large stops the job."""

    def one(x: Column) -> Column:
        x = x.cast("double")
        return F.when(F.abs(x) < LARGEST, F.floor(x * scale).cast("int")).otherwise(
            F.raise_error(F.concat(F.lit(f"a component is {LARGEST} or more: "), x.cast("string"))).cast("int"))

    return F.transform(col(vector), one)


def common_length(df: DataFrame, vector: str) -> int:
    """The length that most vectors have, the larger one of a tie; 0 if there is no vector."""
    found = df.groupBy(F.size(col(vector)).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return int(found.d) if found and found.d and found.d > 0 else 0


def matrix(lists: pa.Array, width: int, kind: type) -> np.ndarray:
    """The vectors of one length as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(lists), width)


def longs(values: pa.Array, none: int) -> np.ndarray:
    """Whole numbers, with ``none`` in place of nulls."""
    return values.cast(pa.int64()).fill_null(none).to_numpy(zero_copy_only=False)
