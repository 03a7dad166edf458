"""Window assignment. The same functions serve tables and micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.times import epoch_micros
from rowloom.operators.numbering import running_before


def count_windows(
    numbered: DataFrame, size: int, slide: int = 0, seq: str = "seq", base: int = 0, total: int | None = None,
    keep_rest: bool = False, first_window: int = 0,
) -> DataFrame:
    """Add ``window``: every row goes to all windows of ``size`` rows that cover it.

    Rows are numbered by ``seq``; windows start at ``base`` and every ``slide`` rows (0: every
    ``size``). Only full windows count, unless ``keep_rest`` adds the last, partial one. Being
    arithmetic on the row number, this needs no shuffle and no task that sees the whole order.
    """
    slide = slide or size
    total = numbered.agg(F.max(seq)).first()[0] if total is None else total - 1
    n_rows = 0 if total is None else total + 1 - base
    n_full = 0 if n_rows < size else (n_rows - size) // slide + 1
    last = n_full - 1
    if keep_rest and n_rows > n_full * slide:
        last = n_full
    at = F.col(seq) - F.lit(base)
    lowest = F.greatest(F.lit(0), F.ceil((at - F.lit(size - 1)) / F.lit(slide)))
    highest = F.least(F.lit(last), F.floor(at / F.lit(slide)))
    in_range = (at >= 0) & (lowest <= highest)
    spread = F.sequence(lowest.cast("bigint"), highest.cast("bigint"), F.lit(1).cast("bigint"))
    windows = F.when(in_range, spread).otherwise(F.array().cast("array<bigint>"))
    return numbered.withColumn("window", F.explode(windows)).withColumn("window", F.col("window") + F.lit(first_window))


def micros(seconds: float) -> int:
    return round(seconds * 1_000_000)


def time_windows(df: DataFrame, ts: str, seconds: float, slide: float = 0) -> DataFrame:
    """Add ``window_start`` and ``window_end``; a slide of 0 gives tumbling windows."""
    window = F.window(ts, f"{micros(seconds)} microseconds", f"{micros(slide or seconds)} microseconds")
    return df.withColumn("_w", window).select(
        *df.columns, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end")
    )


def idle_sessions(df: DataFrame, ts: str, idle_seconds: int) -> DataFrame:
    """``session, session_start, session_end, n_rows``: runs of rows with no idle time between.

    Two rows of one time bucket of ``idle_seconds`` are never that far apart, so the rows shrink to
    one per bucket first. A bucket is compared with the one before by a join, and sessions are numbered
    by running sums over ranges of buckets, so no task sees the whole time.
    """
    bucket = F.floor(epoch_micros(df, ts) / F.lit(micros(idle_seconds)))
    buckets = df.groupBy(bucket.alias("bucket")).agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n")
    )
    # only the row before a bucket can be near enough, and where that has none, idle time went by
    before = buckets.select((F.col("bucket") + 1).alias("bucket"), F.col("last").alias("before"))
    joined = buckets.join(before, "bucket", "left")
    gap = epoch_micros(joined, "first") - epoch_micros(joined, "before")
    marked = joined.withColumn("starts", F.coalesce((gap >= micros(idle_seconds)).cast("bigint"), F.lit(1).cast("bigint")))
    marked = running_before(marked, "bucket", "starts", "earlier").withColumn("session", F.col("earlier") + F.col("starts") - 1)
    return marked.groupBy("session").agg(
        F.min("first").alias("session_start"), F.max("last").alias("session_end"), F.sum("n").alias("n_rows")
    )
