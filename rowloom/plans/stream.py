"""A continuous run: records to windows, vectors and similarity lists, with a flush when input stops."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rowloom.options import StreamOptions
from rowloom.streaming.buffer import WindowBuffer
from rowloom.streaming.matcher import StreamMatcher
from rowloom.streaming.metrics import StreamMetrics


@dataclass(frozen=True)
class Run:
    spark: SparkSession
    query: StreamingQuery
    buffer: WindowBuffer
    matcher: StreamMatcher
    metrics: StreamMetrics

    def finish(self) -> DataFrame:
        """Wait for the end of the input, process the unfinished window, and return the similarity lists."""
        try:
            self.query.awaitTermination()
        finally:
            self.spark.streams.removeListener(self.metrics)
        self.buffer.flush()
        return self.matcher.similarity()


def start(
    spark: SparkSession, records: DataFrame, path: str, options: StreamOptions, order: list[str], *,
    ts: str | None = None, first_id: int = 0, trigger: dict | None = None, checks: dict[str, Column] | None = None, **matching,
) -> Run:
    """Start, or go on with, the run whose state is below ``path``.

    ``matching`` are arguments of :class:`StreamMatcher`. Ids, windows, graph, model and lists go on from
    their last version. After ``options.idle_seconds`` without input the unfinished window is processed.
    Records that break one of ``checks`` are set apart (:class:`WindowBuffer`).
    """
    matcher = StreamMatcher(spark, f"{path}/state", options, **matching)
    buffer = WindowBuffer(spark, f"{path}/state", options, order, matcher, ts=ts, first_id=first_id, checks=checks)
    metrics = StreamMetrics(options.idle_seconds, buffer.flush, spark=spark, path=f"{path}/metrics")
    spark.streams.addListener(metrics)
    writer = records.writeStream.foreachBatch(buffer).option("checkpointLocation", f"{path}/checkpoint")
    return Run(spark, writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start(), buffer, matcher, metrics)
