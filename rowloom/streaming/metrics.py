"""Numbers of a running stream, from the progress events of Structured Streaming."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

from rowloom.sources.readers import path_exists

SCHEMA = "query string, batch bigint, n_rows bigint, batch_seconds double, seconds_per_record double, lag string"


@dataclass
class _Log:
    rows: list = field(default_factory=list)
    consumed: int = 0
    last_input: float = 0.0


class StreamMetrics(StreamingQueryListener):
    """Messages consumed, seconds per record, and source lag, one row per micro-batch.

    ``on_idle`` is called once when no input came for ``idle_seconds``. With a ``path``, rows are appended
    to a table there whenever ``keep`` of them have come together; without one all stay in memory.
    """

    def __init__(
        self, idle_seconds: float = 60, on_idle=None, keep: int = 10_000, spark: SparkSession | None = None, path: str | None = None,
    ) -> None:
        if path is not None and spark is None:
            raise ValueError("a stored log needs a session")
        self.log = _Log()
        self.idle_seconds = idle_seconds
        self.on_idle = on_idle
        self.keep = keep
        self.spark = spark
        self.path = path
        self._flushed = True

    def onQueryStarted(self, event) -> None:  # noqa: N802 - Spark's name
        self.log.last_input = time.time()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.numInputRows == 0:
            self._check_idle()
            return
        self.log.last_input = time.time()
        self._flushed = False
        seconds = p.durationMs.get("triggerExecution", 0) / 1000
        lag = ",".join(str(s.metrics.get("maxOffsetsBehindLatest", "")) for s in p.sources if s.metrics)
        self.log.consumed += p.numInputRows
        self.log.rows.append((str(p.name or p.id), p.batchId, p.numInputRows, seconds, seconds / p.numInputRows, lag))
        if self.path is not None and len(self.log.rows) >= self.keep:
            full, self.log.rows = self.log.rows, []
            self.spark.createDataFrame(full, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._check_idle()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def _check_idle(self) -> None:
        if not self._flushed and self.on_idle and time.time() - self.log.last_input >= self.idle_seconds:
            self._flushed = True
            self.on_idle()

    def table(self, spark: SparkSession) -> DataFrame:
        latest = spark.createDataFrame(self.log.rows, SCHEMA)
        if self.path is not None and path_exists(spark, self.path):
            return spark.read.schema(SCHEMA).parquet(self.path).unionByName(latest)
        return latest
