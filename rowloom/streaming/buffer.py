"""Count and time windows over a stream, with ids that go on across restarts.

Records, and how far windows have come, are tables in a state folder. A micro-batch numbers its
records, and hands all windows that became due to a handler at once. Everything is stored under the
batch id, so a batch that is run again replaces its own output. No operator needs the whole stream
in one task, which a keyed state with a single key would.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.times import epoch_micros
from rowloom.operators.cells import row_ids
from rowloom.options import StreamOptions
from rowloom.sources.readers import path_exists
from rowloom.streaming.windows import count_windows, micros, time_windows

Handler = Callable[[DataFrame, int], None]

#: One row per micro-batch: ``n_waiting`` records are in no full window yet (count windows).
BATCHES = "batch bigint, n_rows bigint, n_bad bigint, n_windows bigint, n_waiting bigint, seconds double"

_PROGRESS = "version bigint, n_records bigint, base bigint, n_windows bigint, fired_until timestamp"


@dataclass(frozen=True)
class Progress:
    version: int
    n_records: int
    base: int
    n_windows: int
    fired_until: object = None


class WindowBuffer:
    """Callback for ``foreachBatch``.

    ``order`` gives the order of arrival inside a micro-batch. ``handler(windows, version)`` gets
    the records of all due windows with a ``window`` number; ``first_id`` is the first row id, for
    streams that go on from a stored graph.

    ``checks`` are conditions by name, made of expressions that don't fail (``try_cast``, ``try_to_timestamp``).
    A record that doesn't fulfil all of them, or has no time where windows need one, goes to the table
    ``quarantine`` with the names of what it broke, gets no id, and doesn't stop the others. Each micro-batch stores
    its own measures (``BATCHES``).
    """

    def __init__(
        self, spark: SparkSession, state_path: str, options: StreamOptions, order: list[str], handler: Handler,
        ts: str | None = None, first_id: int = 0, checks: dict[str, Column] | None = None,
    ) -> None:
        if options.window_strategy == "time" and ts is None:
            raise ValueError("time windows need a timestamp column")
        self.spark = spark
        self.path = state_path
        self.options = options
        self.order = order
        self.handler = handler
        self.ts = ts
        self.first_id = first_id
        timed = {} if ts is None else {ts: F.col(ts).isNotNull()}
        self.checks = {**timed, **(checks or {})}
        # a flush comes from another thread than the micro-batches
        self._lock = threading.Lock()

    def progress(self, before: int | None = None) -> Progress:
        """The newest stored progress (older than ``before``)."""
        folder = f"{self.path}/progress"
        if path_exists(self.spark, folder):
            rows = self.spark.read.schema(_PROGRESS).parquet(f"{folder}/*")
            if before is not None:
                rows = rows.filter(F.col("version") < before)
            newest = rows.orderBy(F.col("version").desc()).limit(1).collect()
            if newest:
                return Progress(**newest[0].asDict())
        return Progress(-1, 0, 0, 0)

    def records(self, upto: int | None = None) -> DataFrame:
        stored = self.spark.read.option("basePath", f"{self.path}/records").parquet(f"{self.path}/records")
        return stored if upto is None else stored.filter(F.col("version") <= upto)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        with self._lock:
            self._take(batch, batch_id)

    def quarantine(self) -> DataFrame | None:
        """Records that broke a check, with ``reasons`` and ``version``; None where no batch was checked."""
        folder = f"{self.path}/quarantine"
        if not path_exists(self.spark, folder):
            return None
        return self.spark.read.option("basePath", folder).parquet(folder)

    def batches(self) -> DataFrame:
        """Measures of every micro-batch so far."""
        folder = f"{self.path}/batches"
        if not path_exists(self.spark, folder):
            return self.spark.createDataFrame([], BATCHES)
        return self.spark.read.schema(BATCHES).parquet(f"{folder}/*")

    def _set_apart(self, batch: DataFrame, version: int) -> tuple[DataFrame, int]:
        """The records that fulfil all checks, and the number of the others, which are stored."""
        if not self.checks:
            return batch, 0
        broken = F.array_compact(F.array(*[
            F.when(F.coalesce(holds, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, holds in self.checks.items()]))
        marked = batch.withColumn("reasons", broken)
        target = f"{self.path}/quarantine/version={version}"
        marked.filter(F.size("reasons") > 0).write.mode("overwrite").parquet(target)
        n_bad = self.spark.read.schema(marked.schema).parquet(target).count()
        return marked.filter(F.size("reasons") == 0).drop("reasons"), n_bad

    def _take(self, batch: DataFrame, batch_id: int) -> None:
        # even versions are micro-batches, odd ones are flushes between them
        version = 2 * batch_id
        began = time.monotonic()
        done = self.progress(before=version)
        good, n_bad = self._set_apart(batch, version)
        numbered = row_ids(good, order=self.order, start=done.n_records + self.first_id)
        numbered = numbered.withColumn("seq", F.col("rid_no") - F.lit(self.first_id))
        target = f"{self.path}/records/version={version}"
        numbered.write.mode("overwrite").parquet(target)
        n_new = self.spark.read.parquet(target).count()
        now = self._fire(done, version, done.n_records + n_new, keep_rest=False)
        waiting = now.n_records - now.base if self.options.window_strategy == "count" else None
        row = (batch_id, n_new, n_bad, now.n_windows - done.n_windows, waiting, time.monotonic() - began)
        self._store([row], BATCHES, f"batches/v{version}")

    def _store(self, rows: list[tuple], schema: str, name: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def flush(self) -> bool:
        """Process the rows of the last, partial window, as after a time without input.

        Does nothing where no record came since the last flush.
        """
        with self._lock:
            done = self.progress()
            rest = done.n_records > done.base if self.options.window_strategy == "count" else True
            if done.version < 0 or done.version % 2 or not rest:
                return False
            self._fire(done, done.version + 1, done.n_records, keep_rest=True)
            return True

    def _fire(self, done: Progress, version: int, total: int, keep_rest: bool) -> Progress:
        due = self._due_count(done, total, keep_rest) if self.options.window_strategy == "count" else self._due_time(
            done, version, keep_rest
        )
        windows, progress = due
        if windows is not None:
            self.handler(windows, version)
        row = (version, total, progress.base, progress.n_windows, progress.fired_until)
        self._store([row], _PROGRESS, f"progress/v{version}")
        return Progress(*row)

    def _due_count(self, done: Progress, total: int, keep_rest: bool):
        size = self.options.window_count
        slide = self.options.update_frequency or size
        n_rows = total - done.base
        n_full = 0 if n_rows < size else (n_rows - size) // slide + 1
        n_due = n_full + int(keep_rest and n_rows > n_full * slide)
        base = total if keep_rest else done.base + n_full * slide
        progress = Progress(0, total, base, done.n_windows + n_due)
        if n_due == 0:
            return None, progress
        # row numbers are sorted inside the files, so the filter skips those of earlier windows
        recent = self.records().filter((F.col("seq") >= done.base) & (F.col("seq") < total))
        return (
            count_windows(recent, size, slide, base=done.base, total=total, keep_rest=keep_rest, first_window=done.n_windows),
            progress,
        )

    def _due_time(self, done: Progress, version: int, keep_rest: bool):
        """Windows that closed since the last call, and closed ones that new records fall into.

        Late records thus fire their windows again, with all records; the same holds for windows
        that a flush handed out unfinished.
        """
        size = self.options.window_time
        slide = self.options.update_frequency or size
        recent = self.records(version)
        touched = recent.filter(F.col("version") == version)
        if done.fired_until is not None:
            first = touched.agg(F.min(self.ts).alias("t")).first().t
            since = done.fired_until if first is None else min(first, done.fired_until)
            recent = recent.filter(F.col(self.ts) >= F.lit(since) - F.expr(f"interval {micros(size)} microseconds"))
        assigned = time_windows(recent, self.ts, size, slide)
        newest = recent.agg(F.max(self.ts).alias("t")).first().t
        if newest is None:
            return None, done
        if done.fired_until is not None:
            touched = time_windows(touched, self.ts, size, slide).select(F.col("window_start").alias("touched")).distinct()
            assigned = assigned.join(touched, F.col("window_start") == F.col("touched"), "left").filter(
                (F.col("window_end") > F.lit(done.fired_until)) | F.col("touched").isNotNull()
            ).drop("touched")
        closed = F.col("window_end") <= F.lit(newest)
        if not keep_rest:
            assigned = assigned.filter(closed)
        ends = assigned.agg(F.max("window_end").alias("any"), F.max(F.when(closed, F.col("window_end"))).alias("closed")).first()
        if ends.any is None:
            return None, done
        number = F.floor(epoch_micros(assigned, "window_start") / F.lit(micros(slide)))
        windows = assigned.withColumn("window", number).drop("window_start", "window_end")
        until = max((t for t in (ends.closed, done.fired_until) if t is not None), default=None)
        return windows, Progress(0, done.n_records, done.base, done.n_windows, until)
