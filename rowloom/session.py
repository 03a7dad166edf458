"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Small session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rowloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _configured_checkpoint_dir(spark: SparkSession) -> str | None:
    context = spark.sparkContext
    return (
        context.getCheckpointDir()
        or context.getConf().get("spark.checkpoint.dir")
        or spark.conf.get("spark.checkpoint.dir", None)
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the configured one, or a scratch folder in local mode only."""
    context = spark.sparkContext
    path = _configured_checkpoint_dir(spark)
    if path is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="rowloom-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and cut its lineage.

    Used in front of every loop, and wherever a result must not be computed a second time. The
    partitioning and the sort order of ``df`` survive, so later joins need no new shuffle.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def large(df: DataFrame) -> DataFrame:
    """Marks a side of a join that grows with the data: it is shuffled and never broadcast.

    Before it runs, Spark takes a table's size from the compressed files below it and leaves out what ``explode``
    makes, so it would collect tables of many times its limit on the driver.
    """
    return df.hint("merge")


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions of tables that are laid out by hand: as configured, in local mode a few per core."""
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    context = spark.sparkContext
    return min(wanted, 4 * context.defaultParallelism) if context.master.startswith("local") else wanted
