"""Writers of edges, walks, vectors, lists, pairs and run results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators.match import nested_list
from rowloom.options import NodeTypes
from rowloom.sources.readers import path_exists


def _lines_with_header(lines: DataFrame, column: str, header: str, path: str, mode: str) -> None:
    """Text lines; every part file starts with the header."""
    (
        lines.select(F.col(column).alias(header))
        .write.mode(mode).option("header", True).option("sep", "\u0001").option("quote", "").option("emptyValue", "").csv(path)
    )


def write_edges(edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet edge table; ``append`` for streams."""
    edges.write.mode(mode).parquet(path)


def write_edge_text(edges: DataFrame, types: NodeTypes, path: str, mode: str = "overwrite") -> None:
    """``"src","dst",w_fwd,w_back`` lines below a line with the node types."""
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    line = F.concat_ws(",", quoted("src"), quoted("dst"), F.col("w_fwd").cast("string"), F.col("w_back").cast("string"))
    _lines_with_header(edges.select(line.alias("line")), "line", ",".join(t.text() for t in types.types), path, mode)


def write_walks(walks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One space-joined sentence per line."""
    walks.select(F.array_join("walk", " ").alias("value")).write.mode(mode).text(path)


def write_embedding_text(vectors: DataFrame, path: str, mode: str = "overwrite") -> None:
    shape = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    line = F.concat_ws(" ", "key", F.array_join(F.transform("vector", lambda x: x.cast("string")), " "))
    _lines_with_header(vectors.select(line.alias("line")), "line", f"{shape.n} {shape.d or 0}", path, mode)


def save_model(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def write_candidates(candidates: DataFrame, path: str) -> None:
    candidates.write.mode("overwrite").parquet(path)


def write_pairs(pairs: DataFrame, left: str, right: str, path: str) -> None:
    """One ``a b`` line per matched pair of rows or columns."""
    pairs.select(F.concat_ws(" ", left, right).alias("value")).write.mode("overwrite").text(path)


# --- similarity lists -----------------------------------------------------------------------


def write_list(entries: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Snapshot of a whole list, one row or JSON line per id."""
    nested = nested_list(entries)
    if fmt == "json":
        nested.write.mode("overwrite").json(path)
    elif fmt == "parquet":
        nested.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def upsert_list(changed: DataFrame, path: str, version: int) -> None:
    """Store the lists of changed ids (``id, word, score, rank``) as one version.

    Only what changed is written; :func:`latest_list` takes the newest version of each id. Writing
    a version again replaces it, so a repeated micro-batch does no harm.
    """
    nested_list(changed).write.mode("overwrite").parquet(f"{path}/version={version}")


def latest_list(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """``id, similarity``: the newest stored list of every id."""
    schema = "id string, similarity array<struct<score: double, word: string>>"
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    versions = spark.read.schema(schema + ", version bigint").option("basePath", path).parquet(path)
    if before is not None:
        versions = versions.filter(F.col("version") < before)
    return versions.groupBy("id").agg(F.max_by("similarity", "version").alias("similarity"))


# --- run results ----------------------------------------------------------------------------


def append_result(spark: SparkSession, path: str, parameters: dict, metrics: dict, scores: DataFrame | None = None) -> None:
    """One row per run: parameters, metrics and scores as name-value maps."""
    text = lambda d: {str(k): str(v) for k, v in d.items()}
    row = dict(text(scores.first().asDict())) if scores is not None else {}
    schema = "finished timestamp, parameters map<string, string>, metrics map<string, string>, scores map<string, string>"
    result = spark.createDataFrame(
        [(None, text(parameters), text(metrics), row)], schema
    ).withColumn("finished", F.current_timestamp())
    result.coalesce(1).write.mode("append").parquet(path)
