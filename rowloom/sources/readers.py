"""Readers of tables, edges, walks, vectors, truths, lists, tests and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.operators.edges import EDGE_SCHEMA
from rowloom.options import NodeTypes

# a separator that no text holds: makes the CSV reader give whole lines, without the first
_NO_SEPARATOR = "\u0001"


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV with a header; lines that do not fit the schema are skipped.

    Without a schema all columns are text, named by the header, which needs no pass over the data.
    ``multi_line`` reads quoted cells with line breaks whole; Spark then reads a file in one task, so
    such data should come in many files.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.option("multiLine", multi_line).option("mode", "DROPMALFORMED").csv(path)


def _lines_after_header(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema("value string").option("header", True).option("sep", _NO_SEPARATOR).option("quote", "").csv(path)
    )


def read_node_types(spark: SparkSession, path: str) -> NodeTypes:
    """The first line of an edge-list file."""
    line = spark.read.text(path).first()
    if line is None:
        raise ValueError(f"edge list {path} is empty")
    return NodeTypes.parse(part.strip().strip('"') for part in line.value.split(","))


def read_edge_list(spark: SparkSession, path: str) -> tuple[NodeTypes, DataFrame]:
    """Node types and edges. Two fields: no weights; three: one-way; four: both weights.

    A weight that is not a number stops the job.
    """
    edges = (
        spark.read.schema(EDGE_SCHEMA.replace("double", "string"))
        .option("header", True)
        .option("quote", '"')
        .option("ignoreLeadingWhiteSpace", True)
        .csv(path)
    )

    def weight(name: str):
        wrong = F.raise_error(F.concat(F.lit("not a weight: "), F.col(name)))
        return F.when(F.col(name).isNotNull(), F.coalesce(F.trim(name).try_cast("double"), wrong)).alias(name)

    line = F.monotonically_increasing_id()
    zero = F.lit(0)
    seq = F.struct(line.alias("rid"), zero.alias("col"), zero.alias("pos"), zero.alias("sub"), zero.alias("side"))
    return read_node_types(spark, path), edges.select(seq.alias("edge_seq"), "src", "dst", weight("w_fwd"), weight("w_back"))


def read_edge_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Only the endpoints; lines with nulls or with more than four fields are skipped."""
    wide = (
        spark.read.schema(EDGE_SCHEMA.replace("double", "string") + ", extra string")
        .option("header", True)
        .option("quote", '"')
        .csv(path)
    )
    return wide.filter("extra is null").select("src", "dst").na.drop()


def edges_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """A parquet edge table, or an empty one where none was written yet."""
    if path_exists(spark, path):
        return spark.read.parquet(path)
    seq = "edge_seq struct<rid: bigint, col: int, pos: int, sub: int, side: int>, "
    return spark.createDataFrame([], seq + EDGE_SCHEMA)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def stored_versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions for which ``folder`` has a subfolder ``version=<n>``, in rising order."""
    if not path_exists(spark, folder):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))


def read_walks(spark: SparkSession, path: str) -> DataFrame:
    """One sentence per line."""
    return spark.read.text(path).filter("value <> ''").select(
        F.monotonically_increasing_id().cast("string").alias("walk_id"), F.split("value", " ").alias("walk")
    )


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Vectors from text: a line with count and size, then ``key v1 v2 ...``."""
    parts = F.split(F.trim("value"), " ")
    return _lines_after_header(spark, path).select(
        F.get(parts, F.lit(0)).alias("key"),
        F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda x: x.cast("float")).alias("vector"),
    )


def read_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """``item, match`` lines; the single ``_`` of the ids becomes ``__``."""
    raw = spark.read.schema("item string, match string").csv(path)
    fixed = lambda c: F.replace(F.trim(c), F.lit("_"), F.lit("__"))
    return raw.na.drop().select(fixed("item").alias("item"), fixed("match").alias("match"))


def read_column_truth(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("left_col string, right_col string").csv(path)
    return raw.na.drop().select(F.trim("left_col").alias("left_col"), F.trim("right_col").alias("right_col")).distinct()


def read_source_boundary(spark: SparkSession, path: str) -> int:
    """Number of rows of source A: the second field of the first line."""
    return int(spark.read.text(path).first().value.split(",")[1])


def read_value_similarities(spark: SparkSession, path: str) -> DataFrame:
    """``a, b, distance``; the distance is 1 where the file has two columns."""
    raw = spark.read.option("header", True).csv(path)
    first, second, *rest = raw.columns
    distance = F.col(rest[0]).cast("double") if rest else F.lit(1.0)
    return raw.select(F.col(first).alias("a"), F.col(second).alias("b"), distance.alias("distance"))


def _entries(text):
    """``[[score, id], ...]`` as JSON to scored words."""
    parsed = F.from_json(text, "array<array<string>>")
    return F.transform(parsed, lambda e: F.struct(F.get(e, F.lit(0)).cast("double").alias("score"), F.get(e, F.lit(1)).alias("word")))


def read_similarity_list(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``id, similarity``. A missing path is an error.

    ``parquet``: our own table, or ``key, value`` with the entries as JSON. ``json``: one object per
    line. ``json_object``: one object for all ids in one file, which Spark cannot split.
    """
    if fmt == "parquet":
        table = spark.read.parquet(path)
        if "value" in table.columns:
            return table.select(F.col("key").alias("id"), _entries(F.col("value")).alias("similarity"))
        return table.select("id", "similarity")
    if fmt == "json":
        return spark.read.schema("id string, similarity array<struct<score: double, word: string>>").json(path)
    if fmt == "json_object":
        whole = spark.read.text(path, wholetext=True)
        entries = F.explode(F.from_json("value", "map<string, array<array<string>>>")).alias("id", "e")
        return whole.select(entries).select("id", _entries(F.to_json("e")).alias("similarity"))
    raise ValueError(f"unknown format {fmt!r}")


def read_quality_tests(spark: SparkSession, path: str) -> DataFrame:
    """``test_id, file, terms, expected``: one list per line, its last term is the odd one."""
    lines = spark.read.text(path).select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"),
        F.monotonically_increasing_id().alias("line"),
        F.from_json("value", "array<string>", {"allowSingleQuotes": "true"}).alias("terms"),
    )
    return lines.filter(F.size("terms") > 0).select(
        F.concat_ws("#", "file", F.col("line").cast("string")).alias("test_id"),
        "file", "terms", F.element_at("terms", -1).alias("expected"),
    )


# --- streams --------------------------------------------------------------------------------


def kafka_records(spark: SparkSession, servers: str, topic: str, schema, starting: str = "latest", **options: str) -> DataFrame:
    """JSON records of a topic. Offsets are kept in the checkpoint of the query."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
    )
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load().select(
        F.from_json(F.col("value").cast("string"), schema).alias("r"), "partition", "offset", "timestamp"
    ).select("r.*", F.col("partition").alias("_partition"), F.col("offset").alias("_offset"), F.col("timestamp").alias("_arrival"))


def json_records(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """JSON lines from files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)
