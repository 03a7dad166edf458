"""Value sets of two sources, key dictionaries, and vectors joined to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.text import base36, node_name, node_prefix, strip_prefix
from rowloom.operators.cells import raw_values
from rowloom.operators.hot_keys import frequent, lookup_join
from rowloom.operators.numbering import dense_index
from rowloom.options import NodeTypes
from rowloom.session import freeze, large


def shared_values(values_a: DataFrame, values_b: DataFrame) -> DataFrame:
    """Distinct values that occur in both tables (column ``value``)."""
    ends = values_a.select("value", F.lit(0).alias("side")).unionByName(values_b.select("value", F.lit(1).alias("side")))
    return ends.groupBy("value").agg(F.min("side").alias("least"), F.max("side").alias("most")).filter("least < most").select("value")


def source_intersection(source_a: DataFrame, source_b: DataFrame) -> DataFrame:
    """Raw cell values that occur in both sources, whatever the column."""
    return shared_values(raw_values(source_a), raw_values(source_b))


def split_sources(df: DataFrame, n_items: int, row: str = "rid_no") -> tuple[DataFrame, DataFrame]:
    """Rows below the boundary are source A, the rest source B."""
    return df.filter(F.col(row) < n_items), df.filter(F.col(row) >= n_items)


def intersecting_nodes(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """Nodes whose name, without prefix, is among the values."""
    named = nodes.withColumn("value", node_name(F.col("node")))
    return named.join(large(values.select("value")), "value", "left_semi").select("node")


# --- key dictionary -------------------------------------------------------------------------


def _words(name: Column) -> Column:
    return F.split(name, "_")


def key_dictionary(edges: DataFrame) -> DataFrame:
    """``token, code``: words of node names in sorted order, coded ``@`` + base 36."""
    names = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    words = _words(F.col("node"))
    words = names.select(F.explode(F.slice(words, F.lit(2), F.size(words))).alias("token"))
    distinct = words.filter("token <> ''").distinct()
    coded = dense_index(distinct, ["token"], "number")
    return coded.select("token", F.concat(F.lit("@"), base36(F.col("number"))).alias("code"))


def _translate(names: DataFrame, lookup: DataFrame, fixed: list[str], keep_unknown: bool) -> DataFrame:
    """``name, out``: replace the words of each name by ``lookup`` (``word, new``).

    Words in ``fixed`` are prefixes and get one more underscore. Other words are kept or dropped.
    """
    # the sketch of frequent words reads the names too, whose plan may be as large as that of all edges
    words = freeze(names).select("name", F.posexplode(_words(F.col("name"))).alias("at", "word"))
    found = lookup_join(words, lookup, ["word"], frequent(words, "word"), "left")
    is_fixed = F.col("word").isin(fixed) if fixed else F.lit(False)
    other = F.col("word") if keep_unknown else F.lit(None).cast("string")
    new = F.when(is_fixed, F.concat(F.col("word"), F.lit("_"))).otherwise(F.coalesce("new", other))
    parts = F.array_sort(F.collect_list(F.struct("at", new.alias("new"))))  # words of one name
    return found.groupBy("name").agg(F.array_join(F.transform(parts, lambda p: p["new"]), "_").alias("out"))


def compress_edges(edges: DataFrame, dictionary: DataFrame, types: NodeTypes) -> DataFrame:
    """Rewrite both endpoints word by word; the weights stay."""
    names = edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    lookup = dictionary.select(F.col("token").alias("word"), F.col("code").alias("new"))
    coded = freeze(_translate(names, lookup, types.prefixes, keep_unknown=False))  # four joins read it
    src = coded.select(F.col("name").alias("src"), F.col("out").alias("_src"))
    dst = coded.select(F.col("name").alias("dst"), F.col("out").alias("_dst"))
    joined = lookup_join(edges, src, ["src"], frequent(edges, "src"))
    joined = lookup_join(joined, dst, ["dst"], frequent(edges, "dst"))
    return joined.withColumns({"src": F.col("_src"), "dst": F.col("_dst")}).select(edges.columns)


def decode_words(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """Replace the coded words of a text column; words without a code are dropped."""
    names = df.select(F.col(column).alias("name")).distinct()
    lookup = dictionary.select(F.col("code").alias("word"), F.col("token").alias("new"))
    decoded = _translate(names, lookup, [], keep_unknown=False).withColumnRenamed("name", column)
    return df.join(large(decoded), column, "left").withColumn(column, F.col("out")).select(df.columns)


def decode_keys(vectors: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Turn coded embedding keys (``tt__@A_@1F``) back into node names."""
    split = vectors.withColumn("_prefix", node_prefix(F.col("key"))).withColumn("_name", node_name(F.col("key")))
    decoded = decode_words(split, "_name", dictionary)
    return decoded.withColumn("key", F.concat_ws("__", "_prefix", "_name")).select(vectors.columns)


def strip_prefixes(vectors: DataFrame, types: NodeTypes) -> DataFrame:
    return vectors.withColumn("key", strip_prefix(F.col("key"), types.prefixes))


# --- vectors of rows ------------------------------------------------------------------------


def row_vectors(df: DataFrame, key: str, cols: list[str], vectors: DataFrame, dimensions: int, prefix: str = "") -> DataFrame:
    """``key, vector``: the vectors of a row's values one after the other, zeros where unknown."""
    entries = F.array(*[F.col(c).cast("string") for c in cols])
    long = df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("row"), F.posexplode(entries).alias("at", "key"))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dimensions)
    found = long.join(large(vectors.select("key", F.col("vector").cast("array<float>").alias("vector"))), "key", "left")
    parts = F.array_sort(F.collect_list(F.struct("at", F.coalesce("vector", zeros).alias("v"))))  # one per column
    return found.groupBy("row").agg(F.flatten(F.transform(parts, lambda p: p["v"])).alias("vector")).withColumnRenamed(
        "row", "key"
    )
