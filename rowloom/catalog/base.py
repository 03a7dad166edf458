"""Registry of the queries that the entry file offers, each with SQL to check it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def query(name: str, sql: str | None = None):
    """Register a query under a name. Its output is made comparable by :func:`comparable`."""

    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: comparable(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def comparable(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, fractions rounded, arrays as text."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            # + 0.0 turns a negative zero into zero
            c = F.round(c.cast("double"), DIGITS) + F.lit(0.0)
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StringType):
            c = F.array_join(c, " ")
        elif isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        columns.append(c.alias(field.name))
    return df.select(*columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(expression: str) -> str:
    return f"(round(CAST({expression} AS DOUBLE), {DIGITS}) + 0.0)"


def cells_sql(table_name: str, key: str, cols: dict[str, str], source: str | None = None) -> str:
    """Long cells of a table; kinds: ``text``, ``int``, ``real``."""
    parts = []
    for number, (col, kind) in enumerate(cols.items()):
        value = {
            "text": f"""replace(replace(replace({col}, '"', '\\"'), ',', ''), ' ', '_')""",
            "int": f"CAST({col} AS VARCHAR)",
            "real": f"CAST(CAST(trunc({col}) AS BIGINT) AS VARCHAR)",
        }[kind]
        parts.append(
            f"SELECT {key} AS rid_no, 'idx__' || {key} AS rid, {number} AS col_no, '{col}' AS col, 0 AS pos, "
            f"{value} AS value, {'false' if kind == 'text' else 'true'} AS is_numeric FROM {source or table_name}"
        )
    return " UNION ALL ".join(parts)


PART_COLS = {"p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "int", "p_retailprice": "real"}
PART_CELLS = cells_sql("part", "p_partkey", PART_COLS)
GRAPH_COLS = {"p_name": "text", "p_brand": "text", "p_type": "text"}


def edges_sql(cells: str, weight: str = "1.0 / (ln(f.frequency) / ln(10.0) + 1.0)") -> str:
    """CTE list ``cells, freq, edges`` for an edge list over whole values."""
    return f"""
cells AS ({cells}),
freq AS (SELECT value, count(*) AS frequency FROM cells GROUP BY value),
weighted AS (
  SELECT c.*, {weight} AS w, CASE WHEN is_numeric THEN 'tn__' ELSE 'tt__' END || c.value AS token
  FROM cells c JOIN freq f ON c.value = f.value),
edges AS (
  SELECT (rid_no * 100 + col_no) * 2 AS seq, rid_no, col_no, pos, 0 AS side, rid AS src, token AS dst,
         CAST(1.0 AS DOUBLE) AS w_fwd, CAST(w AS DOUBLE) AS w_back FROM weighted
  UNION ALL
  SELECT (rid_no * 100 + col_no) * 2 + 1, rid_no, col_no, pos, 1, token, 'cid__' || col, CAST(w AS DOUBLE), CAST(1.0 AS DOUBLE) FROM weighted)"""


def flat_sql(node: str, prefixes: tuple[str, ...]) -> str:
    """List of a node and its words, for the given prefixes."""
    chosen = ", ".join(f"'{p}'" for p in prefixes)
    return f"""CASE WHEN split_part({node}, '__', 1) IN ({chosen}) THEN list_distinct(list_append(
      list_transform(list_filter(string_split(substr({node}, instr({node}, '__') + 2), '_'), lambda x: x <> ''),
                     lambda x: split_part({node}, '__', 1) || '__' || x), {node})) ELSE [{node}] END"""


def graph_sql(edges: str, prefixes: tuple[str, ...] = ("tt",)) -> str:
    """CTEs ``edges, flat, both_ways, adj, deg, nodes`` of the graph over an edge list."""
    return f"""{edges},
spread AS (SELECT seq, w_fwd, w_back, dst, unnest({flat_sql('src', prefixes)}) AS a FROM edges),
spread_2 AS (SELECT seq, w_fwd, w_back, a, unnest({flat_sql('dst', prefixes)}) AS b FROM spread),
flat AS (SELECT seq, a AS src, b AS dst, w_fwd, w_back FROM spread_2 WHERE a <> b),
both_ways AS (SELECT seq * 2 AS seq, src AS node, dst AS nbr, w_fwd AS weight FROM flat WHERE w_fwd IS NOT NULL
  UNION ALL SELECT seq * 2 + 1, dst, src, w_back FROM flat WHERE w_back IS NOT NULL),
adj AS (SELECT node, nbr, arg_max(weight, seq) AS weight, count(*) AS n_edges FROM both_ways GROUP BY node, nbr),
deg AS (SELECT node, count(*) AS degree FROM adj GROUP BY node),
nodes AS (SELECT DISTINCT unnest({flat_sql('whole', prefixes)}) AS node
  FROM (SELECT src AS whole FROM edges UNION SELECT dst FROM edges))"""


PART_EDGES = edges_sql(PART_CELLS)
GRAPH_EDGES = edges_sql(cells_sql("part", "p_partkey", GRAPH_COLS))
PART_GRAPH = graph_sql(GRAPH_EDGES)
