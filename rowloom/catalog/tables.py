"""Queries on cells, frequencies, edge lists and dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.catalog.base import (
    GRAPH_EDGES, PART_CELLS, PART_COLS, PART_EDGES, cells_sql, edges_sql, query, rounded, table,
)
from rowloom.functions.smoothing import Smoothing
from rowloom.operators import cells as C
from rowloom.operators import edges as E
from rowloom.operators import sets as S
from rowloom.options import NodeTypes
from rowloom.session import freeze, large

LOG = Smoothing.parse("log")
TYPES = NodeTypes.parse()


def part_cells(spark, sf_dir, cols=None):
    return C.cells(table(spark, sf_dir, "part"), "p_partkey", cols or list(PART_COLS))


def part_edges(spark, sf_dir, cols=None, smoothing=LOG):
    return E.edge_list(part_cells(spark, sf_dir, cols), smoothing)


def part_halves(spark, sf_dir):
    """The two sources of ``part``: the boundary is half the row count."""
    part = table(spark, sf_dir, "part")
    half = part.agg(F.floor(F.count(F.lit(1)) / 2).cast("bigint").alias("n_items"))
    marked = part.join(F.broadcast(half), F.lit(True))  # one row
    cols = list(PART_COLS)
    return marked.filter("p_partkey < n_items").select("p_partkey", *cols), marked.filter("p_partkey >= n_items").select(
        "p_partkey", *cols
    )


@query("cells_long", f"SELECT rid_no, rid, col_no, col, pos, value, is_numeric FROM ({PART_CELLS})")
def cells_long(spark, sf_dir):
    return part_cells(spark, sf_dir)


_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(
    "numeric_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS col, bool_and(regexp_matches(CAST({c} AS VARCHAR), '{_NUMBER}')) AS is_numeric FROM customer"
        for c in _CUSTOMER
    ),
)
def numeric_columns(spark, sf_dir):
    # all columns as text, so that the values decide and not the schema
    customer = table(spark, sf_dir, "customer")
    return C.numeric_columns(customer.select([F.col(c).cast("string").alias(c) for c in _CUSTOMER]))


@query("row_ids", "SELECT c_name, c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS rid_no, 'idx__' || (row_number() OVER (ORDER BY c_name, c_custkey) - 1) AS rid FROM customer")
def row_ids(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_name", "c_custkey")
    return C.row_ids(customer, order=["c_name", "c_custkey"])


@query("value_frequency", f"WITH cells AS ({PART_CELLS}) SELECT value, count(*) AS frequency FROM cells GROUP BY value")
def value_frequency(spark, sf_dir):
    return C.value_frequency(part_cells(spark, sf_dir))


_RAW = " UNION ALL ".join(f"SELECT CAST({c} AS VARCHAR) AS value, p_partkey FROM part" for c in ("p_name", "p_brand", "p_type", "p_size"))
_TEXT_COLS = {"p_name": "text", "p_brand": "text", "p_type": "text"}
_TEXT_CELLS = cells_sql("part", "p_partkey", _TEXT_COLS)
# a value stays whole when both halves of the table hold it in brand or type
_SHARED = """half AS (SELECT count(*) // 2 AS n_items FROM part),
shared AS (SELECT value FROM cells, half WHERE col_no IN (1, 2) AND rid_no < n_items
  INTERSECT SELECT value FROM cells, half WHERE col_no IN (1, 2) AND rid_no >= n_items),
tokens AS (SELECT c.rid_no, c.rid, c.col_no, c.col, c.pos, c.is_numeric,
  unnest(CASE WHEN s.value IS NULL THEN string_split(c.value, '_') ELSE [c.value] END) AS value,
  unnest(range(0, len(CASE WHEN s.value IS NULL THEN string_split(c.value, '_') ELSE [c.value] END))) AS sub
  FROM cells c LEFT JOIN shared s ON c.value = s.value)"""


def part_tokens(spark, sf_dir):
    a, b = part_halves(spark, sf_dir)
    keep = [C.cells(x, "p_partkey", ["p_brand", "p_type"]) for x in (a, b)]
    cells = part_cells(spark, sf_dir, list(_TEXT_COLS))
    return C.tokens(cells, flatten=True, keep=S.shared_values(*keep))


@query("token_frequency", f"WITH cells AS ({_TEXT_CELLS}), {_SHARED} SELECT value, count(*) AS frequency FROM tokens WHERE value <> '' GROUP BY value")
def token_frequency(spark, sf_dir):
    return C.value_frequency(part_tokens(spark, sf_dir))


_STEP = "pow(0.01 / 0.8, 1.0 / (1.0 - 200.0))"
_METHODS = {
    "no": "1.0",
    "smooth": f"0.8 * pow({_STEP}, 1.0 - frequency) + 0.2",
    "smooth,0.5,10": "0.5 * pow(pow(0.01 / 0.5, 1.0 / (1.0 - 10.0)), 1.0 - frequency) + 0.5",
    "inverse_smooth": "0.5 * (2.0 - pow(1.1, 1.0 - frequency))",
    "inverse": "1.0 / frequency",
    "log": "1.0 / (ln(frequency) / ln(10.0) + 1.0)",
    "log,2": "1.0 / (ln(frequency) / ln(2.0) + 1.0)",
}


@query(
    "smoothing_methods",
    f"WITH cells AS ({PART_CELLS}), freq AS (SELECT value, CAST(count(*) AS DOUBLE) AS frequency FROM cells GROUP BY value) "
    + " UNION ALL ".join(f"SELECT value, '{m}' AS method, {rounded(sql)} AS weight FROM freq" for m, sql in _METHODS.items()),
)
def smoothing_methods(spark, sf_dir):
    freq = C.value_frequency(part_cells(spark, sf_dir))
    rows = [F.struct(F.lit(m).alias("method"), Smoothing.parse(m).weight(F.col("frequency")).alias("weight")) for m in _METHODS]
    return freq.select("value", F.inline(F.array(*rows)))


def _plain(edges):
    return edges.select(
        F.col("edge_seq.rid").alias("rid"), F.col("edge_seq.col").alias("col"), F.col("edge_seq.pos").alias("pos"),
        F.col("edge_seq.side").alias("side"), "src", "dst", "w_fwd", "w_back",
    )


_EDGE_OUT = f"SELECT rid_no AS rid, col_no AS col, pos, side, src, dst, {rounded('w_fwd')} AS w_fwd, {rounded('w_back')} AS w_back FROM edges"


@query("edge_list", f"WITH {PART_EDGES} {_EDGE_OUT}")
def edge_list(spark, sf_dir):
    return _plain(part_edges(spark, sf_dir))


@query("edge_list_unweighted", f"WITH {edges_sql(PART_CELLS, '1.0')} {_EDGE_OUT}")
def edge_list_unweighted(spark, sf_dir):
    return _plain(part_edges(spark, sf_dir, smoothing=Smoothing()))


@query(
    "edge_list_raw_frequency",
    f"""WITH cells AS ({_TEXT_CELLS}),
raw AS (SELECT value, count(*) AS frequency FROM
  (SELECT p_name AS value FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT p_type FROM part) GROUP BY value),
weighted AS (SELECT c.*, coalesce(1.0 / frequency, 1.0) AS w, 'tt__' || c.value AS token FROM cells c LEFT JOIN raw r ON c.value = r.value),
edges AS (SELECT rid_no, col_no, pos, 0 AS side, rid AS src, token AS dst, 1.0 AS w_fwd, w AS w_back FROM weighted
  UNION ALL SELECT rid_no, col_no, pos, 1, token, 'cid__' || col, w, 1.0 FROM weighted) {_EDGE_OUT}""",
)
def edge_list_raw_frequency(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    raw = C.value_frequency(C.raw_values(part, list(_TEXT_COLS)))
    cells = part_cells(spark, sf_dir, list(_TEXT_COLS))
    return _plain(E.edge_list(cells, Smoothing.parse("inverse"), raw))


@query(
    "edge_list_tokens",
    f"""WITH cells AS ({_TEXT_CELLS}), {_SHARED},
freq AS (SELECT value, count(*) AS frequency FROM tokens WHERE value <> '' GROUP BY value),
weighted AS (SELECT t.*, coalesce(1.0 / (ln(frequency) / ln(10.0) + 1.0), 1.0) AS w, 'tt__' || t.value AS token
  FROM tokens t LEFT JOIN freq f ON t.value = f.value),
edges AS (SELECT rid_no, col_no, sub AS pos, 0 AS side, rid AS src, token AS dst, 1.0 AS w_fwd, w AS w_back FROM weighted
  UNION ALL SELECT rid_no, col_no, sub, 1, token, 'cid__' || col, w, 1.0 FROM weighted) {_EDGE_OUT}""",
)
def edge_list_tokens(spark, sf_dir):
    edges = E.edge_list(part_tokens(spark, sf_dir), LOG)
    return _plain(edges.withColumn("edge_seq", F.struct(
        F.col("edge_seq.rid"), F.col("edge_seq.col"), F.col("edge_seq.sub").alias("pos"), F.col("edge_seq.side"))))


@query(
    "list_cells",
    """SELECT rid_no, col, i - 1 AS pos, words[i] AS value FROM (
  SELECT p_partkey AS rid_no, unnest(['text_list', 'word_array']) AS col, string_split(p_name, ' ') AS words,
         unnest([1, 1]) AS one FROM part), LATERAL (SELECT unnest(range(1, len(words) + 1)) AS i)""",
)
def list_cells(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.lit("['"), F.replace("p_name", F.lit(" "), F.lit("', '")), F.lit("']")).alias("text_list"),
        F.split("p_name", " ").alias("word_array"),
    )
    return C.cells(part, "p_partkey").select("rid_no", "col", "pos", "value")


@query(
    "event_edges",
    "WITH " + edges_sql(cells_sql("events", "event_id", {"user_id": "int", "event_type": "text", "value": "real"}), "1.0 / f.frequency")
    + f" SELECT src, dst, {rounded('w_fwd')} AS w_fwd, {rounded('w_back')} AS w_back FROM edges",
)
def event_edges(spark, sf_dir):
    cells = C.cells(table(spark, sf_dir, "events"), "event_id", ["user_id", "event_type", "value"])
    return E.edge_list(cells, Smoothing.parse("inverse")).select("src", "dst", "w_fwd", "w_back")


@query(
    "adjacency_map",
    f"""WITH {PART_EDGES}, both_ways AS (SELECT seq * 2 AS seq, src AS node, dst AS nbr, w_fwd AS weight FROM edges
  UNION ALL SELECT seq * 2 + 1, dst, src, w_back FROM edges)
SELECT node, nbr, {rounded('arg_max(weight, seq)')} AS weight FROM both_ways GROUP BY node, nbr""",
)
def adjacency_map(spark, sf_dir):
    return E.adjacency_rows(part_edges(spark, sf_dir))


_IDS = """ids AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS node_id FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges))"""


@query("dense_ids", f"WITH {PART_EDGES}, {_IDS} SELECT node, node_id FROM ids")
def dense_ids(spark, sf_dir):
    return E.node_ids(part_edges(spark, sf_dir))


@query(
    "numeric_adjacency",
    f"""WITH {PART_EDGES}, {_IDS} SELECT DISTINCT a.node_id, b.node_id AS nbr_id FROM
  (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges) e JOIN ids a ON e.src = a.node JOIN ids b ON e.dst = b.node""",
)
def numeric_adjacency(spark, sf_dir):
    return E.numeric_adjacency(part_edges(spark, sf_dir))


@query("undirected_edges", f"WITH {PART_EDGES} SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges")
def undirected_edges(spark, sf_dir):
    return E.undirected_edges(part_edges(spark, sf_dir))


@query(
    "n_tokens",
    """SELECT (count(*) + (SELECT count(*) FROM (SELECT c_name AS v FROM customer UNION SELECT c_mktsegment FROM customer
  UNION SELECT CAST(c_custkey AS VARCHAR) FROM customer UNION SELECT CAST(c_nationkey AS VARCHAR) FROM customer)) + 4) * 10 AS n_tokens
FROM customer""",
)
def n_tokens(spark, sf_dir):
    return C.distinct_token_estimate(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


_HALF_VALUES = """half AS (SELECT count(*) // 2 AS n_items FROM part),
v AS (SELECT CASE WHEN p_partkey < n_items THEN 'a' ELSE 'b' END AS source, unnest([p_name, p_brand, p_type, CAST(p_size AS VARCHAR)]) AS value FROM part, half)"""


def _half_sources(spark, sf_dir):
    cols = ["p_name", "p_brand", "p_type", "p_size"]
    return [x.select(*cols) for x in part_halves(spark, sf_dir)]


@query("source_values", f"WITH {_HALF_VALUES} SELECT source, value, count(*) AS frequency FROM v GROUP BY source, value")
def source_values(spark, sf_dir):
    a, b = _half_sources(spark, sf_dir)
    return C.values_by_source({"a": a, "b": b})


@query("source_intersection", f"WITH {_HALF_VALUES} SELECT value FROM v WHERE source = 'a' INTERSECT SELECT value FROM v WHERE source = 'b'")
def source_intersection(spark, sf_dir):
    return S.source_intersection(*_half_sources(spark, sf_dir))


# --- dictionary -----------------------------------------------------------------------------

_B36 = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_DICT = f"""names AS (SELECT src AS name FROM edges UNION SELECT dst FROM edges),
words AS (SELECT name, unnest(string_split(name, '_')) AS word, unnest(range(0, len(string_split(name, '_')))) AS place FROM names),
numbered AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS n FROM (SELECT DISTINCT word AS token FROM words WHERE place > 0 AND word <> '')),
dict AS (SELECT token, '@' || ltrim(concat(substr({_B36}, (n // 46656) % 36 + 1, 1), substr({_B36}, (n // 1296) % 36 + 1, 1),
  substr({_B36}, (n // 36) % 36 + 1, 1)), '0') || substr({_B36}, n % 36 + 1, 1) AS code FROM numbered),
coded AS (SELECT name, string_agg(CASE WHEN word IN ('tn', 'tt', 'idx', 'cid') THEN word || '_' ELSE code END, '_' ORDER BY place) AS out
  FROM words LEFT JOIN dict ON word = token GROUP BY name)"""


@query("dict_codes", f"WITH {GRAPH_EDGES}, {_DICT} SELECT token, code FROM dict")
def dict_codes(spark, sf_dir):
    return S.key_dictionary(part_edges(spark, sf_dir, list(_TEXT_COLS)))


@query(
    "compressed_edges",
    f"""WITH {GRAPH_EDGES}, {_DICT} SELECT a.out AS src, b.out AS dst, {rounded('w_fwd')} AS w_fwd, {rounded('w_back')} AS w_back
FROM edges e JOIN coded a ON e.src = a.name JOIN coded b ON e.dst = b.name""",
)
def compressed_edges(spark, sf_dir):
    edges = part_edges(spark, sf_dir, list(_TEXT_COLS))
    return S.compress_edges(edges, S.key_dictionary(edges), TYPES).select("src", "dst", "w_fwd", "w_back")


@query("dict_round_trip", f"WITH {GRAPH_EDGES} SELECT name, name AS decoded FROM (SELECT src AS name FROM edges UNION SELECT dst FROM edges)")
def dict_round_trip(spark, sf_dir):
    # each step reads its input several times: without these cuts the plan would hold the edges some hundred times
    edges = freeze(part_edges(spark, sf_dir, list(_TEXT_COLS)))
    dictionary = S.key_dictionary(edges)
    coded = S.compress_edges(edges, dictionary, TYPES).select("edge_seq", F.col("src").alias("src_key"), F.col("dst").alias("dst_key"))
    ends = F.array(*[F.struct(F.col(e).alias("name"), F.col(f"{e}_key").alias("key")) for e in ("src", "dst")])
    names = freeze(edges.select("edge_seq", "src", "dst").join(large(coded), "edge_seq").select(F.inline(ends)).distinct())
    return S.decode_keys(names, dictionary).select("name", F.col("key").alias("decoded"))


@query("decode_table", f"WITH {GRAPH_EDGES} SELECT DISTINCT substr(src, 5) AS name FROM edges WHERE src LIKE 'tt__%'")
def decode_table(spark, sf_dir):
    edges = part_edges(spark, sf_dir, list(_TEXT_COLS))
    dictionary = S.key_dictionary(edges)
    coded = S.compress_edges(edges, dictionary, TYPES).filter(F.col("src").startswith("tt__"))
    return S.decode_words(coded.select(F.expr("substring(src, 5)").alias("name")).distinct(), "name", dictionary)


@query("strip_prefixes", f"WITH {PART_EDGES} SELECT node, CASE WHEN split_part(node, '__', 1) IN ('tn', 'tt', 'idx', 'cid') THEN substr(node, instr(node, '__') + 2) ELSE node END AS key FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges)")
def strip_prefixes(spark, sf_dir):
    edges = part_edges(spark, sf_dir)
    names = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return S.strip_prefixes(names.withColumn("key", F.col("node")), TYPES)


@query(
    "row_vectors",
    """WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), zero AS (SELECT list_transform(range(64), lambda x: 0.0) AS z),
looked AS (SELECT n.c_custkey, list_concat(coalesce(a.v, z), coalesce(b.v, z)) AS v FROM customer n CROSS JOIN zero LEFT JOIN t a ON a.vec_id = n.c_custkey LEFT JOIN t b ON b.vec_id = n.c_nationkey * 7)
SELECT 'row_' || c_custkey AS key, len(v) AS n, round(CAST(list_sum(list_transform(v, lambda x, i: x * i)) AS DOUBLE), 3) + 0.0 AS total FROM looked""",
)
def row_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("key"), F.col("embedding").alias("vector"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") * 7).alias("far"), F.col("c_custkey").alias("near"))
    rows = S.row_vectors(customer, "c_custkey", ["near", "far"], vectors, 64, prefix="row_")
    weighted = F.transform("vector", lambda x, i: x.cast("double") * (i + 1))
    total = F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)
    return rows.select("key", F.size("vector").alias("n"), (F.round(total, 3) + 0.0).alias("total"))
