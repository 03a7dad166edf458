"""Queries on graph tables and random walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.catalog.base import (
    GRAPH_COLS, GRAPH_EDGES, PART_CELLS, PART_COLS, PART_GRAPH, cells_sql, edges_sql, graph_sql, query, rounded, table,
)
from rowloom.catalog.tables import LOG, TYPES, part_edges, part_halves
from rowloom.functions.smoothing import Smoothing
from rowloom.operators import cells as C
from rowloom.operators import edges as E
from rowloom.operators import graph as G
from rowloom.operators import sets as S
from rowloom.operators import similar as R
from rowloom.operators import tripartite as L
from rowloom.operators import walks as W
from rowloom.options import NodeTypes, WalkOptions

LENGTH = 6
SEED = 42


def graph_edges(spark, sf_dir):
    return part_edges(spark, sf_dir, list(GRAPH_COLS))


def flat_edges(spark, sf_dir):
    return G.flattened_edges(graph_edges(spark, sf_dir), TYPES, "tt")


def part_adjacency(spark, sf_dir):
    return G.adjacency(flat_edges(spark, sf_dir))


def part_nodes(spark, sf_dir):
    return G.node_catalog(graph_edges(spark, sf_dir), TYPES, "tt")


_FLAGS = """split_part(node, '__', 1) AS prefix, split_part(node, '__', 1) = 'idx' AS is_first,
split_part(node, '__', 1) IN ('tn', 'tt') AS is_root, true AS is_appear"""


@query("node_catalog", f"WITH {PART_GRAPH} SELECT node, {_FLAGS}, split_part(node, '__', 1) = 'tn' AS is_numeric FROM nodes")
def node_catalog(spark, sf_dir):
    return part_nodes(spark, sf_dir)


@query("flattened_edges", f"WITH {PART_GRAPH} SELECT src, dst, {rounded('w_fwd')} AS w_fwd, {rounded('w_back')} AS w_back FROM flat")
def flattened_edges(spark, sf_dir):
    return flat_edges(spark, sf_dir).select("src", "dst", "w_fwd", "w_back")


@query("adjacency", f"WITH {PART_GRAPH} SELECT node, nbr, {rounded('weight')} AS weight, n_edges FROM adj")
def adjacency(spark, sf_dir):
    return part_adjacency(spark, sf_dir)


_ALL_GRAPH = graph_sql(edges_sql(cells_sql("customer", "c_custkey", {"c_name": "text", "c_nationkey": "int"}), "1.0 / f.frequency"), ("tn", "tt", "idx", "cid"))


@query("adjacency_flatten_all", f"WITH {_ALL_GRAPH} SELECT node, nbr, {rounded('weight')} AS weight, n_edges FROM adj")
def adjacency_flatten_all(spark, sf_dir):
    cells = C.cells(table(spark, sf_dir, "customer"), "c_custkey", ["c_name", "c_nationkey"])
    return G.adjacency(G.flattened_edges(E.edge_list(cells, Smoothing.parse("inverse")), TYPES, "all"))


_ONE_WAY = "SELECT seq, src, dst, w_fwd, CASE WHEN side = 1 THEN NULL ELSE w_back END AS w_back FROM edges"


def _one_way_edges(spark, sf_dir):
    edges = graph_edges(spark, sf_dir)
    return edges.withColumn("w_back", F.when(F.col("edge_seq.side") == 0, F.col("w_back")))


def _directed(back: str) -> str:
    return f"""WITH {GRAPH_EDGES}, e AS ({_ONE_WAY}),
b AS (SELECT seq * 2 AS seq, src AS node, dst AS nbr, w_fwd AS weight FROM e UNION ALL SELECT seq * 2 + 1, dst, src, {back} FROM e)
SELECT node, nbr, {rounded('arg_max(weight, seq)')} AS weight, count(*) AS n_edges FROM b WHERE weight IS NOT NULL GROUP BY node, nbr"""


@query("directed_edges", _directed("w_back"))
def directed_edges(spark, sf_dir):
    return G.adjacency(G.flattened_edges(_one_way_edges(spark, sf_dir), TYPES))


@query("directed_back_edges", _directed("coalesce(w_back, w_fwd)"))
def directed_back_edges(spark, sf_dir):
    return G.adjacency(G.flattened_edges(_one_way_edges(spark, sf_dir), TYPES, directed_back_edge=True))


@query("isolated_nodes", f"WITH {GRAPH_EDGES}, e AS ({_ONE_WAY}) SELECT DISTINCT dst AS node FROM e WHERE dst NOT IN (SELECT src FROM e UNION SELECT dst FROM e WHERE w_back IS NOT NULL)")
def isolated_nodes(spark, sf_dir):
    edges = _one_way_edges(spark, sf_dir)
    return G.isolated_nodes(G.node_catalog(edges, TYPES), G.adjacency(G.flattened_edges(edges, TYPES)))


@query("is_uniform", f"WITH {GRAPH_EDGES} SELECT bool_and(w_fwd = w_back) AS is_uniform FROM edges")
def is_uniform(spark, sf_dir):
    return G.is_uniform(graph_edges(spark, sf_dir))


@query("roots", f"WITH {PART_GRAPH} SELECT node FROM nodes WHERE split_part(node, '__', 1) IN ('tn', 'tt')")
def roots(spark, sf_dir):
    return G.roots(part_nodes(spark, sf_dir))


@query("first_bag", f"WITH {PART_GRAPH} SELECT node, nbr AS first, n_edges AS copies FROM adj WHERE nbr LIKE 'idx\\_\\_%' ESCAPE '\\'")
def first_bag(spark, sf_dir):
    return G.first_bag(part_adjacency(spark, sf_dir), TYPES)


@query("transition_probability", f"WITH {PART_GRAPH} SELECT node, nbr, {rounded('weight / sum(weight) OVER (PARTITION BY node)')} AS probability FROM adj")
def transition_probability(spark, sf_dir):
    return G.transition_probability(part_adjacency(spark, sf_dir))


@query("walk_budget", f"WITH {PART_GRAPH} SELECT count(*) * 1000 // 60 AS n_sentences FROM nodes")
def walk_budget(spark, sf_dir):
    return G.sentence_budget(part_nodes(spark, sf_dir), 60)


_HASH = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
_SLOTS = f"""slots AS (SELECT a.node, row_number() OVER (PARTITION BY a.node ORDER BY {_HASH.format('a.nbr')}, a.nbr) - 1 AS slot, a.nbr, d.degree, n.degree AS nbr_degree
  FROM adj a JOIN deg d ON a.node = d.node JOIN deg n ON a.nbr = n.node)"""


@query("uniform_slots", f"WITH {PART_GRAPH}, {_SLOTS} SELECT node, slot, nbr, degree, nbr_degree FROM slots")
def uniform_slots(spark, sf_dir):
    return G.uniform_slots(part_adjacency(spark, sf_dir))


@query(
    "split_hub_slots",
    f"WITH {PART_GRAPH}, {_SLOTS} SELECT node, slot, nbr, degree FROM slots",  # the same at every size
)
def split_hub_slots(spark, sf_dir):
    return G.uniform_slots(part_adjacency(spark, sf_dir), chunk=100).select("node", "slot", "nbr", "degree")


_FULL = 1 << 60


def ranges_sql(name: str, source: str, weight: str) -> str:
    """CTEs that divide the 60-bit range of each node of ``source (node, nbr, <weight>)`` by weight."""
    bound = f"CAST(ceil(CAST({{}} AS DOUBLE) / CAST(total AS DOUBLE) * CAST({_FULL} AS DOUBLE)) AS BIGINT)"
    return f"""{name}_sized AS (SELECT node, nbr, CAST({weight} AS DOUBLE) AS weight, count(*) OVER (PARTITION BY node) AS degree, max(CAST({weight} AS DOUBLE)) OVER (PARTITION BY node) AS largest FROM {source}),
{name}_whole AS (SELECT node, nbr, degree, greatest(1, CAST(floor(weight / largest * CAST((1::BIGINT << (61 - length(bin(degree)))) AS DOUBLE)) AS BIGINT)) AS w FROM {name}_sized),
{name}_sums AS (SELECT node, nbr, degree, w, CAST(sum(w) OVER (PARTITION BY node) AS BIGINT) AS total,
  CAST(sum(w) OVER (PARTITION BY node ORDER BY {_HASH.format('nbr')}, nbr ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM {name}_whole),
{name} AS (SELECT node, nbr, degree, {bound.format('upto - w')} AS lo, {bound.format('upto')} AS hi FROM {name}_sums)"""


def scaled_sql(draw: str, size: str) -> str:
    return f"CAST((CAST({draw} AS HUGEINT) * {size}) // {_FULL} AS BIGINT)"


_WEIGHTED = ranges_sql("ranged", "adj", "weight")


@query("alias_probabilities", f"WITH {PART_GRAPH}, {_WEIGHTED} SELECT node, nbr, {rounded(f'(hi - lo) / CAST({_FULL} AS DOUBLE)')} AS probability FROM ranged WHERE lo < hi")
def alias_probabilities(spark, sf_dir):
    return G.slot_probability(G.weighted_slots(part_adjacency(spark, sf_dir)))


@query(
    "weighted_slots",
    f"""WITH {PART_GRAPH}, {_WEIGHTED} SELECT r.node, s AS slot, lo, hi, nbr, r.degree, d.degree AS nbr_degree
FROM (SELECT node, nbr, degree, lo, hi, unnest(range({scaled_sql('lo', 'degree')}, {scaled_sql('(hi - 1)', 'degree')} + 1)) AS s FROM ranged WHERE lo < hi) r
JOIN deg d ON r.nbr = d.node""",
)
def weighted_slots(spark, sf_dir):
    return G.weighted_slots(part_adjacency(spark, sf_dir))


@query("node_neighbours", f"WITH {PART_GRAPH} SELECT nbr, {rounded('weight')} AS weight FROM adj WHERE node = 'tt__blue_bolt'")
def node_neighbours(spark, sf_dir):
    return G.neighbours(part_adjacency(spark, sf_dir), "tt__blue_bolt")


_HALVES = "half AS (SELECT count(*) // 2 AS n_items FROM part)"


@query(
    "intersecting_nodes",
    f"""WITH {PART_GRAPH}, {_HALVES}, shared AS (SELECT value FROM cells, half WHERE rid_no < n_items
  INTERSECT SELECT value FROM cells, half WHERE rid_no >= n_items)
SELECT node FROM nodes WHERE substr(node, instr(node, '__') + 2) IN (SELECT value FROM shared)""",
)
def intersecting_nodes(spark, sf_dir):
    halves = [C.cells(x, "p_partkey", list(GRAPH_COLS)) for x in part_halves(spark, sf_dir)]
    return S.intersecting_nodes(part_nodes(spark, sf_dir), S.shared_values(*halves))


@query("roots_fallback", f"WITH {PART_GRAPH} SELECT node FROM nodes WHERE split_part(node, '__', 1) IN ('tn', 'tt')")
def roots_fallback(spark, sf_dir):
    """Names of nations occur in no part, so all roots are taken."""
    nodes = part_nodes(spark, sf_dir)
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("value"))
    return W.roots_or_all(S.intersecting_nodes(nodes, names), G.roots(nodes))


@query(
    "graph_growth",
    f"""WITH {PART_GRAPH}, {_HALVES}, touched AS (SELECT DISTINCT unnest([src, dst]) AS whole FROM edges, half WHERE rid_no >= n_items),
names AS (SELECT DISTINCT unnest(CASE WHEN whole LIKE 'tt%' THEN list_append(list_transform(string_split(substr(whole, 5), '_'),
  lambda x: 'tt__' || x), whole) ELSE [whole] END) AS node FROM touched)
SELECT node, (SELECT max(rid_no) FROM cells) AS max_rid FROM names WHERE split_part(node, '__', 1) IN ('tn', 'tt')""",
)
def graph_growth(spark, sf_dir):
    a, b = [E.edge_list(C.cells(x, "p_partkey", list(GRAPH_COLS)), LOG) for x in part_halves(spark, sf_dir)]
    _, delta, max_rid = G.grow(a, b, TYPES, "tt")
    return delta.join(F.broadcast(max_rid), F.lit(True))  # one row


# --- walks ----------------------------------------------------------------------------------

HIDDEN = NodeTypes.parse(("3#__tn", "2$__tt", "5$__idx", "1$__cid"))


def _hash(*parts: str) -> str:
    return _HASH.format(" || '|' || ".join(parts)).replace("1, 8)", "1, 15)")


def walks_sql(graph: str, walks: str, length: int, weighted: bool = False, avoid: str = "", hidden: str = "") -> str:
    """Recursive SQL for the walks of the table expression ``walks`` (``walk_id, root``); ``avoid`` is not drawn."""
    draw = _hash(f"'{SEED}'", "s.walk_id", "s.step")
    start = _hash(f"'{SEED}'", "walk_id", "'start'", "'0'")
    appear = f"split_part(nbr, '__', 1) NOT IN ({hidden})" if hidden else "true"
    slot_table = "ranged" if weighted else "slots"
    slot_cte = _WEIGHTED if weighted else _SLOTS
    size, low, share = (str(_FULL), "e.lo", "(e.hi - e.lo)") if weighted else ("s.degree", "e.slot", "1")
    out = f"LEFT JOIN {slot_table} e ON e.node = s.cur AND e.nbr = {avoid}" if avoid else ""
    free = f"({size} - CASE WHEN e.nbr IS NULL THEN 0 ELSE {share} END)" if avoid else size
    skip = f"CASE WHEN k >= x_lo THEN x_share ELSE 0 END" if avoid else "0"
    pick = "d.place >= t.lo AND d.place < t.hi" if weighted else "t.slot = d.place"
    return f"""WITH RECURSIVE {graph}, {slot_cte},
{ranges_sql("bounds", "(SELECT * FROM adj WHERE split_part(nbr, '__', 1) = 'idx')", "n_edges")},
walks AS ({walks}),
started AS (SELECT walk_id, root, b.nbr AS first, d.degree FROM (SELECT *, {start} AS h FROM walks) w JOIN deg d ON w.root = d.node
  LEFT JOIN bounds b ON b.node = w.root AND h >= b.lo AND h < b.hi),
steps AS (
  SELECT walk_id, root AS cur, degree, CAST(NULL AS VARCHAR) AS prev, root AS last, CASE WHEN first IS NULL OR first = root THEN 1 ELSE 2 END AS n,
    1 AS step, CASE WHEN first IS NULL OR first = root THEN root ELSE first || ' ' || root END AS walk FROM started
  UNION ALL
  SELECT walk_id, nbr, nbr_degree, cur, CASE WHEN {appear} THEN nbr ELSE last END, n + CASE WHEN {appear} THEN 1 ELSE 0 END, step + 1,
    CASE WHEN {appear} THEN walk || ' ' || nbr ELSE walk END
  FROM (SELECT d.*, t.nbr, n.degree AS nbr_degree
    FROM (SELECT *, k + {skip} AS place FROM (SELECT s.*, {scaled_sql(draw, free)} AS k {f", {low} AS x_lo, {share} AS x_share" if avoid else ""}
      FROM steps s {out} WHERE n < {length} {f"AND {free} > 0" if avoid else ""}) s) d
    JOIN {slot_table} t ON t.node = d.cur AND {pick} JOIN deg n ON t.nbr = n.node) x)
SELECT walk_id, arg_max(walk, step) AS walk FROM steps GROUP BY walk_id"""


_SPREAD = "SELECT node || '#' || rep AS walk_id, node AS root FROM nodes, (SELECT unnest(range(1, 4)) AS rep) WHERE split_part(node, '__', 1) IN ('tn', 'tt')"


def _walks(spark, sf_dir, opts, types=TYPES, weighted=False, seeds=None):
    nodes = part_nodes(spark, sf_dir)
    tables = W.walk_tables(part_adjacency(spark, sf_dir), types, weighted)
    seeds = seeds(nodes) if seeds else W.spread_walks(G.roots(nodes), 3)
    return W.random_walks(seeds, tables, types, opts)


@query("walks_uniform", walks_sql(PART_GRAPH, _SPREAD, LENGTH))
def walks_uniform(spark, sf_dir):
    return _walks(spark, sf_dir, WalkOptions(sentence_length=LENGTH, seed=SEED))


@query("walks_weighted", walks_sql(PART_GRAPH, _SPREAD, LENGTH, weighted=True))
def walks_weighted(spark, sf_dir):
    return _walks(spark, sf_dir, WalkOptions(sentence_length=LENGTH, seed=SEED), weighted=True)


@query("walks_no_backtrack", walks_sql(PART_GRAPH, _SPREAD, LENGTH, avoid="CASE WHEN s.degree > 1 THEN s.prev END"))
def walks_no_backtrack(spark, sf_dir):
    return _walks(spark, sf_dir, WalkOptions(sentence_length=LENGTH, seed=SEED, backtrack="strict", steps_per_checkpoint=5))


@query("walks_hidden_nodes", walks_sql(PART_GRAPH, _SPREAD, LENGTH, avoid="s.last", hidden="'tt'"))
def walks_hidden_nodes(spark, sf_dir):
    opts = WalkOptions(sentence_length=LENGTH, seed=SEED, backtrack="reference", steps_per_checkpoint=8)
    return _walks(spark, sf_dir, opts, types=HIDDEN)


@query("walks_long", walks_sql(PART_GRAPH, _SPREAD, 14))
def walks_long(spark, sf_dir):
    return _walks(spark, sf_dir, WalkOptions(sentence_length=14, seed=SEED, steps_per_checkpoint=6))


_ROOTS = "rootlist AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS no, count(*) OVER () AS n FROM nodes WHERE split_part(node, '__', 1) IN ('tn', 'tt'))"
# as many sentences as the graph has nodes: some per root, the rest from random roots
_PLANNED = f"""WITH {_ROOTS}, total AS (SELECT count(*) AS k FROM nodes), per AS (SELECT k // n AS reps, k % n AS needed, n FROM total, (SELECT max(n) AS n FROM rootlist))
SELECT node || '#' || rep AS walk_id, node AS root FROM rootlist, (SELECT unnest(range(1, reps + 1)) AS rep FROM per)
UNION ALL SELECT walk_id, node FROM (SELECT 'extra#' || i AS walk_id, {scaled_sql(_hash("'42'", "'extra#' || i", "'extra'", "'0'"), "n")} AS pick
  FROM (SELECT unnest(range(1, needed + 1)) AS i, n FROM per)) e JOIN rootlist r ON r.no = e.pick"""


@query("walks_remainder", walks_sql(PART_GRAPH, _PLANNED, 3))
def walks_remainder(spark, sf_dir):
    def seeds(nodes):
        return W.planned_walks(G.roots(nodes), nodes.count(), SEED)

    return _walks(spark, sf_dir, WalkOptions(sentence_length=3, seed=SEED), seeds=seeds)


@query(
    "walks_both",
    f"""WITH w AS ({walks_sql(PART_GRAPH, _SPREAD, 4)}) SELECT walk_id, 0 AS way, walk FROM w
UNION ALL SELECT walk_id, 1, array_to_string(list_reverse(string_split(walk, ' ')), ' ') FROM w""",
)
def walks_both(spark, sf_dir):
    return W.both_walks(_walks(spark, sf_dir, WalkOptions(sentence_length=4, seed=SEED)))


_SHARED = """halves AS (SELECT count(*) // 2 AS n_items FROM part), shared AS (SELECT value FROM cells, halves WHERE rid_no < n_items
  INTERSECT SELECT value FROM cells, halves WHERE rid_no >= n_items)"""
_FROM_SHARED = """SELECT node || '#' || rep AS walk_id, node AS root FROM nodes, (SELECT unnest(range(1, 4)) AS rep)
WHERE substr(node, instr(node, '__') + 2) IN (SELECT value FROM shared)"""


@query("walks_intersecting", walks_sql(f"{PART_GRAPH}, {_SHARED}", _FROM_SHARED, LENGTH, weighted=True))
def walks_intersecting(spark, sf_dir):
    """Weighted walks that begin at the nodes of values which both halves of the table have."""
    halves = [C.cells(x, "p_partkey", list(GRAPH_COLS)) for x in part_halves(spark, sf_dir)]

    def seeds(nodes):
        return W.spread_walks(W.roots_or_all(S.intersecting_nodes(nodes, S.shared_values(*halves)), G.roots(nodes)), 3)

    return _walks(spark, sf_dir, WalkOptions(sentence_length=LENGTH, seed=SEED), weighted=True, seeds=seeds)


@query("walk_lines", f"WITH w AS ({walks_sql(PART_GRAPH, _SPREAD, 3)}) SELECT walk_id, walk AS sentence FROM w")
def walk_lines(spark, sf_dir):
    return W.sentences(_walks(spark, sf_dir, WalkOptions(sentence_length=3, seed=SEED)))


@query("walks_by_strategy", f"WITH {PART_GRAPH} SELECT 'basic' AS strategy, count(*) * 3 AS n_walks FROM nodes WHERE split_part(node, '__', 1) IN ('tn', 'tt')")
def walks_by_strategy(spark, sf_dir):
    return W.walks_by_strategy(_walks(spark, sf_dir, WalkOptions(sentence_length=3, seed=SEED)))


@query(
    "split_fractions",
    f"""SELECT c_custkey, {rounded('CASE WHEN c_nationkey = 0 AND c_custkey = 0 THEN 0 ELSE c_nationkey * 1.0 / (c_nationkey + c_custkey) END')} AS row_share,
{rounded('CASE WHEN c_nationkey = 0 AND c_custkey = 0 THEN 0 ELSE c_custkey * 1.0 / (c_nationkey + c_custkey) END')} AS col_share FROM customer""",
)
def split_fractions(spark, sf_dir):
    shares = W.split_fractions(F.col("c_nationkey"), F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", shares.alias("s")).select("c_custkey", "s.row_share", "s.col_share")


# --- similar tokens -------------------------------------------------------------------------

# a name is similar to its last word
_SIMILAR = """names AS (SELECT DISTINCT p_name FROM part),
sims AS (SELECT 'tt__' || replace(p_name, ' ', '_') AS a, 'tt__' || split_part(p_name, ' ', 2) AS b, CASE WHEN p_name < 'h' THEN 0.3 ELSE 0.05 END AS distance FROM names),
alike AS (SELECT node, nbr, sum(distance) AS weight FROM (SELECT a AS node, b AS nbr, distance FROM sims UNION ALL SELECT b, a, distance FROM sims) GROUP BY node, nbr),
totals AS (SELECT node, sum(weight) AS total FROM alike GROUP BY node)"""


def similar_names(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select(
        F.concat(F.lit("tt__"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("a"),
        F.concat(F.lit("tt__"), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("b"),
        F.when(F.col("p_name") < "h", 0.3).otherwise(0.05).alias("distance"),
    )


@query("similar_nodes", f"WITH {_SIMILAR} SELECT node, nbr, {rounded('weight')} AS weight FROM alike")
def similar_nodes(spark, sf_dir):
    return R.similar_nodes(similar_names(spark, sf_dir), part_nodes(spark, sf_dir))


@query(
    "replacement_probability",
    f"""WITH {_SIMILAR} SELECT s.node, nbr, {rounded('CASE WHEN total >= 1 THEN weight / total ELSE weight * total END * 0.5')} AS probability
FROM alike s JOIN totals t ON s.node = t.node
UNION ALL SELECT node, node, {rounded('1 - CASE WHEN total >= 1 THEN 0.5 ELSE total * total * 0.5 END')} FROM totals""",
)
def replacement_probability(spark, sf_dir):
    return R.replacement_probability(R.similar_nodes(similar_names(spark, sf_dir), part_nodes(spark, sf_dir)))


@query("walks_replaced")
def walks_replaced(spark, sf_dir):
    """Walks that write similar tokens, and near numbers, in place of those reached."""
    edges = part_edges(spark, sf_dir, ["p_name", "p_size"])
    nodes = G.node_catalog(edges, TYPES, "tt")
    adj = G.adjacency(G.flattened_edges(edges, TYPES, "tt"))
    similar = R.replacement_probability(R.similar_nodes(similar_names(spark, sf_dir), nodes))
    tables = W.walk_tables(adj, TYPES, numeric_nodes=nodes.filter("is_numeric"), similar=similar)
    opts = WalkOptions(sentence_length=LENGTH, seed=SEED, replace_strings=True, replace_numbers=True)
    return W.random_walks(W.spread_walks(G.roots(nodes), 3), tables, TYPES, opts)


# --- older graph ----------------------------------------------------------------------------

_TRI = f"""cells AS (SELECT rid_no, 'idx_' || rid_no AS rid, col, CASE WHEN col = 'p_name' THEN replace(value, '_', ' ') ELSE value END AS cell FROM ({PART_CELLS})),
freq AS (SELECT cell, CAST(count(*) AS DOUBLE) AS frequency FROM cells GROUP BY cell),
w AS (SELECT c.*, 0.8 * pow(pow(0.01 / 0.8, 1.0 / (1.0 - 200.0)), 1.0 - frequency) + 0.2 AS w FROM cells c JOIN freq f ON c.cell = f.cell),
tri AS (SELECT rid AS node, 'row' AS node_kind, cell AS nbr, 'cell' AS nbr_kind, w AS weight FROM w UNION SELECT cell, 'cell', rid, 'row', 1.0 FROM w
  UNION SELECT col, 'column', cell, 'cell', w FROM w UNION SELECT cell, 'cell', col, 'column', 1.0 FROM w)"""


def _tripartite(spark, sf_dir):
    return L.tripartite_graph(table(spark, sf_dir, "part"), "p_partkey", list(PART_COLS))


@query("tripartite_graph", f"WITH {_TRI} SELECT node, node_kind, nbr, nbr_kind, {rounded('weight')} AS weight FROM tri")
def tripartite_graph(spark, sf_dir):
    return _tripartite(spark, sf_dir)


@query(
    "left_right_step",
    f"""WITH {_TRI}, slots AS (SELECT node, nbr, row_number() OVER (PARTITION BY node ORDER BY {_HASH.format('nbr')}, nbr) - 1 AS slot, count(*) OVER (PARTITION BY node) AS degree
  FROM tri WHERE (node_kind = 'cell' AND nbr_kind = 'row') OR (node_kind = 'column' AND nbr_kind = 'cell'))
SELECT s.node AS walk_id, s.node, s.nbr FROM slots s WHERE slot = {scaled_sql(_hash("'42'", 's.node', "'left'", "'0'"), "degree")}""",
)
def left_right_step(spark, sf_dir):
    graph = _tripartite(spark, sf_dir)
    walkers = graph.select(F.col("node").alias("walk_id"), "node").distinct()
    return L.left_right_step(walkers, graph, "left", SEED)
