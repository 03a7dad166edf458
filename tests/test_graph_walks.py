from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rowloom.functions.hashing import TWO_60, scaled
from rowloom.functions.smoothing import Smoothing
from rowloom.operators import cells as C
from rowloom.operators import edges as E
from rowloom.operators import graph as G
from rowloom.operators import similar as R
from rowloom.operators import walks as W
from rowloom.operators.graph_store import GraphStore
from rowloom.options import NodeTypes, WalkOptions

TYPES = NodeTypes.parse()
SEQ = "edge_seq struct<rid: bigint, col: int, pos: int, sub: int, side: int>, src string, dst string, w_fwd double, w_back double"


def edges_of(spark, *edges):
    return spark.createDataFrame([((i, 0, 0, 0, 0), *(e + (None,) * (4 - len(e)))) for i, e in enumerate(edges)], SEQ)


@pytest.fixture(scope="module")
def table_graph(spark):
    names = ["foo_bar"] * 3 + ["foo_baz"]
    df = spark.createDataFrame([(i, n, i % 2) for i, n in enumerate(names)], "k long, c string, n int")
    edges = E.edge_list(C.cells(df, "k"), Smoothing.parse("log"))
    nodes = G.node_catalog(edges, TYPES, "tt")
    adj = G.adjacency(G.flattened_edges(edges, TYPES, "tt"))
    return edges, nodes, adj


def test_node_types():
    assert [t.text() for t in TYPES.types] == ["3#__tn", "3$__tt", "5$__idx", "1$__cid"]
    for bad in (["9$__x"], ["3?__x"], ["2$__x"], ["nonsense"]):
        with pytest.raises(ValueError):
            NodeTypes.parse(bad)
    with pytest.raises(ValueError):
        TYPES.flattened("tt,zz")


def test_unknown_prefix_stops(spark):
    edges = edges_of(spark, ("zz__a", "idx__0", 1.0, 1.0))
    with pytest.raises(Exception, match="known prefix"):
        G.flattened_edges(edges, TYPES).collect()


def test_shared_token_has_unequal_weights(table_graph):
    _, _, adj = table_graph
    weights = {r.weight for r in adj.filter("node = 'tt__foo' and nbr like 'idx%'").collect()}
    assert len(weights) == 2


def test_last_weight_wins_and_copies_count(spark, rows):
    edges = edges_of(spark, ("tt__a", "idx__0", 1.0, 0.5), ("idx__0", "tt__a", 0.25, 0.75))
    adj = G.adjacency(G.flattened_edges(edges, TYPES))
    assert rows(adj) == [("idx__0", "tt__a", 0.25, 2), ("tt__a", "idx__0", 0.75, 2)]
    assert rows(G.first_bag(adj, TYPES)) == [("tt__a", "idx__0", 2)]


def test_edge_arity(spark, rows):
    edges = edges_of(spark, ("tt__a", "idx__0"), ("tt__b", "idx__1", 0.5))
    assert rows(G.adjacency(G.flattened_edges(edges, TYPES)).select("node", "nbr", "weight")) == [
        ("idx__0", "tt__a", 1.0), ("tt__a", "idx__0", 1.0), ("tt__b", "idx__1", 0.5)]
    both = G.adjacency(G.flattened_edges(edges, TYPES, directed_back_edge=True))
    assert ("idx__1", "tt__b", 0.5) in rows(both.select("node", "nbr", "weight"))
    assert not G.is_uniform(edges).first()[0]
    with pytest.raises(ValueError, match="idx__1"):
        G.require_connected(G.node_catalog(edges, TYPES), G.adjacency(G.flattened_edges(edges, TYPES)))


@pytest.mark.parametrize("chunk", [2, 100000])
def test_weighted_slots_give_probabilities(table_graph, chunk):
    _, _, adj = table_graph
    want = {(r.node, r.nbr): r.probability for r in G.transition_probability(adj).collect()}
    slots = G.weighted_slots(adj, chunk=chunk)
    got = {(r.node, r.nbr): r.probability for r in G.slot_probability(slots).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-8 for k in want)
    # every draw hits exactly one row
    cover = defaultdict(int)
    for r in slots.select("node", "lo", "hi").distinct().collect():
        cover[r.node] += r.hi - r.lo
    assert set(cover.values()) == {2**60}


def check_walks(walks, adj, length, hidden=()):
    links = {(r.node, r.nbr) for r in adj.collect()}
    for r in walks.collect():
        assert len(r.walk) == length
        if not hidden:
            assert all(pair in links for pair in zip(r.walk, r.walk[1:]))


@pytest.mark.parametrize("weighted", [False, True])
def test_walks_follow_edges(table_graph, weighted):
    _, nodes, adj = table_graph
    tables = W.walk_tables(adj, TYPES, weighted)
    seeds = W.spread_walks(G.roots(nodes), 4)
    walks = W.random_walks(seeds, tables, TYPES, WalkOptions(sentence_length=12, steps_per_checkpoint=5))
    check_walks(walks, adj, 12)
    assert walks.count() == 4 * G.roots(nodes).count()
    again = W.random_walks(seeds, tables, TYPES, WalkOptions(sentence_length=12, steps_per_checkpoint=11))
    assert {tuple(r.walk) for r in walks.collect()} == {tuple(r.walk) for r in again.collect()}


def test_weighted_draws_follow_weights(spark):
    edges = edges_of(spark, ("tt__a", "idx__0", 0.9, 1.0), ("tt__a", "idx__1", 0.1, 1.0))
    adj = G.adjacency(G.flattened_edges(edges, TYPES))
    seeds = spark.range(2000).select(F.col("id").cast("string").alias("walk_id"), F.lit("tt__a").alias("root"))
    walks = W.random_walks(seeds, W.walk_tables(adj, TYPES, True), TYPES, WalkOptions(sentence_length=3))
    third = Counter(r.walk[2] for r in walks.collect())
    assert 0.86 < third["idx__0"] / 2000 < 0.94
    first = Counter(r.walk[0] for r in walks.collect())
    assert 0.45 < first["idx__0"] / 2000 < 0.55


def test_strict_walks_do_not_return(table_graph):
    _, nodes, adj = table_graph
    walks = W.random_walks(
        W.spread_walks(G.roots(nodes), 3), W.walk_tables(adj, TYPES), TYPES, WalkOptions(sentence_length=12, backtrack="strict")
    )
    degree = {r.node: r.degree for r in G.degrees(adj).collect()}
    for r in walks.collect():
        tail = r.walk[1:]
        assert all(a != c or degree[b] == 1 for a, b, c in zip(tail, tail[1:], tail[2:]))


def test_hidden_nodes_are_crossed_not_written(table_graph):
    _, nodes, adj = table_graph
    types = NodeTypes.parse(("3#__tn", "2$__tt", "5$__idx", "1$__cid"))
    opts = WalkOptions(sentence_length=8, backtrack=False, steps_per_checkpoint=7)
    walks = W.random_walks(W.spread_walks(G.roots(nodes), 2), W.walk_tables(adj, TYPES), types, opts)
    for r in walks.collect():
        assert not [w for w in r.walk[2:] if w.startswith("tt__")]
        assert all(a != b for a, b in zip(r.walk[1:], r.walk[2:]))


def test_endless_walk_ends(spark):
    types = NodeTypes.parse(("2$__tt", "5$__idx"))
    adj = G.adjacency(G.flattened_edges(edges_of(spark, ("tt__a", "idx__0")), types))
    opts = WalkOptions(sentence_length=5, backtrack=False)
    walks = W.random_walks(W.spread_walks(spark.createDataFrame([("tt__a",)], "node string"), 1), W.walk_tables(adj, TYPES), types, opts)
    assert walks.first().walk == ["idx__0", "tt__a", "idx__0"]


def test_planned_walks_meet_the_budget(spark, table_graph):
    _, nodes, _ = table_graph
    roots = G.roots(nodes)
    n = roots.count()
    planned = W.planned_walks(roots, 2 * n + 3, 1)
    assert planned.count() == 2 * n + 3
    assert planned.select("walk_id").distinct().count() == 2 * n + 3


def test_replacement(spark):
    sims = spark.createDataFrame([("tt__a", "tt__b", 0.6), ("tt__a", "tt__c", 0.6), ("tt__b", "zz", 1.0)], "a string, b string, distance double")
    nodes = spark.createDataFrame([("tt__a",), ("tt__b",), ("tt__c",)], "node string")
    p = {(r.node, r.nbr): round(r.probability, 6) for r in R.replacement_probability(R.similar_nodes(sims, nodes)).collect()}
    assert p == {("tt__a", "tt__a"): 0.5, ("tt__a", "tt__b"): 0.25, ("tt__a", "tt__c"): 0.25,
                 ("tt__b", "tt__b"): 0.82, ("tt__b", "tt__a"): 0.18, ("tt__c", "tt__c"): 0.82, ("tt__c", "tt__a"): 0.18}


@pytest.mark.parametrize("follow", [False, True])
def test_replaced_walks(spark, follow):
    df = spark.createDataFrame([(i, f"v{i % 5}", 10 + i % 4) for i in range(40)], "k long, c string, n int")
    edges = E.edge_list(C.cells(df, "k"))
    nodes, adj = G.node_catalog(edges, TYPES), G.adjacency(G.flattened_edges(edges, TYPES))
    sims = spark.createDataFrame([("tt__v0", "tt__v1", 1.0), ("tt__v2", "tt__v3", 1.0)], "a string, b string, distance double")
    similar = R.replacement_probability(R.similar_nodes(sims, nodes))
    tables = W.walk_tables(adj, TYPES, numeric_nodes=nodes.filter("is_numeric"), similar=similar)
    opts = WalkOptions(sentence_length=10, replace_strings=True, replace_numbers=True, follow_replacement=follow)
    walks = W.random_walks(W.spread_walks(G.roots(nodes), 20), tables, TYPES, opts).collect()
    assert all(len(r.walk) == 10 for r in walks)
    known = {r.node for r in nodes.collect()}
    assert all(w in known for r in walks for w in r.walk)
    links = {(r.node, r.nbr) for r in adj.collect()}
    swapped = sum((a, b) not in links for r in walks for a, b in zip(r.walk, r.walk[1:]))
    assert swapped > 0


def test_no_walk_is_lost_to_tiny_or_huge_weights(spark):
    adj = spark.createDataFrame(
        [("tt__a", "tt__b", 1e-13, 1), ("tt__b", "tt__a", 1e12, 1), ("tt__a", "tt__c", 1.0, 1), ("tt__c", "tt__a", 2e8, 1), ("tt__b", "tt__d", 1e-13, 1),
         ("tt__d", "tt__b", 1e-13, 1)],
        "node string, nbr string, weight double, n_edges bigint")
    tables = W.walk_tables(adj, TYPES, weighted=True)
    seeds = W.spread_walks(adj.select("node").distinct(), 50)
    walks = W.random_walks(seeds, tables, TYPES, WalkOptions(sentence_length=5)).collect()
    assert len(walks) == 200 and all(len(r.walk) == 5 for r in walks)


def test_a_walk_into_a_dead_end_stops_the_job(spark):
    adj = spark.createDataFrame([("tt__a", "tt__b", 1.0, 1)], "node string, nbr string, weight double, n_edges bigint")
    seeds = W.spread_walks(adj.select("node"), 1)
    with pytest.raises(Exception, match="without neighbours"):
        W.random_walks(seeds, W.walk_tables(adj, TYPES), TYPES, WalkOptions(sentence_length=4)).collect()


def test_wide_draws(spark):
    pairs = [(0, 5), (TWO_60 - 1, 1), (TWO_60 - 1, TWO_60), (TWO_60 - 1, 3_000_000_001), (123456789 << 30, 7 << 33), (1 << 59, 2), (987654321987654321, 1 << 60)]
    got = spark.createDataFrame(pairs, "h long, n long").select("h", "n", scaled(F.col("h"), F.col("n")).alias("s")).collect()
    assert all(r.s == r.h * r.n >> 60 for r in got)


def test_a_tiny_share_keeps_its_draws(spark):
    adj = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.0**-40), ("a", "d", 3e-300)], "node string, nbr string, weight double")
    shares = {r.nbr: r.probability for r in G.slot_probability(G.weighted_slots(adj)).collect()}
    assert abs(shares["c"] * 2**40 - 1) < 1e-3 and 0 < shares["d"] < 2**-50


@pytest.mark.parametrize("weighted", [False, True])
def test_the_node_come_from_is_never_drawn(spark, weighted):
    """The other neighbours keep their shares, and one draw is enough."""
    links = [("tt__hub", f"tt__n{i}", w) for i, w in enumerate((1000.0, 1.0, 2.0, 3.0))] + [(f"tt__n{i}", "tt__hub", 1.0) for i in range(4)]
    adj = spark.createDataFrame([(a, b, w, 1) for a, b, w in links], "node string, nbr string, weight double, n_edges long")
    types = NodeTypes.parse(("3$__tt",))
    start = spark.range(3000).select(F.lit("tt__n0").alias("root"), F.col("id").cast("string").alias("walk_id"))
    walks = W.random_walks(start, W.walk_tables(adj, types, weighted), types, WalkOptions(sentence_length=4, backtrack="strict")).collect()
    assert all(r.walk[:2] + r.walk[3:] == ["tt__n0", "tt__hub", "tt__hub"] for r in walks)
    shares = Counter(r.walk[2][4:] for r in walks)
    want = {"n1": 1 / 6, "n2": 2 / 6, "n3": 3 / 6} if weighted else {f"n{i}": 1 / 3 for i in (1, 2, 3)}
    assert set(shares) == set(want) and all(abs(shares[n] / 3000 - p) < 0.05 for n, p in want.items())


def grown(spark, path, batches, **options):
    store = GraphStore(spark, path, TYPES, **options)
    for version, edges in batches:
        store.add(edges, version)
    return store


@pytest.mark.parametrize("smoothing,merge_every", [("log", 2), ("no", 8)])
def test_a_stored_graph_equals_one_made_at_once(spark, tmp_path, rows, smoothing, merge_every):
    """Windows overlap, a version is added twice, and merged versions are forgotten."""
    rid = [(w, w * 6 + i, f"name{(w * 6 + i) % 4} x{(w * 6 + i) % 3}", "blue") for w in range(5) for i in range(9)]
    records = spark.createDataFrame(rid, "window long, rid_no long, name string, colour string").withColumn("rid", F.concat(F.lit("idx__"), "rid_no"))
    edges = E.edge_list(C.cells(records, cols=["name", "colour"], carry=("window",)), Smoothing.parse(smoothing), window="window")
    batches = [(2 * w, edges.filter(F.col("edge_seq.window") == w)) for w in range(5)]
    store = grown(spark, str(tmp_path), [*batches[:3], batches[2], *batches[3:]], merge_every=merge_every)
    place = [F.col(f"edge_seq.{f}").alias(f) for f in ("rid", "col", "pos", "sub", "side")]
    last = edges.select("*", *place).groupBy("rid", "col", "pos", "sub", "side", "src", "dst").agg(F.max_by(F.struct("edge_seq", "w_fwd", "w_back"), "edge_seq").alias("e"))
    adj = G.adjacency(G.flattened_edges(last.select("e.edge_seq", "src", "dst", "e.w_fwd", "e.w_back"), TYPES, "tt"))
    names = ["node", "nbr", "weight", "n_edges"]
    assert rows(store.adjacency().select(names)) == rows(adj.select(names))
    weighted = smoothing != "no"
    roots = G.roots(G.node_catalog(edges, TYPES, "tt"))
    got, want = store.walk_tables(roots), W.walk_tables(adj, TYPES, weighted)
    assert got.weighted == weighted
    assert rows(got.slots.select(want.slots.columns)) == rows(want.slots)
    assert rows(got.degree.select("node", "degree")) == rows(want.degree)
    assert rows(got.bag) == rows(want.bag.join(roots, "node", "left_semi"))
    assert len(list((tmp_path / "pairs").iterdir())) <= (5 if merge_every > 5 else 2 * merge_every + 1)


def test_draws_turn_to_weights_when_they_first_differ(spark, tmp_path, rows):
    def batch(window, weight):
        seq = lambda side: F.struct(F.lit(window).alias("window"), F.lit(window).cast("long").alias("rid"), F.lit(0).alias("col"),
                                    F.lit(0).alias("pos"), F.lit(0).alias("sub"), F.lit(side).alias("side")).alias("edge_seq")
        return spark.createDataFrame([(f"idx__{window}", "tt__a", 1.0, weight)], "src string, dst string, w_fwd double, w_back double").select(seq(0), "*")

    store = grown(spark, str(tmp_path), [(0, batch(0, 1.0)), (1, batch(1, 1.0))])
    tables = store.walk_tables(store.degrees())
    assert not tables.weighted and "lo" not in tables.slots.columns
    store.add(batch(2, 0.25), 2)
    tables = store.walk_tables(store.degrees())
    assert tables.weighted and rows(tables.slots) == rows(W.walk_tables(store.adjacency(), TYPES, True).slots.select(tables.slots.columns))
