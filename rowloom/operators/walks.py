"""Random walks as joins: every step is one equi-join of walkers with a draw table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.hashing import TWO_60, hash32, hash60, normal, scaled
from rowloom.functions.text import node_name
from rowloom.operators.graph import first_bag, uniform_slots, weighted_slots
from rowloom.operators.numbering import GROUP_CHUNK, dense_index
from rowloom.options import NodeTypes, WalkOptions
from rowloom.session import freeze, large, shuffle_partitions

# |offset| of a numeric replacement: a Box-Muller number from 32-bit draws is below 6.7
_NEAR = 7
# steps per written node after which a walk among hidden nodes stops the job
_LONGEST = 1000


@dataclass(frozen=True)
class WalkTables:
    """Tables a walk needs: neighbour draws, start draws, and the degree of every node."""

    slots: DataFrame
    starts: DataFrame
    degree: DataFrame
    bag: DataFrame
    weighted: bool
    similar: DataFrame | None = None


def walk_tables(
    adj: DataFrame,
    types: NodeTypes,
    weighted: bool = False,
    chunk: int = GROUP_CHUNK,
    numeric_nodes: DataFrame | None = None,
    similar: DataFrame | None = None,
    keep: bool = True,
) -> WalkTables:
    """Draw tables of a graph, laid out once by (node, slot), so that no step shuffles them again."""
    if keep:
        adj = freeze(adj)
    slots = weighted_slots(adj, chunk) if weighted else uniform_slots(adj, chunk)
    degree = adj.filter(F.col("weight") > 0) if weighted else adj
    degree = degree.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    if numeric_nodes is not None:
        near = numeric_neighbourhood(numeric_nodes, degree).withColumnRenamed("node", "nbr")
        slots = slots.join(large(near), "nbr", "left")
    slots = slots.drop("degree")
    if keep:
        parts = shuffle_partitions(adj.sparkSession)
        slots = freeze(slots.repartition(parts, "node", "slot").sortWithinPartitions("node", "slot"))
    starts, bag = start_tables(first_bag(adj, types), chunk)
    if similar is not None:
        stays = weighted_slots(similar.select("node", "nbr", "probability"), chunk, weight="probability")
        other = degree.select(F.col("node").alias("nbr"), F.col("degree").alias("other_degree"))
        similar = (
            stays.drop("nbr_degree")
            .join(large(other), "nbr", "left")
            .select("node", "slot", "lo", "hi", F.col("nbr").alias("other"), "other_degree", F.col("degree").alias("similar_degree"))
        )
        if keep:
            parts = shuffle_partitions(adj.sparkSession)
            similar = freeze(similar.repartition(parts, "node", "slot").sortWithinPartitions("node", "slot"))
    return WalkTables(slots, starts, degree, bag, weighted, similar)


def start_tables(firsts: DataFrame, chunk: int = GROUP_CHUNK) -> tuple[DataFrame, DataFrame]:
    """Draws of the node that a walk begins with, and from how many of them each node chooses."""
    firsts = firsts.select("node", F.col("first").alias("nbr"), "copies")
    starts = weighted_slots(firsts, chunk, weight="copies", far=False).select("node", "slot", "lo", "hi", F.col("nbr").alias("first"))
    return starts, firsts.groupBy("node").agg(F.count(F.lit(1)).alias("bag_degree"))


def numeric_neighbourhood(numeric_nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """Per numeric node the offsets -7..7 at which another such node exists, with its degree."""
    values = numeric_nodes.select("node", node_name(F.col("node")).try_cast("bigint").alias("v")).filter("v is not null")
    by_value = values.join(large(degree), "node").select(F.col("v").alias("target"), "degree", F.col("node").alias("other"))
    wanted = values.select(
        "node", F.explode(F.array(*[F.lit(i) for i in range(-_NEAR, _NEAR + 1)])).alias("offset"), "v"
    ).withColumn("target", F.col("v") + F.col("offset"))
    found = wanted.join(large(by_value), "target")
    # at most 15 entries per node (one per offset and spelling)
    entries = F.collect_list(F.struct("offset", "other", "degree"))
    return found.groupBy("node").agg(F.array_sort(entries).alias("near"))


def spread_walks(root_nodes: DataFrame, walks_per_root: int) -> DataFrame:
    """``walk_id, root``: every root starts the same number of walks."""
    reps = F.explode(F.sequence(F.lit(1), F.lit(walks_per_root)))
    return root_nodes.select(F.col("node").alias("root"), reps.alias("rep")).select(
        F.concat_ws("#", "root", "rep").alias("walk_id"), "root", "rep"
    )


def remainder_walks(root_nodes: DataFrame, needed: int, seed: int) -> DataFrame:
    """``needed`` walks from roots drawn with replacement."""
    spark = root_nodes.sparkSession
    indexed = dense_index(root_nodes.select("node").distinct(), ["node"], "root_no")
    n_roots = indexed.agg(F.count(F.lit(1)).alias("n_roots"))
    walk_id = F.concat(F.lit("extra#"), F.col("id").cast("string"))
    draws = (
        spark.range(1, needed + 1)
        .select(walk_id.alias("walk_id"), F.col("id").cast("int").alias("rep"))
        .join(F.broadcast(n_roots), F.lit(True))
        .withColumn("root_no", scaled(hash60(seed, F.col("walk_id"), "extra", 0), F.col("n_roots")))
    )
    return draws.join(large(indexed), "root_no").select("walk_id", F.col("node").alias("root"), "rep")


def planned_walks(root_nodes: DataFrame, n_sentences: int, seed: int) -> DataFrame:
    """The same number of walks from every root, the remainder from random roots."""
    n_roots = root_nodes.count()
    if n_roots == 0:
        raise ValueError("no node may start a walk")
    per_root, needed = divmod(n_sentences, n_roots)
    parts = []
    if per_root:
        parts.append(spread_walks(root_nodes, per_root))
    if needed:
        parts.append(remainder_walks(root_nodes, needed, seed))
    return reduce(DataFrame.unionByName, parts)


def roots_or_all(chosen: DataFrame, all_roots: DataFrame) -> DataFrame:
    """The chosen nodes, or all roots when none was chosen."""
    none_chosen = chosen.agg((F.count(F.lit(1)) == 0).alias("none_chosen"))
    fallback = all_roots.join(F.broadcast(none_chosen), F.lit(True)).filter("none_chosen").select("node")
    return chosen.select("node").unionByName(fallback)


def _start(walks: DataFrame, tables: WalkTables, seed: int) -> DataFrame:
    """State of each walk before its first step; a first node is put in front where one is drawn."""
    per_root = walks.join(large(tables.degree.withColumnRenamed("node", "root")), "root").join(
        large(tables.bag.withColumnRenamed("node", "root")), "root", "left"
    )
    draw = hash60(seed, F.col("walk_id"), "start", 0)
    keyed = per_root.withColumn("_h", draw).withColumn(
        "_slot", F.coalesce(scaled(F.col("_h"), F.col("bag_degree")), F.lit(-1).cast("bigint"))
    )
    starts = tables.starts
    joined = keyed.join(
        large(starts),
        (keyed.root == starts.node) & (keyed._slot == starts.slot) & (keyed._h >= starts.lo) & (keyed._h < starts.hi),
        "left",
    )
    lone = F.col("first").isNull() | (F.col("first") == F.col("root"))
    return joined.select(
        "walk_id",
        F.col("root").alias("cur"),
        "degree",
        F.lit(None).cast("string").alias("prev"),
        F.col("root").alias("last"),
        F.when(lone, 1).otherwise(2).alias("n"),
        F.lit(1).alias("step"),
        F.when(lone, F.array("root")).otherwise(F.array("first", "root")).alias("seg"),
    )


def _number_replacement(seed: int) -> tuple[Column, Column]:
    """Replacement of a numeric node by a near one, or null: (node, degree)."""
    hits = []
    for attempt in range(3):
        draws = [hash32(seed, F.col("walk_id"), F.col("step"), f"n{attempt}{part}") for part in "ab"]
        offset = F.rint(normal(*draws)).cast("int")
        hits.append(F.get(F.filter("near", lambda e, o=offset: e["offset"] == o), F.lit(0)))
    hit = F.coalesce(*hits)
    return hit["other"], hit["degree"]


def _places(tables: WalkTables) -> DataFrame:
    """``node, nbr, x_lo, x_hi``: which draws of a node lead to a neighbour, laid out by the pair."""
    slots = tables.slots
    if tables.weighted:
        places = slots.select("node", "nbr", F.col("lo").alias("x_lo"), F.col("hi").alias("x_hi")).dropDuplicates(["node", "nbr"])
    else:
        places = slots.select("node", "nbr", F.col("slot").alias("x_lo"), (F.col("slot") + 1).alias("x_hi"))
    places = places.withColumnsRenamed({"node": "x_node", "nbr": "x_nbr"})
    parts = shuffle_partitions(slots.sparkSession)
    return freeze(places.repartition(parts, "x_node", "x_nbr").sortWithinPartitions("x_node", "x_nbr"))


def _drawn(state: DataFrame, tables: WalkTables, opts: WalkOptions, places: DataFrame | None) -> DataFrame:
    """``state`` with the neighbour drawn. One draw suffices, as the share of a neighbour that must not be
    drawn is taken out of the range first; ``nbr`` is null where no other neighbour is left."""
    # keys that cannot be null spare a second evaluation of the hash in a null filter
    never = F.lit(-1).cast("bigint")
    keyed = state.withColumn("_h", F.coalesce(hash60(opts.seed, F.col("walk_id"), F.col("step")), never))
    size = F.lit(TWO_60) if tables.weighted else F.col("degree")
    if places is None:
        keyed = keyed if tables.weighted else keyed.withColumn("_h", scaled(F.col("_h"), size))
        keyed = keyed.withColumn("_ends", F.lit(False))
    else:
        avoided = F.when(F.col("degree") > 1, F.col("prev")) if opts.redraw == "strict" else F.col("last")
        keyed = keyed.withColumn("_x", avoided).join(large(places), (F.col("cur") == F.col("x_node")) & (F.col("_x") == F.col("x_nbr")), "left")
        share = F.coalesce(F.col("x_hi") - F.col("x_lo"), F.lit(0))
        place = scaled(F.col("_h"), size - share)
        place = place + F.when(place >= F.col("x_lo"), share).otherwise(0)
        keyed = keyed.withColumn("_ends", F.coalesce(share == size, F.lit(False))).withColumn("_h", F.when(~F.col("_ends"), place))
        keyed = keyed.drop("x_node", "x_nbr", "x_lo", "x_hi")
    slot = scaled(F.col("_h"), F.col("degree")) if tables.weighted else F.col("_h")
    keyed = keyed.withColumn("_slot", F.coalesce(slot, never))
    slots = tables.slots
    on = (keyed.cur == slots.node) & (keyed._slot == slots.slot)
    if tables.weighted:
        on = on & (keyed._h >= slots.lo) & (keyed._h < slots.hi)
    # a walker that finds no neighbour stops the job, so that no walk is lost in silence
    lost = F.raise_error(F.concat(F.lit("walk at a node without neighbours: "), F.col("cur")))
    return keyed.join(large(slots), on, "left").withColumn("nbr", F.coalesce("nbr", F.when(~F.col("_ends"), lost)))


def _step(state: DataFrame, tables: WalkTables, types: NodeTypes, opts: WalkOptions, places: DataFrame | None) -> DataFrame:
    drawn = _drawn(state, tables, opts, places)
    if opts.replace_numbers:
        other, other_degree = _number_replacement(opts.seed)
        drawn = drawn.withColumn("_other", other).withColumn("_other_degree", other_degree)
        if places is not None:  # what must not be drawn replaces nothing either
            other = F.when(F.coalesce(F.col("_other") != F.col("_x"), F.lit(True)), F.col("_other"))
            drawn = drawn.withColumn("_other", other).withColumn("_other_degree", F.when(F.col("_other").isNotNull(), F.col("_other_degree")))
        drawn = drawn.withColumn("nbr_degree", F.coalesce("_other_degree", "nbr_degree")).withColumn("nbr", F.coalesce("_other", "nbr"))
    drawn = drawn.withColumn("written", F.col("nbr")).select(
        *state.columns, "nbr", "nbr_degree", "written"
    )
    if opts.replace_strings and tables.similar is not None:
        drawn = _replace_strings(drawn, tables, opts)

    active = F.col("n") < opts.sentence_length
    target, target_degree = F.col("nbr"), F.col("nbr_degree")
    if opts.replace_strings and tables.similar is not None and opts.follow_replacement:
        target, target_degree = F.col("written"), F.coalesce("other_degree", "nbr_degree")
    moves = active & F.col("nbr").isNotNull()
    writes = moves & types.flag(target, "is_appear")
    # a walk whose node has no neighbour but the one to avoid ends here
    ended = active & F.col("nbr").isNull()
    return drawn.select(
        "walk_id",
        F.when(moves, target).otherwise(F.col("cur")).alias("cur"),
        F.when(moves, target_degree).otherwise(F.col("degree")).alias("degree"),
        F.when(moves, F.col("cur")).otherwise(F.col("prev")).alias("prev"),
        F.when(writes, F.col("written")).otherwise(F.col("last")).alias("last"),
        F.when(ended, opts.sentence_length).otherwise(F.col("n") + writes.cast("int")).alias("n"),
        (F.col("step") + moves.cast("int")).alias("step"),
        F.when(writes, F.array_append("seg", F.col("written"))).otherwise(F.col("seg")).alias("seg"),
    )


def _replace_strings(drawn: DataFrame, tables: WalkTables, opts: WalkOptions) -> DataFrame:
    """Draw the token written in place of the node reached; the node itself where none is similar."""
    # every node has its slot 0, once per neighbour that reaches into it
    sizes = tables.similar.filter("slot = 0 and lo = 0").select(F.col("node").alias("nbr"), "similar_degree")
    draw = hash60(opts.seed, F.col("walk_id"), F.col("step"), "s")
    keyed = drawn.join(large(sizes), "nbr", "left").withColumn("_h", draw).withColumn(
        "_slot", F.coalesce(scaled(F.col("_h"), F.col("similar_degree")), F.lit(-1).cast("bigint"))
    )
    similar = tables.similar.drop("similar_degree")
    joined = keyed.join(
        large(similar),
        (keyed.nbr == similar.node) & (keyed._slot == similar.slot) & (keyed._h >= similar.lo) & (keyed._h < similar.hi),
        "left",
    )
    return joined.withColumn("written", F.coalesce("other", "written")).select(*drawn.columns, "other_degree")


def random_walks(walks: DataFrame, tables: WalkTables, types: NodeTypes, opts: WalkOptions) -> DataFrame:
    """``walk_id, walk``: one walk per row of ``walks`` (``walk_id, root``).

    Walkers carry only the nodes of the current segment. After every ``steps_per_checkpoint`` steps
    the segment is set aside, finished walks leave, and the lineage is cut; the segments are put
    together by one shuffle at the end.
    """
    length = opts.sentence_length
    state = _start(walks.select("walk_id", "root"), tables, opts.seed)
    all_written = all(t.is_appear for t in types.types)
    replaced = opts.replace_numbers or opts.replace_strings
    # where every node is written as it is, the node written last is the one the walk stands at
    avoids = opts.redraw == "strict" or (opts.redraw == "reference" and (replaced or not all_written))
    places = _places(tables) if avoids else None
    if all_written and length - 1 <= opts.steps_per_checkpoint:
        for _ in range(length - 1):
            state = _step(state, tables, types, opts, places)
        return state.select("walk_id", F.col("seg").alias("walk"))

    segments, done, number = [], 0, 0
    state = freeze(state)
    while True:
        segments.append(state.select("walk_id", F.lit(number).alias("number"), "seg").filter(F.size("seg") > 0))
        open_walks = state.filter(F.col("n") < length)
        shortest = open_walks.agg(F.min("n")).first()[0]
        if shortest is None:
            break
        if done > _LONGEST * length:
            raise RuntimeError(f"a walk at {open_walks.first().cur} meets no node that is written")
        steps = min(opts.steps_per_checkpoint, (length - shortest) * (1 if all_written else 2))
        state = open_walks.withColumn("seg", F.array().cast("array<string>"))
        for _ in range(steps):
            state = _step(state, tables, types, opts, places)
        state = freeze(state)
        done += steps
        number += 1
    pieces = reduce(DataFrame.unionByName, segments)
    # a walk writes something in each piece, so it has at most sentence_length + 1 of them
    ordered = F.array_sort(F.collect_list(F.struct("number", "seg")))
    return pieces.groupBy("walk_id").agg(F.flatten(F.transform(ordered, lambda p: p["seg"])).alias("walk"))


def reversed_walks(walks: DataFrame) -> DataFrame:
    return walks.withColumn("walk", F.reverse("walk"))


def both_walks(walks: DataFrame) -> DataFrame:
    both = F.posexplode(F.array(F.col("walk"), F.reverse("walk"))).alias("way", "walk")
    return walks.select("walk_id", both)


def walks_by_strategy(walks: DataFrame, strategy: str = "basic") -> DataFrame:
    return walks.groupBy(F.lit(strategy).alias("strategy")).agg(F.count(F.lit(1)).alias("n_walks"))


def split_fractions(freq_row: Column, freq_col: Column) -> Column:
    """Shares of row and column walks; both 0 when neither is wanted."""
    total = freq_row + freq_col
    return F.struct(
        F.when(total == 0, 0.0).otherwise(freq_row / F.when(total == 0, 1).otherwise(total)).alias("row_share"),
        F.when(total == 0, 0.0).otherwise(freq_col / F.when(total == 0, 1).otherwise(total)).alias("col_share"),
    )


def sentences(walks: DataFrame) -> DataFrame:
    """Walks as lines of text."""
    return walks.select("walk_id", F.array_join("walk", " ").alias("sentence"))
