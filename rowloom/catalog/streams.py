"""Queries on windows, running streams, and files written and read back."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F

from rowloom.catalog.base import GRAPH_COLS, GRAPH_EDGES, PART_GRAPH, cells_sql, graph_sql, query, rounded, table
from rowloom.catalog.graphs import LENGTH, _SPREAD, part_adjacency, part_nodes, walks_sql
from rowloom.catalog.matching import _MERGED, record_table, scored_pairs
from rowloom.catalog.tables import TYPES, part_edges
from rowloom.functions.smoothing import Smoothing
from rowloom.functions.times import epoch_micros, epoch_seconds
from rowloom.operators import cells as C
from rowloom.operators import edges as E
from rowloom.operators import graph as G
from rowloom.operators import match as M
from rowloom.operators import walks as W
from rowloom.operators.graph_store import GraphStore
from rowloom.options import StreamOptions, TrainOptions, WalkOptions
from rowloom.plans.stream import start
from rowloom.session import ensure_checkpoint_dir, freeze
from rowloom.sources import readers, writers
from rowloom.streaming.buffer import WindowBuffer
from rowloom.streaming.metrics import StreamMetrics
from rowloom.streaming.windows import count_windows, idle_sessions, time_windows


def scratch(spark) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"


def numbered_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return C.row_ids(events, order=["ts", "event_id"]).withColumnRenamed("rid_no", "seq")


_SUMMARY = "count(*) AS n_rows, min(seq) AS first_seq, max(seq) AS last_seq"
_SEQ = "e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq FROM events)"


def _per_window(df):
    return df.groupBy("window").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum("value").alias("total")
    )


def _window_sql(size: int, slide: int, rest: bool = False) -> str:
    full = f"(SELECT (max(seq) + 1 - {size}) // {slide} FROM e)" + (" + 1" if rest else "")
    return f"""WITH {_SEQ}, w AS (SELECT e.*, unnest(range(greatest(0, CAST(ceil((seq - {size - 1}) / {slide}.0) AS BIGINT)), seq // {slide} + 1)) AS "window" FROM e)
SELECT "window", {_SUMMARY}, {rounded('sum(value)')} AS total FROM w WHERE "window" <= {full} GROUP BY "window\""""


@query("count_tumbling", _window_sql(131, 131))
def count_tumbling(spark, sf_dir):
    return _per_window(count_windows(numbered_events(spark, sf_dir), 131))


@query("count_sliding", _window_sql(131, 50))
def count_sliding(spark, sf_dir):
    return _per_window(count_windows(numbered_events(spark, sf_dir), 131, 50))


@query("count_with_rest", _window_sql(131, 131, rest=True))
def count_with_rest(spark, sf_dir):
    return _per_window(count_windows(numbered_events(spark, sf_dir), 131, keep_rest=True))


_TIME = """w AS (SELECT *, unnest(range(CAST(floor((epoch_us(ts) / 1000000.0 - {size}) / {slide}) AS BIGINT) + 1, CAST(floor(epoch_us(ts) / 1000000.0 / {slide}) AS BIGINT) + 1)) AS k FROM events)"""


@query("time_sliding", f"WITH {_TIME.format(size=3600, slide=900)} SELECT k * 900 AS start_second, count(*) AS n_rows, {rounded('sum(value)')} AS total FROM w GROUP BY k")
def time_sliding(spark, sf_dir):
    windows = time_windows(table(spark, sf_dir, "events"), "ts", 3600, 900)
    return windows.groupBy(epoch_seconds(windows, "window_start").alias("start_second")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("total")
    )


@query("time_tumbling", f"WITH {_TIME.format(size=3600, slide=3600)} SELECT k * 3600 AS start_second, count(*) AS n_rows FROM w GROUP BY k")
def time_tumbling(spark, sf_dir):
    windows = time_windows(table(spark, sf_dir, "events"), "ts", 3600)
    return windows.groupBy(epoch_seconds(windows, "window_start").alias("start_second")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "idle_sessions",
    """WITH g AS (SELECT epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id) < 600000000 THEN 0 ELSE 1 END AS starts, ts, event_id FROM events),
s AS (SELECT t, sum(starts) OVER (ORDER BY ts, event_id) - 1 AS session FROM g)
SELECT CAST(session AS BIGINT) AS session, min(t) AS first_us, max(t) AS last_us, count(*) AS n_rows FROM s GROUP BY session""",
)
def idle_sessions_query(spark, sf_dir):
    found = idle_sessions(table(spark, sf_dir, "events"), "ts", 600)
    return found.select("session", epoch_micros(found, "session_start").alias("first_us"), epoch_micros(found, "session_end").alias("last_us"), "n_rows")


@query("record_ids", f"WITH {_SEQ} SELECT event_id, 'idx__' || seq AS rid FROM e")
def record_ids(spark, sf_dir):
    """Ids that go on from the last one when a second batch arrives."""
    events = table(spark, sf_dir, "events")
    cut = events.agg(F.percentile_approx("ts", 0.5).alias("t")).first().t
    early, late = events.filter(F.col("ts") < F.lit(cut)), events.filter(F.col("ts") >= F.lit(cut))
    first = C.row_ids(early, order=["ts", "event_id"])
    start = early.count()
    return first.unionByName(C.row_ids(late, order=["ts", "event_id"], start=start)).select("event_id", "rid")


@query(
    "stream_edges",
    f"""WITH {_SEQ}, cells AS (SELECT seq // 1000 AS win, seq, 0 AS col_no, 'event_type' AS col, event_type AS value, 'tt__' AS p FROM e
  UNION ALL SELECT seq // 1000, seq, 1, 'user_id', CAST(user_id AS VARCHAR), 'tn__' FROM e),
complete AS (SELECT * FROM cells WHERE win <= (SELECT (max(seq) + 1 - 1000) // 1000 FROM e)),
freq AS (SELECT win, value, count(*) AS f FROM complete GROUP BY win, value),
w AS (SELECT c.*, 1.0 / f AS w FROM complete c JOIN freq q ON c.win = q.win AND c.value = q.value)
SELECT win, 'idx__' || seq AS src, p || value AS dst, 1.0 AS w_fwd, {rounded('w')} AS w_back FROM w
UNION ALL SELECT win, p || value, 'cid__' || col, {rounded('w')}, 1.0 FROM w""",
)
def stream_edges(spark, sf_dir):
    """Edges of tumbling windows, with frequencies per window."""
    events = C.row_ids(table(spark, sf_dir, "events").select("ts", "event_id", "event_type", "user_id"), order=["ts", "event_id"])
    windows = count_windows(events.withColumn("seq", F.col("rid_no")), 1000)
    table_ = C.cells(windows, cols=["event_type", "user_id"], carry=("window",))
    edges = E.edge_list(table_, Smoothing.parse("inverse"), window="window")
    return edges.select(F.col("edge_seq.window").alias("win"), "src", "dst", "w_fwd", "w_back")


# --- running streams ------------------------------------------------------------------------


def _run(source, schema, path, buffer, spark, listener=None):
    if listener is not None:
        spark.streams.addListener(listener)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    running = (
        stream.writeStream.foreachBatch(buffer).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    if listener is not None:
        # events reach the listener a moment after the batch ends
        expected = sum(p["numInputRows"] for p in running.recentProgress)
        deadline = time.time() + 20
        while listener.log.consumed < expected and time.time() < deadline:
            time.sleep(0.1)
        spark.streams.removeListener(listener)


def _in_files(df, path, n, key):
    """The table as n files, written one after the other in order of ``key``."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    step = (high - low + n) // n
    for start in range(low, high + 1, step):
        piece = df.filter((F.col(key) >= start) & (F.col(key) < start + step))
        piece.coalesce(1).write.mode("append").parquet(path)


@query("stream_windows", _window_sql(200, 60, rest=True))
def stream_windows(spark, sf_dir):
    """The sliding count windows of a running stream of three files, the unfinished last one included."""
    path = scratch(spark)
    events = table(spark, sf_dir, "events").select("ts", "event_id", "value")
    _in_files(events, f"{path}/in", 3, "event_id")

    def keep(windows, version):
        _per_window(windows).write.mode("overwrite").parquet(f"{path}/out/version={version}")

    options = StreamOptions(window_count=200, update_frequency=60)
    buffer = WindowBuffer(spark, f"{path}/state", options, ["ts", "event_id"], keep)
    _run(f"{path}/in", events.schema, path, buffer, spark)
    buffer.flush()
    return spark.read.parquet(f"{path}/out").select("window", "n_rows", "first_seq", "last_seq", "total")


@query("stream_time_windows", f"WITH {_TIME.format(size=3600, slide=900)} SELECT k * 900 AS start_second, count(*) AS n_rows, {rounded('sum(value)')} AS total FROM w GROUP BY k")
def stream_time_windows(spark, sf_dir):
    """The sliding time windows of a running stream; late records fire their windows again."""
    path = scratch(spark)
    events = table(spark, sf_dir, "events").select("ts", "event_id", "value")
    _in_files(events, f"{path}/in", 3, "event_id")

    def keep(windows, version):
        counted = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("total"))
        counted.write.mode("overwrite").parquet(f"{path}/out/version={version}")

    options = StreamOptions(window_strategy="time", window_time=3600, update_frequency=900)
    buffer = WindowBuffer(spark, f"{path}/state", options, ["ts", "event_id"], keep, ts="ts")
    _run(f"{path}/in", events.schema, path, buffer, spark)
    buffer.flush()
    newest = spark.read.parquet(f"{path}/out").groupBy("window").agg(F.max_by(F.struct("n_rows", "total"), "version").alias("w"))
    return newest.select((F.col("window") * 900).alias("start_second"), "w.n_rows", "w.total")


@query("stream_er")
def stream_er(spark, sf_dir):
    """Parts arrive in three files; every window, the unfinished last one too, trains on and renews the similarity lists."""
    path = scratch(spark)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    _in_files(part, f"{path}/in", 3, "p_partkey")
    options = StreamOptions(window_count=131, walks_per_node=2, most_similar_k=5)
    records = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    run = start(
        spark, records, path, options, ["p_partkey"], trigger={"availableNow": True}, walk=WalkOptions(sentence_length=8, backtrack=False),
        training=TrainOptions(dimensions=16, window=3), cols=["p_name", "p_brand", "p_type"], first_epochs=2, later_epochs=1,
    )
    return run.finish()


_BATCH_EDGES = f"""cells AS (SELECT *, rid_no % 3 AS win FROM ({cells_sql("part", "p_partkey", GRAPH_COLS)})),
freq AS (SELECT win, value, count(*) AS frequency FROM cells GROUP BY win, value),
weighted AS (SELECT c.*, 1.0 / (ln(f.frequency) / ln(10.0) + 1.0) AS w, 'tt__' || c.value AS token FROM cells c JOIN freq f ON c.win = f.win AND c.value = f.value),
edges AS (
  SELECT ((win * 1000000000 + rid_no) * 100 + col_no) * 2 AS seq, rid AS src, token AS dst, CAST(1.0 AS DOUBLE) AS w_fwd, CAST(w AS DOUBLE) AS w_back FROM weighted
  UNION ALL SELECT ((win * 1000000000 + rid_no) * 100 + col_no) * 2 + 1, token, 'cid__' || col, CAST(w AS DOUBLE), CAST(1.0 AS DOUBLE) FROM weighted)"""


@query(
    "graph_delta",
    f"""WITH {graph_sql(_BATCH_EDGES)} SELECT a.node, nbr, {rounded('weight')} AS weight, n_edges, degree FROM adj a JOIN deg d ON a.node = d.node""",
)
def graph_delta(spark, sf_dir):
    """The stored graph after three batches, merged after the second; the SQL makes it anew from all edges."""
    store = GraphStore(spark, scratch(spark), TYPES, merge_every=2)
    part = table(spark, sf_dir, "part").withColumn("window", F.col("p_partkey") % 3)
    cells = C.cells(part, "p_partkey", list(GRAPH_COLS), carry=("window",))
    edges = freeze(E.edge_list(cells, Smoothing.parse("log"), window="window"))
    for batch in range(3):
        store.add(edges.filter(F.col("edge_seq.window") == batch), batch)
    return store.adjacency().join(store.degrees(), "node")


@query("stream_metrics")
def stream_metrics(spark, sf_dir):
    path = scratch(spark)
    events = table(spark, sf_dir, "events").select("ts", "event_id", "value")
    _in_files(events, f"{path}/in", 3, "event_id")
    listener = StreamMetrics(keep=2, spark=spark, path=f"{path}/log")

    def keep(windows, version):
        _per_window(windows).write.mode("overwrite").parquet(f"{path}/out/version={version}")

    buffer = WindowBuffer(spark, f"{path}/state", StreamOptions(window_count=500), ["ts", "event_id"], keep)
    _run(f"{path}/in", events.schema, path, buffer, spark, listener)
    return listener.table(spark).select("batch", "n_rows")


_BY_BATCH = """numbered AS (SELECT *, (event_id - low) // ((high - low + 3) // 3) AS batch, value >= 2 AND event_type <> 'error' AS good
  FROM events, (SELECT min(event_id) AS low, max(event_id) AS high FROM events))"""


def _checked(spark, sf_dir):
    """Events in three batches, in windows of 500; small values and errors are set apart."""
    path = scratch(spark)
    events = table(spark, sf_dir, "events").select("ts", "event_id", "event_type", "value")
    _in_files(events, f"{path}/in", 3, "event_id")
    checks = {"event_type": F.col("event_type") != "error", "value": F.col("value") >= 2}

    def keep(windows, version):
        _per_window(windows).write.mode("overwrite").parquet(f"{path}/out/version={version}")

    buffer = WindowBuffer(spark, f"{path}/state", StreamOptions(window_count=500), ["ts", "event_id"], keep, checks=checks)
    _run(f"{path}/in", events.schema, path, buffer, spark)
    return buffer


@query(
    "stream_batches",
    f"""WITH {_BY_BATCH},
sizes AS (SELECT batch, count(*) FILTER (WHERE good) AS n_rows, count(*) FILTER (WHERE NOT good) AS n_bad FROM numbered GROUP BY batch),
sums AS (SELECT *, sum(n_rows) OVER (ORDER BY batch) AS so_far FROM sizes)
SELECT batch, n_rows, n_bad, CAST(so_far // 500 - (so_far - n_rows) // 500 AS BIGINT) AS n_windows, CAST(so_far % 500 AS BIGINT) AS n_waiting, TRUE AS timed FROM sums""",
)
def stream_batches(spark, sf_dir):
    """Measures that each micro-batch stores itself."""
    return _checked(spark, sf_dir).batches().select("batch", "n_rows", "n_bad", "n_windows", "n_waiting", (F.col("seconds") > 0).alias("timed"))


@query(
    "stream_quarantine",
    f"""WITH {_BY_BATCH} SELECT event_id, batch, CASE WHEN event_type <> 'error' THEN 'value' WHEN value >= 2 THEN 'event_type' ELSE 'event_type,value' END AS reasons
FROM numbered WHERE NOT good""",
)
def stream_quarantine(spark, sf_dir):
    """Records that were set apart, and why."""
    return _checked(spark, sf_dir).quarantine().select(
        "event_id", F.floor(F.col("version") / 2).alias("batch"), F.array_join("reasons", ",").alias("reasons"))


# --- files ----------------------------------------------------------------------------------


@query("edge_file", f"WITH {GRAPH_EDGES} SELECT src, dst, {rounded('w_fwd')} AS w_fwd, {rounded('w_back')} AS w_back FROM edges")
def edge_file(spark, sf_dir):
    path = scratch(spark)
    writers.write_edge_text(part_edges(spark, sf_dir, list(GRAPH_COLS)), TYPES, path)
    types, edges = readers.read_edge_list(spark, path)
    assert types == TYPES
    return edges.select("src", "dst", "w_fwd", "w_back")


@query("edge_file_pairs", f"WITH {GRAPH_EDGES} SELECT src, dst FROM edges")
def edge_file_pairs(spark, sf_dir):
    path = scratch(spark)
    writers.write_edge_text(part_edges(spark, sf_dir, list(GRAPH_COLS)), TYPES, path)
    return readers.read_edge_pairs(spark, path)


@query("table_file", "SELECT c_custkey, c_name, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer")
def table_file(spark, sf_dir):
    path = scratch(spark)
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("header", True).csv(path)
    return readers.read_table(spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@query("walk_file", f"WITH w AS ({walks_sql(PART_GRAPH, _SPREAD, LENGTH)}) SELECT walk FROM w")
def walk_file(spark, sf_dir):
    path = scratch(spark)
    tables = W.walk_tables(part_adjacency(spark, sf_dir), TYPES)
    seeds = W.spread_walks(G.roots(part_nodes(spark, sf_dir)), 3)
    writers.write_walks(W.random_walks(seeds, tables, TYPES, WalkOptions(sentence_length=LENGTH)), path)
    return readers.read_walks(spark, path).select("walk")


@query(
    "embedding_file",
    """SELECT 'idx__' || vec_id AS key, len(embedding) AS n, round(CAST(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS DOUBLE), 4) + 0.0 AS total FROM embeddings""",
)
def embedding_file(spark, sf_dir):
    path = scratch(spark)
    writers.write_embedding_text(record_table(spark, sf_dir).select("key", "vector"), path)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return readers.read_embeddings(spark, path).select("key", F.size("vector").alias("n"), (F.round(total, 4) + 0.0).alias("total"))


@query("similarity_upsert", f"{_MERGED} SELECT id, word, {rounded('score')} AS score, row_number() OVER (PARTITION BY id ORDER BY score DESC, word DESC) AS rank FROM merged QUALIFY rank <= 10")
def similarity_upsert(spark, sf_dir):
    """Two versions of a stored list, the second for changed ids only, read back as one."""
    path = scratch(spark)
    pairs = scored_pairs(spark, sf_dir)
    cut = table(spark, sf_dir, "events").count() // 2
    writers.upsert_list(M.similarity_list(pairs.filter(F.col("seq") < cut), 10), path, 0)
    new = pairs.filter(F.col("seq") >= cut)
    old = M.flat_list(writers.latest_list(spark, path, before=1).join(new.select("id").distinct(), "id", "left_semi"))
    writers.upsert_list(M.merge_lists(old, new, 10), path, 1)
    return M.flat_list(writers.latest_list(spark, path))
