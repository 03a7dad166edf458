import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from rowloom.operators import match as M
from rowloom.options import MatchOptions, NodeTypes, StreamOptions, TrainOptions, WalkOptions
from rowloom.plans import batch as B
from rowloom.plans.experiment import list_against_list, list_against_truth
from rowloom.plans.stream import start
from rowloom.sources import readers, writers
from rowloom.streaming.buffer import WindowBuffer
from rowloom.streaming.matcher import StreamMatcher
from rowloom.streaming.metrics import StreamMetrics
from rowloom.streaming.windows import count_windows, idle_sessions


def expected_windows(n, size, slide, rest=False):
    """What a buffer that fires when full and then drops ``slide`` rows gives."""
    out, buffer = [], []
    for i in range(n):
        buffer.append(i)
        if len(buffer) == size:
            out.append(list(buffer))
            del buffer[: slide or size]
    if rest and buffer:
        out.append(buffer)
    return out


@pytest.mark.parametrize("size, slide", [(7, 0), (6, 2), (5, 5), (4, 3)])
@pytest.mark.parametrize("rest", [False, True])
def test_count_windows(spark, size, slide, rest):
    df = spark.range(25).withColumnRenamed("id", "seq")
    got = {}
    for r in count_windows(df, size, slide, keep_rest=rest).collect():
        got.setdefault(r.window, []).append(r.seq)
    assert [sorted(got[w]) for w in sorted(got)] == expected_windows(25, size, slide, rest)


@pytest.mark.parametrize("slide", [0, 2])
def test_stream_windows_equal_batch(spark, tmp_path, slide):
    seen = {}

    def keep(windows, version):
        for r in windows.collect():
            seen.setdefault(r.window, []).append(r.seq)

    buffer = WindowBuffer(spark, str(tmp_path), StreamOptions(window_count=6, update_frequency=slide), ["v"], keep)
    for number, (low, high) in enumerate([(0, 5), (5, 17), (17, 25)]):
        buffer(spark.range(low, high).withColumnRenamed("id", "v"), number)
    seen_before = {w: sorted(s) for w, s in seen.items()}
    buffer(spark.range(17, 25).withColumnRenamed("id", "v"), 2)  # the batch is run again
    assert {w: sorted(set(s)) for w, s in seen.items()} == seen_before
    assert buffer.flush()
    assert [sorted(set(seen[w])) for w in sorted(seen)] == expected_windows(25, 6, slide, rest=True)
    assert not buffer.flush()


def test_bad_records_are_set_apart(spark, tmp_path):
    rows = [("2024-01-01", "1.5"), ("2024-01-02", "2"), ("never", "3"), ("2024-01-03", "much"), (None, None), ("2024-01-04", "4")]
    batch = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "no long, day string, price string")
    checks = {"day": F.expr("try_to_timestamp(day) is not null"), "price": F.expr("price is null or try_cast(price as double) is not null")}
    seen = []
    options = StreamOptions(window_count=2)
    buffer = WindowBuffer(spark, str(tmp_path), options, ["no"], lambda w, v: seen.extend((r.rid_no, r.no) for r in w.collect()), checks=checks)
    for _ in range(2):  # a batch run again replaces its own rows
        seen.clear()
        buffer(batch, 0)
    assert sorted(seen) == [(0, 0), (1, 1)]
    assert {r.no: r.reasons for r in buffer.quarantine().collect()} == {2: ["day"], 3: ["price"], 4: ["day"]}
    assert buffer.quarantine().count() == 3
    buffer(batch.limit(0), 1)
    buffer(batch.filter("no = 0"), 2)
    measured = sorted(tuple(r)[:5] for r in buffer.batches().collect())
    assert measured == [(0, 3, 3, 1, 1), (1, 0, 0, 0, 1), (2, 1, 0, 1, 0)]
    assert sorted(seen) == [(0, 0), (1, 1), (2, 5), (3, 0)]


def test_ids_go_on_after_restart(spark, tmp_path):
    rids = []
    options = StreamOptions(window_count=2)
    for number in range(2):
        buffer = WindowBuffer(spark, str(tmp_path), options, ["v"], lambda w, v: rids.extend(r.rid for r in w.collect()), first_id=100)
        buffer(spark.range(2).withColumnRenamed("id", "v"), number)
    assert sorted(rids) == ["idx__100", "idx__101", "idx__102", "idx__103"]


def test_time_windows_of_a_stream(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    at = lambda s: start + dt.timedelta(seconds=s)
    fired = {}

    def keep(windows, version):
        for r in windows.collect():
            fired.setdefault(r.window, set()).add(r.v)

    options = StreamOptions(window_strategy="time", window_time=10, update_frequency=5)
    buffer = WindowBuffer(spark, str(tmp_path), options, ["ts", "v"], keep, ts="ts")
    for number, seconds in enumerate([(0, 3, 6), (8, 12), (21,)]):
        buffer(spark.createDataFrame([(at(s), s) for s in seconds], "ts timestamp, v int"), number)
    assert sorted(map(sorted, fired.values())) == [[0, 3], [0, 3, 6, 8], [6, 8, 12], [12]]


def _time_stream(spark, path, options, batches, flush=False):
    """The records of each window, as it was fired last."""
    start = dt.datetime(2024, 1, 1)
    fired = {}

    def keep(windows, version):
        got = {}
        for r in windows.collect():
            got.setdefault(r.window, set()).add(r.v)
        fired.update(got)

    buffer = WindowBuffer(spark, path, options, ["ts", "v"], keep, ts="ts")
    assert not buffer.flush()
    for number, seconds in enumerate(batches):
        rows = [(start + dt.timedelta(seconds=s), s) for s in seconds]
        buffer(spark.createDataFrame(rows, "ts timestamp, v double"), number)
        if flush:
            assert buffer.flush() and not buffer.flush()
    return fired


@pytest.mark.parametrize("flush", [False, True])
def test_late_records_fire_their_windows_again(spark, tmp_path, flush):
    options = StreamOptions(window_strategy="time", window_time=10)
    fired = _time_stream(spark, str(tmp_path), options, [(0.0, 3.0, 6.0), (25.0,), (4.0, 7.0), (26.0,), (45.0,)], flush)
    expected = [[0.0, 3.0, 4.0, 6.0, 7.0], [25.0, 26.0]] + ([[45.0]] if flush else [])
    assert sorted(map(sorted, fired.values())) == expected


@pytest.mark.parametrize("size, expected", [(2.5, [[0.0, 2.2], [2.6], [5.1]]), (0.5, [[0.0], [2.2], [2.6], [5.1]])])
def test_windows_of_part_seconds(spark, tmp_path, size, expected):
    options = StreamOptions(window_strategy="time", window_time=size)
    fired = _time_stream(spark, str(tmp_path), options, [(0.0, 2.2, 2.6, 5.1), (9.0,)])
    assert sorted(map(sorted, fired.values())) == expected


def test_log_of_a_stream_keeps_all_batches(spark, tmp_path):
    log = StreamMetrics(keep=2, spark=spark, path=str(tmp_path / "log"))
    for number in range(5):
        progress = SimpleNamespace(name="q", id="q", batchId=number, numInputRows=10, durationMs={"triggerExecution": 100}, sources=[])
        log.onQueryProgress(SimpleNamespace(progress=progress))
    assert sorted(r.batch for r in log.table(spark).collect()) == [0, 1, 2, 3, 4]
    assert len(log.log.rows) < 2 and log.log.consumed == 50


def test_idle_sessions(spark):
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(start + dt.timedelta(seconds=s),) for s in (0, 59, 118, 178, 400)], "ts timestamp")
    assert [r.n_rows for r in idle_sessions(df, "ts", 60).orderBy("session").collect()] == [3, 1, 1]


@pytest.mark.parametrize("bad", [dict(window_strategy="count"), dict(window_strategy="time"), dict(window_strategy="x"),
                                 dict(window_count=3, update_frequency=4), dict(window_count=3, output_format="db")])
def test_stream_options(bad):
    with pytest.raises(ValueError):
        StreamOptions(**bad)


def test_stream_matcher_finds_copies(spark, tmp_path):
    options = StreamOptions(window_count=20, walks_per_node=6, most_similar_k=3, list_size=4, score_floor=0.0)
    matcher = StreamMatcher(
        spark, str(tmp_path), options, walk=WalkOptions(sentence_length=8, backtrack=False),
        training=TrainOptions(dimensions=16, window=3, learning_rate=0.1, sampling_factor=0.0), first_epochs=4, later_epochs=2,
    )
    buffer = WindowBuffer(spark, str(tmp_path), options, ["v"], matcher)
    for number in range(2):
        rows = spark.range(number * 20, number * 20 + 20).select(
            F.col("id").alias("v"), F.concat(F.lit("name"), (F.col("id") % 10).cast("string")).alias("name"),
            F.concat(F.lit("city"), (F.col("id") % 10).cast("string")).alias("city"))
        buffer(rows, number)
    entries = matcher.similarity().collect()
    assert max(r.rank for r in entries) <= 4
    best = [r for r in entries if r.rank == 1]
    assert len({r.id for r in entries}) >= 38
    digit = lambda s: int(s[5:]) % 10
    assert sum(digit(r.id) == digit(r.word) for r in best) / len(best) > 0.5
    matcher.snapshot(str(tmp_path / "snap"))
    assert readers.read_similarity_list(spark, str(tmp_path / "snap")).count() == len({r.id for r in entries})


def test_edge_file_of_the_documented_format(spark, tmp_path):
    path = tmp_path / "e.txt"
    path.write_text('3#__tn,3$__tt,5$__idx,1$__cid\n"idx__0","tt__a b",1,0.5\n"tt__a b","cid__c",0.5\n"idx__1", "tt__x"\n')
    types, edges = readers.read_edge_list(spark, str(path))
    assert types == NodeTypes.parse()
    got = {(r.src, r.dst, r.w_fwd, r.w_back) for r in edges.collect()}
    assert got == {("idx__0", "tt__a b", 1.0, 0.5), ("tt__a b", "cid__c", 0.5, None), ("idx__1", "tt__x", None, None)}
    assert readers.edges_or_empty(spark, str(tmp_path / "none")).count() == 0


def test_a_weight_that_is_no_number_stops_the_job(spark, tmp_path):
    path = tmp_path / "e.txt"
    path.write_text('3#__tn,3$__tt,5$__idx,1$__cid\n"idx__0","tt__a",1,x\n')
    with pytest.raises(Exception, match="not a weight: x"):
        readers.read_edge_list(spark, str(path))[1].collect()


def test_truth_lists_and_tests(spark, tmp_path, rows):
    (tmp_path / "t.txt").write_text("idx_1,idx_20\n")
    assert rows(readers.read_truth(spark, str(tmp_path / "t.txt"))) == [("idx__1", "idx__20")]
    (tmp_path / "c.txt").write_text("c_a,s_a\nc_a,s_a\n")
    assert rows(readers.read_column_truth(spark, str(tmp_path / "c.txt"))) == [("c_a", "s_a")]
    (tmp_path / "info.txt").write_text("some/path,17\n")
    assert readers.read_source_boundary(spark, str(tmp_path / "info.txt")) == 17
    (tmp_path / "sim.csv").write_text("x,y\na,b\n")
    assert rows(readers.read_value_similarities(spark, str(tmp_path / "sim.csv"))) == [("a", "b", 1.0)]
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "nmr_1").write_text("['a', 'b', 'c']\nnot a list\n")
    assert [(r.file, r.terms, r.expected) for r in readers.read_quality_tests(spark, str(tmp_path / "q")).collect()] == [("nmr_1", ["a", "b", "c"], "c")]
    (tmp_path / "l.json").write_text('{"idx__1": [[0.9, "idx__2"], [0.8, "idx__3"]]}')
    got = M.flat_list(readers.read_similarity_list(spark, str(tmp_path / "l.json"), "json_object"))
    assert rows(got) == [("idx__1", "idx__2", 0.9, 1), ("idx__1", "idx__3", 0.8, 2)]
    with pytest.raises(Exception):
        readers.read_similarity_list(spark, str(tmp_path / "missing")).count()


def test_results_and_vectors(spark, tmp_path, rows):
    df = spark.createDataFrame([("idx__0", [0.5, -1.25])], "key string, vector array<float>")
    writers.write_embedding_text(df, str(tmp_path / "v"))
    assert rows(readers.read_embeddings(spark, str(tmp_path / "v"))) == [("idx__0", [0.5, -1.25])]
    writers.append_result(spark, str(tmp_path / "r"), {"a": 1}, {"time": 2.5}, spark.createDataFrame([(0.5,)], "p double"))
    writers.append_result(spark, str(tmp_path / "r"), {"a": 2}, {})
    assert {(r.parameters["a"], r.scores.get("p")) for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {("1", "0.5"), ("2", None)}


def test_whole_batch_run(spark, tmp_path):
    rows = [(i, f"name{i % 30}", f"city{i % 30}", f"kind{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "k long, name string, city string, kind string")
    stages = B.Stages()
    edges = B.table_edges(df, "k")
    vectors = B.train_edges(
        edges, walk=WalkOptions(sentence_length=10, walks_per_node=25, backtrack="strict", sampler="auto"),
        training=TrainOptions(dimensions=24, window=3, epochs=6, learning_rate=0.1, sampling_factor=0.0), stages=stages,
    )
    assert set(stages.metrics) == {"time_graph", "time_walks", "time_training"}
    truth = spark.createDataFrame([(f"idx__{i}", f"idx__{i + 30}") for i in range(30)], "item string, match string")
    report = B.test_rows(vectors, truth, 30, MatchOptions(n_top=10)).first()
    assert report.r > 0.8 and report.p > 0.8
    assert B.matched_rows(vectors, 30).count() >= 30
    small = TrainOptions(dimensions=8, window=2, epochs=1)
    done = B.run_rows(edges, truth, 30, str(tmp_path / "results"), walk=WalkOptions(sentence_length=4, walks_per_node=2), training=small).first()
    row = spark.read.parquet(str(tmp_path / "results")).first()
    assert row.parameters["walk.sentence_length"] == "4" and row.parameters["training.dimensions"] == "8"
    assert set(row.metrics) == {"time_graph", "time_walks", "time_training", "time_test"} and float(row.scores["p"]) == done.p


def test_experiments(spark):
    nested = M.nested_list(spark.createDataFrame([("idx__5", "idx__1", 0.9, 1), ("idx__5", "idx__2", 0.8, 2)], "id string, word string, score double, rank int"))
    truth = spark.createDataFrame([("idx__1", "idx__5")], "item string, match string")
    assert list_against_truth(nested, truth, 1, 2).first().f1 == 1.0
    assert list_against_list(nested, nested, 3).first().average_tau == 1.0
    assert list_against_list(nested, nested, 9).first().average_tau is None


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    options = StreamOptions(window_count=8, walks_per_node=1, most_similar_k=2)
    for number in range(2):
        rows = spark.range(number * 10, number * 10 + 10).select(F.col("id").alias("v"), F.concat(F.lit("name"), (F.col("id") % 5).cast("string")).alias("name"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        records = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        run = start(
            spark, records, str(tmp_path / "run"), options, ["v"], trigger={"availableNow": True}, cols=["name"],
            walk=WalkOptions(sentence_length=4, backtrack=False), training=TrainOptions(dimensions=4, window=2), first_epochs=1, later_epochs=1,
        )
        run.finish()
    assert sorted(r.rid_no for r in run.buffer.records().collect()) == list(range(20))
    starts = {r.src for r in run.matcher.edges().collect() if r.src.startswith("idx__")}
    assert starts == {f"idx__{i}" for i in range(20)}  # the two unfinished windows included
