"""Joins of frequent keys, running sums and idle times: right rows, and no task with all of them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rowloom.functions.smoothing import Smoothing
from rowloom.operators import cells as C
from rowloom.operators import edges as E
from rowloom.operators import hot_keys as H
from rowloom.operators import numbering as N
from rowloom.streaming.windows import idle_sessions


@pytest.fixture
def plain_joins(spark):
    """No broadcast but those asked for, and no plan made anew at run time."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def skewed(spark):
    key = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string")))
    return spark.range(40_000).select("id", key.alias("key"))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("sketch", [True, False])
def test_a_frequent_key_is_spread(spark, plain_joins, rows, how, sketch):
    left = skewed(spark)
    lookup = left.filter("key is not null").groupBy("key").agg(F.count("*").alias("n")).filter("key <> 'k7'")
    hot = H.frequent(left, "key") if sketch else H.frequent_by_count(lookup, ["key"], "n")
    assert [r.key for r in hot.collect()] == ["hot"]
    found = H.lookup_join(left, lookup, ["key"], hot, how)
    assert found.columns == ["id", "key", "n"]
    assert rows(found) == rows(left.join(lookup, "key", how).select("id", "key", "n"))
    sizes = sorted(r.c for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("c"), F.max("n")).collect())
    assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]


def test_an_unknown_frequent_key_finds_nothing(spark, rows):
    left = skewed(spark)
    lookup = spark.createDataFrame([("k1", 1)], "key string, n int")
    for how in ("inner", "left"):
        found = H.lookup_join(left, lookup, ["key"], H.frequent(left, "key"), how)
        assert rows(found) == rows(left.join(lookup, "key", how).select("id", "key", "n"))
    none = left.filter("false")
    assert H.lookup_join(none, lookup, ["key"], H.frequent(none, "key")).count() == 0
    with pytest.raises(ValueError):
        H.lookup_join(left, lookup, ["key"], H.frequent(left, "key"), "right")


def test_edges_of_one_common_value(spark, plain_joins):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, "same").otherwise(F.concat(F.lit("v"), "id")).alias("c"))
    edges = E.edge_list(C.cells(df, "id", ["c"]), Smoothing.parse("inverse"))
    weights = {r.dst: r.w_back for r in edges.filter("edge_seq.side = 0").select("dst", "w_back").distinct().collect()}
    assert weights["tt__same"] == 1 / 10_000 and weights["tt__v1"] == 1.0 and len(weights) == 10_001
    sizes = sorted(r.c for r in edges.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("c"), F.max("w_back")).collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("width", [50, 5000, 40_000_000])
def test_running_sums_over_ranges_of_ranges(spark, width):
    rng = random.Random(width)
    values = {rng.randrange(width) - width // 2: rng.randrange(9) for _ in range(400)}
    df = spark.createDataFrame(list(values.items()), "k long, v long")
    got = {r.k: r.before for r in N.running_before(df, "k", "v", "before").collect()}
    assert got == {k: sum(v for j, v in values.items() if j < k) for k in values}
    assert N.running_before(df.filter("false"), "k", "v", "before").count() == 0


def test_sessions_need_no_single_task(spark):
    rng = random.Random(1)
    start, seconds = dt.datetime(2024, 1, 1), sorted({rng.randrange(2_000_000) * 0.5 for _ in range(3000)})
    df = spark.createDataFrame([(start + dt.timedelta(seconds=s),) for s in seconds], "ts timestamp").repartition(3)
    found = idle_sessions(df, "ts", 600)
    assert "SinglePartition" not in found._jdf.queryExecution().toString()
    want, last = [], None
    for s in seconds:
        if last is None or s - last >= 600:
            want.append(0)
        want[-1] += 1
        last = s
    assert [r.n_rows for r in found.orderBy("session").collect()] == want
