"""Tables that grow with the data are joined by shuffle, however small Spark takes them to be before it runs."""

import pytest

from rowloom.catalog import QUERIES
from rowloom.operators import sets as S


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("parts"))
    rows = [(i, f"{a} {b}", f"Brand#{i % 5}", "ECONOMY", i % 7, 900.0 + i) for i, (a, b) in enumerate([("blue", "bolt"), ("old", "ring"), ("hot", "plate")] * 8)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{path}/part.parquet")
    return path


@pytest.mark.parametrize(
    "name", ["alias_probabilities", "weighted_slots", "walks_uniform", "walks_weighted", "walks_no_backtrack", "walks_intersecting",
             "numeric_adjacency", "dict_round_trip"])
def test_joins_by_shuffle(spark, parts, name):
    plan = QUERIES[name](spark, parts)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    # small at any size: starts of the ranges of split groups, numbers of rows by partition, at most 256 frequent keys
    grows = [line for line in joins if not any(word in line for word in ("_bucket", "_part", "_hot_"))]
    hot = [line for line in grows if "LeftSemi" not in line]
    assert "SortMergeJoin" in plan and not hot


def test_shared_values_without_a_join(spark, rows):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "value string")
    b = spark.createDataFrame([("x",), ("z",), (None,), (None,)], "value string")
    shared = S.shared_values(a, b)
    assert rows(shared) == rows(a.intersect(b)) == [("x",), (None,)]
    assert "Join" not in shared._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, most", [("dict_round_trip", 0), ("compressed_edges", 24)])
def test_plans_hold_the_edges_a_few_times(spark, parts, name, most):
    # the driver keeps a plan with its metrics, once more each time that the plan changes while it runs
    plan = QUERIES[name](spark, parts)._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in line for line in plan.splitlines() if line.lstrip(" :+-").startswith("FileScan")) <= most


def test_names_decode_to_themselves(spark, parts, rows):
    found = rows(QUERIES["dict_round_trip"](spark, parts))
    assert ("tt__blue_bolt", "tt__blue_bolt") in found and ("idx__23", "idx__23") in found
    assert all(name == decoded for name, decoded in found) and len(found) == len(set(found))
