import pytest
from pyspark.sql import functions as F

from rowloom.functions.smoothing import Smoothing
from rowloom.operators import cells as C
from rowloom.operators import edges as E
from rowloom.operators import numbering as N
from rowloom.operators import sets as S
from rowloom.options import NodeTypes


def values(spark, cell):
    df = spark.createDataFrame([(1, cell)], "k long, v string")
    return [r.value for r in C.cells(df, "k", numeric=[]).orderBy("pos").collect()]


@pytest.mark.parametrize(
    "cell, expected",
    [
        (None, []), ("", []), ("nan", []),
        ("12.0", ["12"]), ("3.7", ["3"]), ("-3.7", ["-3"]), ("1e3", ["1000"]),
        ("inf", ["inf"]), ("1_000", ["1_000"]), ("12d", ["12d"]),
        ("a b", ["a_b"]), ("a,b", ["ab"]), ('say "x"', ['say_\\"x\\"']),
        ("['x y','z']", ["x_y", "z"]), ("(1,2)", ["(12)"]), ("2001", ["2001"]), ("[oops", ["[oops"]),
    ],
)
def test_cell_rules(spark, cell, expected):
    assert values(spark, cell) == expected


def test_typed_columns(spark):
    df = spark.createDataFrame(
        [(1, True, 2.9, float("nan"), ["p q", None, "3.0"])], "k long, b boolean, d double, n double, l array<string>"
    )
    got = {(r.col, r.pos): (r.value, r.is_numeric) for r in C.cells(df, "k").collect()}
    assert got == {("b", 0): ("1", True), ("d", 0): ("2", True), ("l", 0): ("p_q", False), ("l", 2): ("3", False)}


def test_numeric_columns(spark):
    df = spark.createDataFrame([("1", "x", None), ("2.5", "3", ""), ("nan", "4", "7f")], "a string, b string, c string")
    assert {r.col: r.is_numeric for r in C.numeric_columns(df).collect()} == {"a": True, "b": False, "c": False}
    empty = spark.createDataFrame([(None,)], "a string")
    assert C.numeric_columns(empty).first().is_numeric


def test_row_ids_need_key_or_order(spark):
    df = spark.createDataFrame([("b",), ("a",)], "v string")
    assert {(r.v, r.rid) for r in C.row_ids(df, order=["v"], start=5).collect()} == {("a", "idx__5"), ("b", "idx__6")}
    with pytest.raises(ValueError):
        C.row_ids(df)


def test_edge_list_weights(spark, rows):
    df = spark.createDataFrame([(0, "foo"), (1, "foo"), (2, "bar")], "k long, c string")
    edges = E.edge_list(C.cells(df, "k"), Smoothing.parse("inverse"))
    got = rows(edges.select("src", "dst", "w_fwd", "w_back"))
    assert got == sorted([
        ("idx__0", "tt__foo", 1.0, 0.5), ("idx__1", "tt__foo", 1.0, 0.5), ("idx__2", "tt__bar", 1.0, 1.0),
        ("tt__foo", "cid__c", 0.5, 1.0), ("tt__foo", "cid__c", 0.5, 1.0), ("tt__bar", "cid__c", 1.0, 1.0),
    ], key=repr)


def test_frequency_per_window(spark):
    df = spark.createDataFrame([(0, "x", 0), (1, "x", 0), (1, "x", 1)], "k long, c string, window long")
    edges = E.edge_list(C.cells(df, "k", ["c"], carry=("window",)), Smoothing.parse("inverse"), window="window")
    weights = {(r.edge_seq.window, r.w_back) for r in edges.filter("src like 'idx%'").collect()}
    assert weights == {(0, 0.5), (1, 1.0)}


@pytest.mark.parametrize("text", ["smooth,1,10", "smooth,0.5,1", "log,1", "piecewise", "log,2,3", "other"])
def test_bad_smoothing(text):
    with pytest.raises(ValueError):
        Smoothing.parse(text)


def test_smoothing_honours_parameters(spark):
    w = Smoothing.parse("smooth,0.3,10").weight(F.lit(10))
    assert abs(spark.range(1).select(w).first()[0] - 0.31) < 1e-9


def test_dense_index_is_dense_and_ordered(spark):
    df = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("v"))
    got = [(r.no, r.v) for r in N.dense_index(df, ["v"], "no").collect()]
    assert [v for _, v in sorted(got)] == sorted(v for _, v in got)
    assert sorted(n for n, _ in got) == list(range(1000))


def test_hot_group_is_numbered_by_many_tasks(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, "hub").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
                                  F.col("id").cast("string").alias("v"), F.lit(1 << 40).alias("w"))
    sizes = N.group_totals(df, "g").withColumnRenamed("group_size", "n")
    numbered = N.number_in_groups(df.join(sizes, "g"), "g", "v", "n", weight="w", chunk=100)
    for g, n in [("hub", 2500)]:
        got = numbered.filter(F.col("g") == g).select("position", "weight_before").collect()
        assert sorted(r.position for r in got) == list(range(n))
        assert all(r.weight_before == r.position << 40 for r in got)


def test_dictionary_keeps_weights_and_decodes(spark, rows):
    df = spark.createDataFrame([(0, "a b"), (1, "b"), (2, "c_tt_d")], "k long, c string")
    edges = E.edge_list(C.cells(df, "k"), Smoothing.parse("log"))
    dictionary = S.key_dictionary(edges)
    coded = S.compress_edges(edges, dictionary, NodeTypes.parse())
    assert rows(coded.select("w_fwd", "w_back")) == rows(edges.select("w_fwd", "w_back"))
    keys = coded.select(F.col("src").alias("key")).filter("key like 'tt__%'").distinct()
    decoded = {r.key for r in S.decode_keys(keys, dictionary).collect()}
    assert {"tt__a_b", "tt__b"} <= decoded


def test_row_vectors_zero_on_miss(spark):
    vectors = spark.createDataFrame([("x", [1.0, 2.0])], "key string, vector array<float>")
    df = spark.createDataFrame([(7, "x", "y")], "k long, a string, b string")
    got = S.row_vectors(df, "k", ["b", "a"], vectors, 2, "idx__").first()
    assert (got.key, got.vector) == ("idx__7", [0.0, 0.0, 1.0, 2.0])
