import random
import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.functions.stats import kendall_p
from rowloom.operators import evaluate as V
from rowloom.operators import knn as K
from rowloom.operators import vector_cells as C
from rowloom.operators import match as M


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    m = centres[rng.integers(0, 6, 240)] + 0.3 * rng.normal(size=(240, 8))
    m[::3] = m[0]  # a third are copies
    m[5] = 0
    rows = [(f"idx__{i}", [float(np.float32(x)) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "key string, vector array<float>").cache()


def brute(df, k, metric, floor=None):
    rows = sorted(df.collect())
    keys = [r.key for r in rows]
    m = np.array([r.vector for r in rows])
    if metric == "cosine":
        n = np.linalg.norm(m, axis=1, keepdims=True)
        u = m / np.where(n > 0, n, 1)
        s = np.round(u @ u.T, 9)
    else:
        s = -np.round(((m[:, None] - m[None]) ** 2).sum(2), 9)
    out = {}
    for i, key in enumerate(keys):
        order = sorted((j for j in range(len(keys)) if j != i and (floor is None or s[i, j] > floor)), key=lambda j: (-s[i, j], keys[j]))
        if order:
            out[key] = [keys[j] for j in order[:k]]
    return out


def found(df):
    lists = {}
    for r in sorted(df.collect(), key=lambda r: (r.key, r.rank)):
        lists.setdefault(r.key, []).append(r.nbr)
    return lists


@pytest.mark.parametrize("metric, block, floor", [("cosine", 4096, None), ("cosine", 20, None), ("cosine", 20, 0.8), ("l2", 20, None)])
def test_knn_is_exact(vectors, metric, block, floor):
    got = K.knn(vectors, k=7, metric=metric, block_rows=block, floor=floor)
    assert found(got) == brute(vectors, 7, metric, floor)


@pytest.mark.parametrize("metric, pivots, floor", [("cosine", 4, None), ("l2", 2, None)])
def test_knn_is_exact_in_a_tree_of_cells(vectors, metric, pivots, floor):
    got = K.knn(vectors, k=7, metric=metric, block_rows=3, max_pivots=pivots, floor=floor)
    assert found(got) == brute(vectors, 7, metric, floor)


def test_cells_of_a_tree_are_bounded(vectors):
    different = vectors.dropDuplicates(["vector"]).cache()
    tree, blocked = C.build(different, "cosine", block_rows=2, max_pivots=3)
    assert len(tree.levels) == 2 and tree.top.split.any() and tree.levels[0].filter("split").count() > 0
    assert blocked.count() == different.count() == blocked.select("key").distinct().count()
    assert tree.leaves.agg(F.max("n_blocks")).first()[0] <= C.SPLIT_BLOCKS
    for level in tree.levels:  # rings hold all radii, parents are cells of the level above
        assert level.filter("lo > hi and n_blocks > 0").isEmpty()


def test_queries_of_another_table_go_down_the_tree(vectors):
    a, b = vectors.filter("key like '%1'"), vectors.filter("key not like '%1'")
    got = found(K.knn(a, b, k=3, block_rows=3, max_pivots=4))
    assert got == found(K.knn(a, b, k=3)) and len(got) == a.count()


def test_vectors_that_cannot_be_told_apart(spark):
    df = spark.createDataFrame([(f"idx__{i}", [1.0, i * 1e-7]) for i in range(200)], "key string, vector array<float>")
    got = found(K.knn(df, k=2, block_rows=2, max_pivots=2))
    assert got == brute(df, 2, "cosine")


def test_knn_of_no_vectors(spark):
    none = spark.createDataFrame([], "key string, vector array<float>")
    assert K.knn(none, k=3, block_rows=2, max_pivots=2).count() == 0


def test_knn_of_two_tables(vectors):
    a, b = vectors.filter("key like '%1'"), vectors.filter("key not like '%1'")
    got = found(K.knn(a, b, k=3, block_rows=30))
    assert len(got) == a.count() and all(len(v) == 3 and not any(x.endswith("1") for x in v) for v in got.values())


def test_knn_of_few(spark):
    df = spark.createDataFrame([("idx__0", [1.0, 0.0]), ("idx__1", [0.0, 1.0])], "key string, vector array<float>")
    assert found(K.knn(df, k=10)) == {"idx__0": ["idx__1"], "idx__1": ["idx__0"]}


def test_probes_trade_recall(vectors):
    exact = brute(vectors, 7, "cosine")
    got = found(K.knn(vectors, k=7, block_rows=20, probes=4))
    recall = np.mean([len(set(got.get(k, [])) & set(v)) / len(v) for k, v in exact.items()])
    assert recall > 0.5


def test_recall_and_probes_for_it(vectors):
    exact = K.knn(vectors, k=7)
    assert K.recall(exact, exact).filter("recall < 1 or recall_all < 1").isEmpty()
    few = K.knn(vectors, k=7, block_rows=8, probes=1)
    ours = K.recall(few, exact).first().recall_all
    known = brute(vectors, 7, "cosine")
    got = found(few)
    assert ours >= np.sum([len(set(got.get(k, [])) & set(v)) for k, v in known.items()]) / sum(map(len, known.values())) - 1e-9
    probes = K.probes_for(vectors, k=7, n_sample=40, block_rows=8)
    assert K.recall(K.knn(vectors, k=7, block_rows=8, probes=probes), exact).first().recall_all >= 0.9


def test_similarity_list_example(spark):
    pairs = [("banana", 0.8), ("cherry", 0.9), ("grape", 0.85), ("orange", 0.7), ("pear", 0.95), ("watermelon", 0.92)]
    df = spark.createDataFrame([("apple", w, s, i) for i, (w, s) in enumerate(pairs)], "id string, word string, score double, seq long")
    got = [r.word for r in M.similarity_list(df, 3).orderBy("rank").collect()]
    assert got == ["pear", "watermelon", "cherry"]
    step = M.similarity_list(df.filter("seq < 3"), 3)
    assert [r.word for r in M.merge_lists(step, df.filter("seq >= 3"), 3).orderBy("rank").collect()] == got


def test_first_score_stays(spark):
    df = spark.createDataFrame([("a", "x", 0.1, 0), ("a", "x", 0.9, 1)], "id string, word string, score double, seq long")
    assert M.similarity_list(df, 3).first().score == 0.1
    old = M.similarity_list(df, 3)
    assert M.merge_lists(old, df.withColumn("score", F.lit(5.0)), 3).first().score == 0.1


def test_score_ties_stay(spark, rows):
    df = spark.createDataFrame([("idx__1", "idx__2", 0.901), ("idx__1", "idx__3", 0.899), ("idx__1", "idx__4", 0.5)], "id string, word string, score double")
    assert rows(M.predicted_pairs(df, 1, 1)) == [(1, 2), (1, 3)]
    assert len(rows(M.predicted_pairs(df, 0, 1))) == 3


def test_order_of_the_two_limits(spark, rows):
    near = spark.createDataFrame([("idx__0", "idx__1", 0.9, 1), ("idx__0", "idx__5", 0.8, 2), ("idx__0", "idx__6", 0.7, 3)], "key string, nbr string, score double, rank int")
    assert rows(M.cross_source_candidates(near, 3, 1).select("nbr", "rank")) == [("idx__5", 1)]


def test_er_report_counts(spark):
    cand = spark.createDataFrame(
        [("idx__0", "idx__10", 0.9, 1), ("idx__10", "idx__0", 0.9, 1),   # right
         ("idx__1", "idx__12", 0.8, 1), ("idx__12", "idx__1", 0.8, 1),   # item known, wrong
         ("idx__2", "idx__11", 0.7, 1), ("idx__11", "idx__2", 0.7, 1),   # item unknown, candidate known
         ("idx__3", "idx__15", 0.6, 1), ("idx__15", "idx__3", 0.6, 1),   # neither known
         ("idx__4", "idx__10", 0.6, 1)], "key string, nbr string, score double, rank int")  # not mutual
    truth = spark.createDataFrame([("idx__0", "idx__10"), ("idx__1", "idx__11"), ("idx__4", "idx__14"), ("idx__5", "idx__13")], "item string, match string")
    keys = spark.createDataFrame([(f"idx__{i}",) for i in (0, 1, 2, 3, 4, 10, 11, 12, 15)], "key string")
    r = V.er_report(cand, keys, truth, 10, 5).first()
    assert (r.n_correct, r.n_candidates, r.n_golden, r.n_truth_items, r.n_no_candidate) == (1, 3, 4, 4, 1)
    assert r.n_wrong == 3  # two candidates, and item 5 without a vector
    assert (round(r.p, 4), r.r, r.gp) == (0.3333, 0.25, 0.25)
    assert {(x.id1, x.id2) for x in V.suspicious_matches(cand, truth, 10, 5).collect()} == {("idx__1", "idx__12"), ("idx__2", "idx__11")}


def test_empty_sets_score_zero(spark):
    empty = spark.createDataFrame([], "lo long, hi long")
    assert tuple(V.prf(empty, empty).first())[3:] == (0.0, 0.0, 0.0)


def as_list(spark, words, key="idx__1"):
    return spark.createDataFrame([(key, w, i + 1) for i, w in enumerate(words)], "id string, word string, rank int")


def test_kendall(spark):
    r = V.kendall(as_list(spark, "abc"), as_list(spark, "cba")).first()
    assert (r.n_common, r.tau) == (3, -1.0)
    r = V.kendall(as_list(spark, "axy"), as_list(spark, "avw")).first()
    assert (r.n_common, r.tau, r.p_value) == (1, None, None)
    s = V.kendall_summary(V.kendall(as_list(spark, "ax"), as_list(spark, "av"))).first()
    assert (s.average_tau, s.n_undefined) == (None, 1)


def test_kendall_p_against_all_permutations():
    from itertools import permutations

    for n in range(2, 7):
        counts = [sum(a > b for i, a in enumerate(p) for b in p[i + 1 :]) for p in permutations(range(n))]
        pairs = n * (n - 1) // 2
        for d in range(pairs + 1):
            low = min(d, pairs - d)
            tail = sum(c <= low for c in counts) / len(counts)
            want = 1.0 if 2 * low == pairs else min(1.0, 2 * tail)
            assert abs(kendall_p(n, d) - want) < 1e-12
    assert 0 < kendall_p(50, 400) < 0.05


def column_table(spark, lists):
    return spark.createDataFrame([(a, b, i + 1) for a, bs in lists.items() for i, b in enumerate(bs)], "left_col string, right_col string, rank int")


def test_match_columns(spark, rows):
    simple = column_table(spark, {"a_1": ["b_1", "b_2"], "a_2": ["b_2", "b_1"], "b_1": ["a_1", "a_2"], "b_2": ["a_2", "a_1"]})
    assert rows(M.match_columns(simple)) == [("a_1", "b_1"), ("a_2", "b_2")]
    # a_1 prefers b_1, but b_1 prefers a_2; a_1 takes b_2, whose nearest it is
    crossed = column_table(spark, {"a_1": ["b_1", "b_2"], "a_2": ["b_1", "b_2"], "b_1": ["a_2", "a_1"], "b_2": ["a_1", "a_2"]})
    assert rows(M.match_columns(crossed)) == [("a_1", "b_2"), ("a_2", "b_1")]
    # nobody has a_1 as the nearest: four misses, then it drops out
    alone = column_table(spark, {"a_1": ["b_1"], "a_2": ["b_1"], "b_1": ["a_2", "a_1"]})
    assert rows(M.match_columns(alone)) == [("a_2", "b_1")]


def brute_matches(lists, max_rank):
    """Turns in name order over whole lists, taken literally."""
    lists = {c: list(near) for c, near in lists.items() if near}
    open_, misses, out = set(lists), dict.fromkeys(lists, 0), []
    while open_:
        for x in sorted(open_):
            if x not in open_:
                continue
            if misses[x] > max_rank or not lists[x]:
                open_.remove(x)
                continue
            partner = next((c for c in lists[x] if c in open_ and lists.get(c, [None])[:1] == [x]), None)
            if partner is None:
                misses[x] += len(lists[x])
                continue
            open_ -= {x, partner}
            out.append(tuple(sorted((x, partner))))
            lists = {c: [y for y in near if y not in (x, partner)] for c, near in lists.items()}
    return sorted(out)


@pytest.mark.parametrize("max_rank", [0, 3, 10])
def test_match_columns_against_brute_force(spark, rows, max_rank):
    rng = random.Random(max_rank)
    for n in (1, 5, 14):
        a, b = [f"a_{i:02d}" for i in range(n)], [f"b_{i:02d}" for i in range(n + 2)]
        lists = {c: rng.sample(other, rng.randrange(0, len(other) + 1)) for own, other in ((a, b), (b, a)) for c in own}
        for ahead in (1, 32):
            assert rows(M.match_columns(column_table(spark, lists), max_rank, ahead)) == brute_matches(lists, max_rank)


def test_match_columns_takes_few_rounds(spark, rows, monkeypatch):
    rng, rounds, nearest = random.Random(2), [], M._nearest_columns
    place = {f"{s}_{i:03d}": rng.random() for s in "ab" for i in range(60)}
    lists = {c: sorted((d for d in place if d[0] != c[0]), key=lambda d: abs(place[c] - place[d])) for c in place}
    monkeypatch.setattr(M, "_nearest_columns", lambda *args: rounds.append(1) or nearest(*args))
    got = rows(M.match_columns(column_table(spark, lists), 60))
    assert got == brute_matches(lists, 60) and len(got) > 20 and len(rounds) < 10


def test_match_columns_without_candidates(spark, rows):
    assert rows(M.match_columns(spark.createDataFrame([], "left_col string, right_col string, rank int"))) == []


def test_infer_prefixes():
    assert M.infer_prefixes(["c_a", "s_b", "c_d"]) == ["c", "s"]
    assert M.infer_prefixes(["a_x", "b_x", "c_x"]) is None


def test_odd_one_out_ignores_unknown(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])], "key string, vector array<float>")
    tests = spark.createDataFrame([("1", "nmr1", ["a", "b", "zz", "c"], "c"), ("2", "nmc1", ["x", "y"], "y")], "test_id string, file string, terms array<string>, expected string")
    answers = V.odd_one_out(tests, vectors)
    assert {r.test_id: r.answer for r in answers.collect()} == {"1": "c", "2": None}
    report = {(r.level, r.family): r.accuracy for r in V.eq_report(answers).collect()}
    assert report[("family", "rows")] == 100.0 and report[("family", "columns")] == 0.0 and report[("all", None)] == 50.0
