"""Scores of matches, columns, vectors and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.stats import kendall_p_value
from rowloom.functions.text import id_number
from rowloom.functions.vectors import dot, mean, unit
from rowloom.operators.match import mutual


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def prf(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: counts, precision, recall and F1 of two sets of distinct pairs."""
    marked = predicted.withColumn("p", F.lit(1)).join(actual.withColumn("a", F.lit(1)), ["lo", "hi"], "full")
    counts = marked.agg(
        F.count("p").alias("n_predicted"),
        F.count("a").alias("n_actual"),
        F.count(F.col("p") + F.col("a")).alias("n_correct"),
    )
    scored = counts.withColumn("precision", _ratio(F.col("n_correct"), F.col("n_predicted"))).withColumn(
        "recall", _ratio(F.col("n_correct"), F.col("n_actual"))
    )
    return scored.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def correct_pairs(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    return predicted.select("lo", "hi").intersect(actual.select("lo", "hi"))


def judged_candidates(candidates: DataFrame, truth: DataFrame, n_items: int, n_top: int) -> DataFrame:
    """Mutual candidates of source A with flags: pair in truth, item in truth, candidate in truth."""
    own = mutual(candidates, n_top).filter(id_number(F.col("key")) < n_items)
    links = truth.select(F.col("item").alias("key"), F.col("match").alias("nbr")).distinct().withColumn("is_match", F.lit(True))
    items = truth.select(F.col("item").alias("key")).distinct().withColumn("item_known", F.lit(True))
    ids = truth.select(F.explode(F.array("item", "match")).alias("nbr")).distinct().withColumn("nbr_known", F.lit(True))
    joined = own.join(links, ["key", "nbr"], "left").join(items, "key", "left").join(ids, "nbr", "left")
    return joined.select(
        "key", "nbr", "score", "rank", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("is_match", "item_known", "nbr_known")]
    )


def er_report(candidates: DataFrame, keys: DataFrame, truth: DataFrame, n_items: int, n_top: int) -> DataFrame:
    """One row of scores and counts for matches against truth.

    Candidates of items that the truth names count; of other items only candidates whose id the
    truth names. The golden precision is over all candidates. Recall is over truth items. A truth
    item without a vector is one miss. ``keys`` lists the rows that have a vector.
    """
    judged = judged_candidates(candidates, truth, n_items, n_top)
    known, hit = F.col("item_known"), F.col("is_match")
    counted = known | F.col("nbr_known")
    per_candidate = judged.agg(
        F.count_if(known & hit).alias("n_correct"),
        F.count_if(counted & ~(known & hit)).alias("n_wrong"),
        F.count_if(counted).alias("n_candidates"),
        F.count(F.lit(1)).alias("n_golden"),
    )
    items = truth.select(F.col("item").alias("key")).distinct()
    having = judged.select("key").distinct().withColumn("has", F.lit(1))
    vectors = keys.select("key").distinct().withColumn("vec", F.lit(1))
    own = id_number(F.col("key")) < n_items
    per_item = items.join(vectors, "key", "left").join(having, "key", "left").agg(
        F.count(F.lit(1)).alias("n_truth_items"),
        F.count_if(own & F.col("vec").isNull()).alias("n_no_vector"),
        F.count_if(own & F.col("vec").isNotNull() & F.col("has").isNull()).alias("n_no_candidate"),
    )
    both = per_candidate.join(F.broadcast(per_item), F.lit(True))  # two one-row tables
    scored = (
        both.withColumn("n_wrong", F.col("n_wrong") + F.col("n_no_vector"))
        .withColumn("p", _ratio(F.col("n_correct"), F.col("n_candidates")))
        .withColumn("r", _ratio(F.col("n_correct"), F.col("n_truth_items")))
        .withColumn("gp", _ratio(F.col("n_correct"), F.col("n_golden")))
    )
    return scored.select(
        "p", "r", _f1(F.col("p"), F.col("r")).alias("f"), "gp", F.col("r").alias("gr"), _f1(F.col("gp"), F.col("r")).alias("gf"),
        "n_correct", "n_wrong", "n_candidates", "n_golden", "n_truth_items", "n_no_candidate",
    )


def suspicious_matches(candidates: DataFrame, truth: DataFrame, n_items: int, n_top: int) -> DataFrame:
    """The candidates that :func:`er_report` counts as wrong."""
    judged = judged_candidates(candidates, truth, n_items, n_top)
    counted = F.col("item_known") | F.col("nbr_known")
    return judged.filter(counted & ~(F.col("item_known") & F.col("is_match"))).select(
        F.col("key").alias("id1"), F.col("nbr").alias("id2")
    )


def sm_report(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """One row for column matches; recall is over matched left columns that the truth names."""
    links = truth.select("left_col", "right_col").distinct().withColumn("hit", F.lit(1))
    lefts = truth.select("left_col").distinct().withColumn("known", F.lit(1))
    counts = (
        matches.join(links, ["left_col", "right_col"], "left")
        .join(lefts, "left_col", "left")
        .agg(
            F.count("hit").alias("n_correct"),
            F.count(F.lit(1)).alias("n_matches"),
            F.count("known").alias("n_known"),
        )
    )
    scored = counts.withColumn("precision", _ratio(F.col("n_correct"), F.col("n_matches"))).withColumn(
        "recall", _ratio(F.col("n_correct"), F.col("n_known"))
    )
    return scored.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


# --- quality of vectors ---------------------------------------------------------------------


def odd_one_out(tests: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per test (``test_id, terms``) the term least like the mean of the others' directions.

    Terms without a vector are ignored; the answer is null when no term has one.
    """
    terms = tests.select("test_id", F.explode("terms").alias("key"))
    found = terms.join(vectors.select("key", unit(F.col("vector")).alias("u")), "key")
    # the terms of one test line
    packed = found.groupBy("test_id").agg(F.collect_list(F.struct("key", "u")).alias("found"))
    with_mean = packed.withColumn("centre", mean(F.transform("found", lambda t: t["u"])))
    ranked = F.array_sort(
        F.transform("found", lambda t: F.struct(F.round(dot(t["u"], F.col("centre")), 9).alias("closeness"), t["key"].alias("key")))
    )
    answers = with_mean.select("test_id", F.get(ranked, F.lit(0))["key"].alias("answer"))
    return tests.join(answers, "test_id", "left")


def test_family(file: Column) -> Column:
    return F.when(file.startswith("nmr"), "rows").when(file.startswith("nmcon"), "concepts").when(
        file.startswith("nmc"), "columns"
    )


def eq_report(answers: DataFrame) -> DataFrame:
    """Accuracy in percent per file, per family (over all its tests), and the mean of the families.

    Input: ``file, expected, answer``. Levels: ``file``, ``family``, ``all``.
    """
    judged = answers.withColumn("family", test_family(F.col("file"))).filter("family is not null").select(
        "family", "file", F.coalesce(F.col("answer") == F.col("expected"), F.lit(False)).alias("hit")
    )
    levels = judged.rollup("family", "file").agg(
        F.count(F.lit(1)).alias("n_tests"),
        F.count_if("hit").alias("n_correct"),
        F.grouping_id().alias("level_id"),
    )
    percent = F.try_divide(F.col("n_correct") * 100.0, F.col("n_tests").cast("double"))
    by_file = levels.filter("level_id < 3").select(
        F.when(F.col("level_id") == 0, "file").otherwise("family").alias("level"),
        "family", "file", "n_tests", "n_correct", percent.alias("accuracy"),
    )
    overall = by_file.filter("level = 'family'").agg(
        F.lit("all").alias("level"),
        F.lit(None).cast("string").alias("family"),
        F.lit(None).cast("string").alias("file"),
        F.sum("n_tests").alias("n_tests"),
        F.sum("n_correct").alias("n_correct"),
        F.avg("accuracy").alias("accuracy"),
    )
    return by_file.unionByName(overall)


# --- agreement of rankings ------------------------------------------------------------------


def common_entries(list_a: DataFrame, list_b: DataFrame) -> DataFrame:
    """``id, word, rank_a, rank_b`` for words in both lists of an id."""
    a = list_a.select("id", "word", F.col("rank").alias("rank_a"))
    b = list_b.select("id", "word", F.col("rank").alias("rank_b"))
    return a.join(b, ["id", "word"])


def kendall(list_a: DataFrame, list_b: DataFrame) -> DataFrame:
    """``id, n_common, discordant, tau, p_value`` for ids in both lists.

    The entries of an id are a similarity list, so no longer than the list size; they are counted
    inside one row and no pair of entries ever becomes a row. Tau is null below two common words.
    """
    common = common_entries(list_a, list_b)
    packed = common.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank_a", "rank_b"))), lambda e: e["rank_b"]).alias("ranks")
    )
    shared = list_a.select("id").intersect(list_b.select("id"))
    ranks = F.coalesce("ranks", F.array().cast("array<int>"))
    joined = shared.join(packed, "id", "left").select("id", ranks.alias("ranks")).withColumn("n_common", F.size("ranks"))
    later_smaller = F.transform(
        "ranks", lambda x, i: F.size(F.filter(F.slice("ranks", F.lit(1), i), lambda y: y > x))
    )
    counted = joined.withColumn("discordant", F.aggregate(later_smaller, F.lit(0), lambda acc, x: acc + x))
    pairs = F.col("n_common") * (F.col("n_common") - 1) / 2
    tau = F.when(F.col("n_common") >= 2, (pairs - 2 * F.col("discordant")) / pairs)
    return counted.select(
        "id", "n_common", "discordant", tau.alias("tau"), kendall_p_value(F.col("n_common"), F.col("discordant")).alias("p_value")
    )


def kendall_summary(taus: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Mean tau, ids without one, ids with a small p-value, and the positive ones among these."""
    small = F.col("tau").isNotNull() & (F.col("p_value") < threshold)
    return taus.agg(
        F.avg("tau").alias("average_tau"),
        F.count_if(F.col("tau").isNull()).alias("n_undefined"),
        F.count_if(small).alias("n_significant"),
        F.count_if(small & (F.col("tau") > 0)).alias("n_positive"),
    )
