"""Queries on vectors, candidates, similarity lists and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rowloom.catalog.base import query, rounded, table
from rowloom.operators import evaluate as V
from rowloom.operators import knn as K
from rowloom.operators import match as M
from rowloom.session import freeze

K_NEAR = 10
N_TOP = 10
N_CAND = 3


def record_table(spark, sf_dir):
    """Vectors keyed as rows ``idx__<vec_id>``, with their label."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("idx__"), F.col("vec_id").cast("string")).alias("key"), F.col("embedding").alias("vector"), "label", "vec_id"
    )


def half_of(spark, sf_dir):
    """Boundary between the two sources: half the rows."""
    return table(spark, sf_dir, "embeddings").count() // 2


def _total(sql: bool = False):
    """Sum of a vector's numbers."""
    if sql:
        return "round(CAST(list_sum(x) AS DOUBLE), 4) + 0.0 AS total"
    return (F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 4) + 0.0).alias("total")


_V = "v AS (SELECT 'idx__' || vec_id AS key, vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), half AS (SELECT count(*) // 2 AS n_items FROM embeddings)"
_COS = f"""{_V}, cosines AS (SELECT a.key, b.key AS nbr, a.vec_id AS key_no, b.vec_id AS nbr_no, round(list_cosine_similarity(a.x, b.x), 9) AS score FROM v a JOIN v b ON a.key <> b.key),
near AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, nbr) AS rank FROM cosines QUALIFY rank <= {K_NEAR})"""


@query("knn_cosine", f"WITH {_COS} SELECT key, nbr, {rounded('score')} AS score, rank FROM near")
def knn_cosine(spark, sf_dir):
    return K.knn(record_table(spark, sf_dir), k=K_NEAR)


@query("knn_pruned", f"WITH {_COS} SELECT key, nbr, {rounded('score')} AS score, rank FROM near")
def knn_pruned(spark, sf_dir):
    """The same search with small blocks, so that cells and bounds come into play."""
    return K.knn(record_table(spark, sf_dir), k=K_NEAR, block_rows=64)


@query("knn_tree", f"WITH {_COS} SELECT key, nbr, {rounded('score')} AS score, rank FROM near")
def knn_tree(spark, sf_dir):
    """The same search with few pivots a cell, so that large cells are cut into cells of their own."""
    return K.knn(record_table(spark, sf_dir), k=K_NEAR, block_rows=16, max_pivots=8)


_L2 = f"""{_V}, l2s AS (SELECT a.key, b.key AS nbr, round(pow(list_distance(a.x, b.x), 2), 9) AS score FROM v a JOIN v b ON a.key <> b.key),
near_l2 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, nbr) AS rank FROM l2s QUALIFY rank <= {K_NEAR})"""


@query("knn_l2", f"WITH {_L2} SELECT key, nbr, {rounded('score')} AS score, rank FROM near_l2")
def knn_l2(spark, sf_dir):
    return K.knn(record_table(spark, sf_dir), k=K_NEAR, metric="l2")


@query("knn_floor", f"WITH {_COS} SELECT key, nbr, {rounded('score')} AS score, row_number() OVER (PARTITION BY key ORDER BY score DESC, nbr) AS rank FROM cosines WHERE score > 0.3 QUALIFY rank <= 5")
def knn_floor(spark, sf_dir):
    return K.record_neighbours(record_table(spark, sf_dir), 5, floor=0.3)


_MIXED = f"""WITH {_V}, named AS (SELECT CASE WHEN label < 5 THEN key ELSE 'tt__' || vec_id END AS key, x FROM v),
pairs AS (SELECT a.key, b.key AS nbr, round(list_cosine_similarity(a.x, b.x), 9) AS score FROM named a JOIN named b ON a.key <> b.key WHERE a.key LIKE 'idx%'),
first_50 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, nbr) AS place FROM pairs QUALIFY place <= 50)
SELECT key, nbr, {rounded('score')} AS score, row_number() OVER (PARTITION BY key ORDER BY place) AS rank FROM first_50 WHERE score > 0.2 AND nbr LIKE 'idx%' QUALIFY rank <= 5"""


def _mixed_vectors(spark, sf_dir):
    """Half of the labels as rows, the others as tokens."""
    records = record_table(spark, sf_dir)
    token = F.concat(F.lit("tt__"), F.col("vec_id").cast("string"))
    return records.withColumn("key", F.when(F.col("label") < 5, F.col("key")).otherwise(token))


@query("knn_mixed", _MIXED)
def knn_mixed(spark, sf_dir):
    mixed = _mixed_vectors(spark, sf_dir)
    return K.mixed_neighbours(mixed, K.record_vectors(mixed), 5, floor=0.2)


@query("record_vectors", f"WITH {_V} SELECT key, {_total(sql=True)} FROM v WHERE label < 5")
def record_vectors(spark, sf_dir):
    return K.record_vectors(_mixed_vectors(spark, sf_dir)).select("key", _total())


@query("knn_approximate")
def knn_approximate(spark, sf_dir):
    return K.knn(record_table(spark, sf_dir), k=K_NEAR, block_rows=64, probes=4)


@query("knn_recall", f"WITH {_COS} SELECT key, count(*) AS n_near, (SELECT count(*) FROM near) AS n_all, TRUE AS recall_reached FROM near GROUP BY key")
def knn_recall(spark, sf_dir):
    """Approximate search with as many probes as a sample needs for 0.95: is the recall over all vectors 0.9?"""
    records = record_table(spark, sf_dir)
    probes = K.probes_for(records, k=K_NEAR, block_rows=16)
    return K.recall(K.knn(records, k=K_NEAR, block_rows=16, probes=probes), K.knn(records, k=K_NEAR)).select(
        "key", "n_near", "n_all", (F.col("recall_all") >= 0.9).alias("recall_reached"))


@query("index_extension", f"WITH {_V} SELECT key, {_total(sql=True)} FROM v")
def index_extension(spark, sf_dir):
    records = record_table(spark, sf_dir).select("key", "vector", "label")
    return K.extend_index(records.filter("label < 5").drop("label"), records.drop("label")).select("key", _total())


_CAND = f"""{_COS},
cand AS (SELECT key, nbr, key_no, nbr_no, score, row_number() OVER (PARTITION BY key ORDER BY rank) AS rank FROM near, half
  WHERE (key_no < n_items) <> (nbr_no < n_items) QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank) <= {N_CAND}),
mutual AS (SELECT c.* FROM cand c JOIN cand d ON c.key = d.nbr AND c.nbr = d.key WHERE d.rank <= {N_TOP})"""


def candidates(spark, sf_dir):
    near = K.knn(record_table(spark, sf_dir), k=N_TOP)
    return M.cross_source_candidates(near, half_of(spark, sf_dir), N_CAND)


@query("cross_source_candidates", f"WITH {_CAND} SELECT key, nbr, {rounded('score')} AS score, rank FROM cand")
def cross_source_candidates(spark, sf_dir):
    return candidates(spark, sf_dir)


@query("mutual_knn", f"WITH {_CAND} SELECT key, nbr, {rounded('score')} AS score, rank FROM mutual")
def mutual_knn(spark, sf_dir):
    return M.mutual(candidates(spark, sf_dir), N_TOP)


@query("match_pairs", f"WITH {_CAND} SELECT DISTINCT least(key_no, nbr_no) AS lo, greatest(key_no, nbr_no) AS hi FROM cand")
def match_pairs(spark, sf_dir):
    return M.match_pairs(candidates(spark, sf_dir))


@query("source_filter", f"WITH {_COS} SELECT key, nbr, {rounded('score')} AS score FROM near WHERE nbr_no <= 100")
def source_filter(spark, sf_dir):
    return M.from_source(K.knn(record_table(spark, sf_dir), k=K_NEAR), 100).select("key", "nbr", "score")


# --- similarity lists: events of a user give scored neighbours, many with the same pair --------

_PAIRS = """pairs AS (SELECT 'idx__' || user_id AS id, 'idx__' || (CAST(json_extract(props, '$.k') AS BIGINT) + 1000) AS word,
  value AS score, event_id AS seq FROM events),
both_ends AS (SELECT id, word, score, seq FROM pairs UNION ALL SELECT word, id, score, seq FROM pairs),
first_seen AS (SELECT id, word, arg_min(score, seq) AS score FROM both_ends GROUP BY id, word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, word DESC) AS rank FROM first_seen QUALIFY rank <= 10)"""


def scored_pairs(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint") + 1000
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("idx__"), F.col("user_id").cast("string")).alias("id"),
        F.concat(F.lit("idx__"), k.cast("string")).alias("word"),
        F.col("value").alias("score"), F.col("event_id").alias("seq"),
    )


def event_list(spark, sf_dir, n=10):
    return M.similarity_list(M.symmetric(scored_pairs(spark, sf_dir)), n)


@query("symmetric_pairs", f"WITH {_PAIRS} SELECT id, word, {rounded('score')} AS score, seq FROM both_ends")
def symmetric_pairs(spark, sf_dir):
    return M.symmetric(scored_pairs(spark, sf_dir))


@query("similarity_list", f"WITH {_PAIRS} SELECT id, word, {rounded('score')} AS score, rank FROM ranked")
def similarity_list(spark, sf_dir):
    return event_list(spark, sf_dir)


_MERGED = """WITH pairs AS (SELECT 'idx__' || user_id AS id, 'idx__' || (CAST(json_extract(props, '$.k') AS BIGINT) + 1000) AS word, value AS score, event_id AS seq FROM events),
cut AS (SELECT count(*) // 2 AS at_event FROM events),
old_first AS (SELECT id, word, arg_min(score, seq) AS score FROM pairs, cut WHERE seq < at_event GROUP BY id, word),
old_list AS (SELECT id, word, score FROM old_first QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, word DESC) <= 10),
fresh AS (SELECT id, word, arg_min(score, seq) AS score FROM pairs, cut WHERE seq >= at_event AND (id, word) NOT IN (SELECT (id, word) FROM old_list) GROUP BY id, word),
merged AS (SELECT * FROM old_list UNION ALL SELECT * FROM fresh)"""


@query("similarity_merge", f"{_MERGED} SELECT id, word, {rounded('score')} AS score, row_number() OVER (PARTITION BY id ORDER BY score DESC, word DESC) AS rank FROM merged QUALIFY rank <= 10")
def similarity_merge(spark, sf_dir):
    pairs = scored_pairs(spark, sf_dir)
    cut = table(spark, sf_dir, "events").count() // 2
    old = M.similarity_list(pairs.filter(F.col("seq") < cut), 10)
    return M.merge_lists(old, pairs.filter(F.col("seq") >= cut), 10)


@query("similarity_top", f"WITH {_PAIRS} SELECT id, word, {rounded('score')} AS score, rank FROM ranked WHERE rank <= 5")
def similarity_top(spark, sf_dir):
    return M.top_entries(event_list(spark, sf_dir), 5)


@query("similarity_words", f"WITH {_PAIRS} SELECT id, word, rank FROM ranked WHERE rank <= 3")
def similarity_words(spark, sf_dir):
    return M.top_entries(event_list(spark, sf_dir), 3, with_score=False)


@query("similarity_arrays", f"WITH {_PAIRS} SELECT id, word, {rounded('score')} AS score, rank FROM ranked")
def similarity_arrays(spark, sf_dir):
    return M.flat_list(M.nested_list(event_list(spark, sf_dir)))


@query("common_neighbours", f"WITH {_PAIRS.replace('rank <= 10', 'rank <= 60')} SELECT a.word, {rounded('a.score')} AS score_a, {rounded('b.score')} AS score_b FROM ranked a JOIN ranked b ON a.word = b.word WHERE a.id = 'idx__3' AND b.id = 'idx__10'")
def common_neighbours(spark, sf_dir):
    return M.common_neighbours(event_list(spark, sf_dir, 60), "idx__3", "idx__10")


@query("beyond_source", f"WITH {_PAIRS} SELECT id, word, {rounded('score')} AS score, rank FROM ranked WHERE CAST(substr(id, 6) AS BIGINT) > 1000")
def beyond_source(spark, sf_dir):
    return M.beyond_source(event_list(spark, sf_dir), 1000)


# --- pairs and scores -----------------------------------------------------------------------


def label_truth(spark, sf_dir, cand=None):
    """Pairs across the sources: candidates of the same label, and row i with row i + half.

    Each row gives a bounded number of pairs, so the truth grows with the table and not faster.
    """
    cand = candidates(spark, sf_dir) if cand is None else cand
    half = half_of(spark, sf_dir)
    records = record_table(spark, sf_dir).select("key", "label", "vec_id")
    item = records.select(F.col("key"), F.col("label").alias("item_label"), F.col("vec_id").alias("item_no"))
    match = records.select(F.col("key").alias("nbr"), F.col("label").alias("match_label"))
    near = cand.join(item, "key").join(match, "nbr").filter((F.col("item_no") < half) & (F.col("item_label") == F.col("match_label")))
    across = item.filter(F.col("item_no") < half).withColumn("nbr", F.concat(F.lit("idx__"), (F.col("item_no") + half).cast("string")))
    linear = across.join(match, "nbr").filter((F.col("item_label") + F.col("match_label")) % 2 == 0)
    pairs = [x.select(F.col("key").alias("item"), F.col("nbr").alias("match")) for x in (near, linear)]
    return pairs[0].unionByName(pairs[1]).distinct()


_TRUTH = """truth AS (SELECT c.key AS item, c.nbr AS match, key_no AS item_no, nbr_no AS match_no FROM cand c JOIN v a ON c.key = a.key JOIN v b ON c.nbr = b.key, half
  WHERE key_no < n_items AND a.label = b.label
  UNION SELECT a.key, b.key, a.vec_id, b.vec_id FROM v a, half JOIN v b ON b.vec_id = a.vec_id + n_items WHERE a.vec_id < n_items AND (a.label + b.label) % 2 = 0)"""
_PREDICTED = f"""levels AS (SELECT *, dense_rank() OVER (PARTITION BY key ORDER BY round(score, 2) DESC) AS level FROM near),
predicted AS (SELECT DISTINCT least(key_no, nbr_no) AS lo, greatest(key_no, nbr_no) AS hi FROM levels WHERE level <= 2),
actual AS (SELECT DISTINCT least(item_no, match_no) AS lo, greatest(item_no, match_no) AS hi FROM truth)"""


def near_entries(spark, sf_dir):
    return K.knn(record_table(spark, sf_dir), k=K_NEAR).select(F.col("key").alias("id"), F.col("nbr").alias("word"), "score", "rank")


@query("pairs_truth", f"WITH {_CAND}, {_TRUTH} SELECT DISTINCT least(item_no, match_no) AS lo, greatest(item_no, match_no) AS hi FROM truth")
def pairs_truth(spark, sf_dir):
    return M.truth_pairs(label_truth(spark, sf_dir))


@query("pairs_predicted", f"WITH {_CAND}, {_TRUTH}, {_PREDICTED} SELECT lo, hi FROM predicted")
def pairs_predicted(spark, sf_dir):
    return M.predicted_pairs(near_entries(spark, sf_dir), 2, 2)


@query("correct_pairs", f"WITH {_CAND}, {_TRUTH}, {_PREDICTED} SELECT lo, hi FROM predicted INTERSECT SELECT lo, hi FROM actual")
def correct_pairs(spark, sf_dir):
    return V.correct_pairs(M.predicted_pairs(near_entries(spark, sf_dir), 2, 2), M.truth_pairs(label_truth(spark, sf_dir)))


@query(
    "prf",
    f"""WITH {_CAND}, {_TRUTH}, {_PREDICTED}, c AS (SELECT (SELECT count(*) FROM predicted) AS n_predicted, (SELECT count(*) FROM actual) AS n_actual,
  (SELECT count(*) FROM (SELECT lo, hi FROM predicted INTERSECT SELECT lo, hi FROM actual)) AS n_correct),
s AS (SELECT *, n_correct / n_predicted AS precision, n_correct / n_actual AS recall FROM c)
SELECT n_predicted, n_actual, n_correct, {rounded('precision')} AS precision, {rounded('recall')} AS recall,
  {rounded('coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)')} AS f1 FROM s""",
)
def prf(spark, sf_dir):
    return V.prf(M.predicted_pairs(near_entries(spark, sf_dir), 2, 2), M.truth_pairs(label_truth(spark, sf_dir)))


_JUDGED = f"""{_CAND}, {_TRUTH}, ids AS (SELECT item AS id FROM truth UNION SELECT match FROM truth),
judged AS (SELECT m.key, m.nbr, m.key IN (SELECT item FROM truth) AS known, (m.key, m.nbr) IN (SELECT (item, match) FROM truth) AS hit,
  m.nbr IN (SELECT id FROM ids) AS nbr_known FROM mutual m, half WHERE key_no < n_items)"""


@query(
    "er_report",
    f"""WITH {_JUDGED}, c AS (SELECT count(*) FILTER (known AND hit) AS n_correct, count(*) FILTER ((known OR nbr_known) AND NOT (known AND hit)) AS n_wrong,
  count(*) FILTER (known OR nbr_known) AS n_candidates, count(*) AS n_golden, (SELECT count(DISTINCT item) FROM truth) AS n_truth_items,
  (SELECT count(DISTINCT item) FROM truth WHERE item NOT IN (SELECT key FROM judged)) AS n_no_candidate FROM judged),
s AS (SELECT *, coalesce(n_correct / nullif(n_candidates, 0), 0) AS p, n_correct / n_truth_items AS r, coalesce(n_correct / nullif(n_golden, 0), 0) AS gp FROM c)
SELECT {rounded('p')} AS p, {rounded('r')} AS r, {rounded('coalesce(2 * p * r / nullif(p + r, 0), 0)')} AS f, {rounded('gp')} AS gp, {rounded('r')} AS gr,
  {rounded('coalesce(2 * gp * r / nullif(gp + r, 0), 0)')} AS gf, n_correct, n_wrong, n_candidates, n_golden, n_truth_items, n_no_candidate FROM s""",
)
def er_report(spark, sf_dir):
    keys = record_table(spark, sf_dir).select("key")
    cand = freeze(candidates(spark, sf_dir))
    return V.er_report(cand, keys, label_truth(spark, sf_dir, cand), half_of(spark, sf_dir), N_TOP)


@query("suspicious", f"WITH {_JUDGED} SELECT key AS id1, nbr AS id2 FROM judged WHERE (known OR nbr_known) AND NOT (known AND hit)")
def suspicious(spark, sf_dir):
    cand = freeze(candidates(spark, sf_dir))
    return V.suspicious_matches(cand, label_truth(spark, sf_dir, cand), half_of(spark, sf_dir), N_TOP)


# --- ranking agreement ----------------------------------------------------------------------


def _two_lists(spark, sf_dir):
    """The lists of one key by cosine and by distance."""
    records = record_table(spark, sf_dir)
    as_list = lambda near: near.select(F.col("key").alias("id"), F.col("nbr").alias("word"), "score", "rank")
    return as_list(K.knn(records, k=K_NEAR)), as_list(K.knn(records, k=K_NEAR, metric="l2"))


_COMMON = f"{_COS}, {_L2[len(_V) + 2:]}, common AS (SELECT a.key AS id, a.nbr AS word, a.rank AS rank_a, b.rank AS rank_b FROM near a JOIN near_l2 b ON a.key = b.key AND a.nbr = b.nbr)"
_KENDALL = f"""{_COMMON}, discord AS (SELECT a.id, count(*) AS discordant FROM common a JOIN common b ON a.id = b.id AND a.rank_a < b.rank_a AND a.rank_b > b.rank_b GROUP BY a.id),
sizes AS (SELECT key AS id, coalesce(n, 0) AS n FROM (SELECT DISTINCT key FROM near) LEFT JOIN (SELECT id, count(*) AS n FROM common GROUP BY id) ON id = key),
taus AS (SELECT s.id, n AS n_common, coalesce(discordant, 0) AS discordant,
  CASE WHEN n >= 2 THEN (n * (n - 1) / 2.0 - 2 * coalesce(discordant, 0)) / (n * (n - 1) / 2.0) END AS tau FROM sizes s LEFT JOIN discord d ON s.id = d.id)"""


@query("common_labels", f"WITH {_COMMON} SELECT id, word, rank_a, rank_b FROM common")
def common_labels(spark, sf_dir):
    return V.common_entries(*_two_lists(spark, sf_dir))


@query("kendall_per_key", f"WITH {_KENDALL} SELECT id, n_common, discordant, {rounded('tau')} AS tau FROM taus")
def kendall_per_key(spark, sf_dir):
    return V.kendall(*_two_lists(spark, sf_dir)).select("id", "n_common", "discordant", "tau")


def _permutations() -> str:
    """CTEs ``perm<n> (i, c)``: how many permutations of n items have i inversions, and ``shares`` of all of them."""
    ctes = ["perm1 AS (SELECT 0 AS i, CAST(1 AS HUGEINT) AS c)"]
    for n in range(2, 11):
        ctes.append(f"perm{n} AS (SELECT i + j AS i, sum(c) AS c FROM perm{n - 1}, range({n}) r(j) GROUP BY 1)")
    every = " UNION ALL ".join(f"SELECT {n} AS n, i, c FROM perm{n}" for n in range(2, 11))
    ctes.append(f"shares AS (SELECT n, i, sum(c) OVER (PARTITION BY n ORDER BY i)::DOUBLE / sum(c) OVER (PARTITION BY n)::DOUBLE AS share FROM ({every}))")
    return ", ".join(ctes)


_TESTED = f"""{_KENDALL}, {_permutations()}, tested AS (SELECT id, n_common, discordant, tau,
  CASE WHEN n_common >= 2 THEN CASE WHEN 4 * discordant = n_common * (n_common - 1) THEN 1.0 ELSE least(1.0, 2 * share) END END AS p_value
  FROM taus LEFT JOIN shares ON n = n_common AND i = least(discordant, n_common * (n_common - 1) // 2 - discordant))"""


@query("kendall_significance", f"WITH {_TESTED} SELECT id, n_common, discordant, {rounded('tau')} AS tau, {rounded('p_value')} AS p_value FROM tested")
def kendall_significance(spark, sf_dir):
    """Lists have at most ten entries, so the SQL counts permutations."""
    return V.kendall(*_two_lists(spark, sf_dir))


@query(
    "kendall_summary",
    f"""WITH {_TESTED} SELECT {rounded('avg(tau)')} AS average_tau, count(*) FILTER (tau IS NULL) AS n_undefined,
count(*) FILTER (p_value < 0.5) AS n_significant, count(*) FILTER (p_value < 0.5 AND tau > 0) AS n_positive FROM tested""",
)
def kendall_summary(spark, sf_dir):
    return V.kendall_summary(V.kendall(*_two_lists(spark, sf_dir)))


# --- columns --------------------------------------------------------------------------------

_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "s_suppkey", "s_name", "s_nationkey", "s_acctbal"]


def column_profiles(spark, sf_dir):
    """A vector per column of customer and supplier: lengths and kinds of its values."""
    parts = None
    for name, prefix in (("customer", "c_"), ("supplier", "s_")):
        df = table(spark, sf_dir, name)
        cols = [c for c in _COLUMNS if c.startswith(prefix)]
        long = df.select(F.inline(F.array(*[F.struct(F.lit("cid__" + c).alias("key"), F.col(c).cast("string").alias("t")) for c in cols])))
        parts = long if parts is None else parts.unionByName(long)
    return parts.groupBy("key").agg(
        F.array(F.avg(F.length("t")), F.max(F.length("t")).cast("double"), F.avg(F.col("t").contains("#").cast("double")) * 10,
                F.avg(F.col("t").contains(".").cast("double")) * 10).alias("vector")
    )


_PROFILE = "t AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS key, CAST({c} AS VARCHAR) AS t FROM {'customer' if c.startswith('c_') else 'supplier'}" for c in _COLUMNS
) + """), prof AS (SELECT key, [avg(length(t)), CAST(max(length(t)) AS DOUBLE), avg(CASE WHEN contains(t, '#') THEN 10.0 ELSE 0.0 END),
  avg(CASE WHEN contains(t, '.') THEN 10.0 ELSE 0.0 END)] AS x FROM t GROUP BY key)"""


def column_truth(spark, sf_dir):
    pairs = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(f"c_{c}").alias("left_col"), F.lit(f"s_{c}").alias("right_col")) for c in ("name", "nationkey", "acctbal")])))
    return pairs


def _column_candidates(spark, sf_dir, truth=None):
    vectors = M.column_vectors(column_profiles(spark, sf_dir), truth)
    return M.column_candidates(vectors, _COLUMNS)


@query("column_vectors", f"WITH {_PROFILE} SELECT key, {_total(sql=True)} FROM prof WHERE key NOT LIKE '%custkey' AND key NOT LIKE '%suppkey'")
def column_vectors(spark, sf_dir):
    return M.column_vectors(column_profiles(spark, sf_dir), column_truth(spark, sf_dir)).select("key", _total())


@query(
    "schema_candidates",
    f"""WITH {_PROFILE} SELECT a.key AS left_col, b.key AS right_col, {rounded('1 - list_cosine_similarity(a.x, b.x)')} AS distance,
  row_number() OVER (PARTITION BY a.key ORDER BY 1 - list_cosine_similarity(a.x, b.x), b.key) AS rank
FROM prof a JOIN prof b ON left(a.key, 1) <> left(b.key, 1)""",
)
def schema_candidates(spark, sf_dir):
    return _column_candidates(spark, sf_dir).select("left_col", "right_col", "distance", "rank")


@query("schema_match")
def schema_match(spark, sf_dir):
    return M.match_columns(_column_candidates(spark, sf_dir))


@query("sm_report")
def sm_report(spark, sf_dir):
    truth = column_truth(spark, sf_dir)
    return V.sm_report(M.match_columns(_column_candidates(spark, sf_dir, truth)), truth)


# --- quality of vectors ---------------------------------------------------------------------


def quality_tests(spark, sf_dir):
    """All rows in groups of three of one label, from each run of 100 rows, each with one row of the next label.

    What is left over of a label makes a smaller group; after the last label of a run comes its first. Runs
    of one label have no tests. The file name follows the label. No group is larger than a run.
    """
    numbered = record_table(spark, sf_dir).withColumn("run", F.floor(F.col("vec_id") / 100)).withColumn(
        "place", F.row_number().over(Window.partitionBy("label", "run").orderBy("vec_id"))
    )
    groups = numbered.groupBy("label", "run", F.floor((F.col("place") - 1) / 3).alias("third")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "key"))), lambda e: e["key"]).alias("same")
    )
    labels = Window.partitionBy("run").orderBy("label")
    odd = F.coalesce(F.lead("key").over(labels), F.first("key").over(labels.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    other = numbered.filter("place = 1").select("label", "run", "key", odd.alias("odd")).filter("odd <> key").drop("key")
    family = F.when(F.col("label") % 3 == 0, "nmr").when(F.col("label") % 3 == 1, "nmcon").otherwise("nmc")
    return groups.join(other, ["label", "run"]).select(
        F.concat_ws("#", "label", "run", "third").alias("test_id"), F.concat(family, F.lit("-"), F.col("label").cast("string")).alias("file"),
        F.array_append("same", F.col("odd")).alias("terms"), F.col("odd").alias("expected"),
    )


_TESTS = f"""{_V}, u AS (SELECT key, list_transform(x, lambda e: e / sqrt(list_dot_product(x, x))) AS x FROM v),
numbered AS (SELECT key, label, vec_id, vec_id // 100 AS g, row_number() OVER (PARTITION BY label, vec_id // 100 ORDER BY vec_id) AS rn FROM v),
groups AS (SELECT label, g, (rn - 1) // 3 AS third, list(key ORDER BY vec_id) AS same FROM numbered GROUP BY 1, 2, 3),
odds AS (SELECT label, g, key AS own, coalesce(lead(key) OVER (PARTITION BY g ORDER BY label), first_value(key) OVER (PARTITION BY g ORDER BY label)) AS key FROM numbered WHERE rn = 1),
tests AS (SELECT a.label || '#' || a.g || '#' || third AS test_id, CASE a.label % 3 WHEN 0 THEN 'nmr' WHEN 1 THEN 'nmcon' ELSE 'nmc' END || '-' || a.label AS file,
  list_append(same, b.key) AS terms, b.key AS expected FROM groups a JOIN odds b ON b.label = a.label AND b.g = a.g AND b.key <> b.own),
parts AS (SELECT test_id, unnest(terms) AS key FROM tests), found AS (SELECT test_id, p.key, x FROM parts p JOIN u ON u.key = p.key),
centre AS (SELECT test_id, i, avg(x[i]) AS m FROM found, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
close AS (SELECT f.test_id, f.key, round(sum(f.x[i] * m), 9) AS closeness FROM found f JOIN centre c ON f.test_id = c.test_id GROUP BY 1, 2),
answers AS (SELECT test_id, key AS answer FROM close QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY closeness, key) = 1),
judged AS (SELECT t.*, answer, CASE split_part(file, '-', 1) WHEN 'nmr' THEN 'rows' WHEN 'nmcon' THEN 'concepts' ELSE 'columns' END AS family,
  CASE WHEN answer = expected THEN 1 ELSE 0 END AS hit FROM tests t LEFT JOIN answers a ON t.test_id = a.test_id)"""


@query("odd_one_out", f"WITH {_TESTS} SELECT test_id, file, array_to_string(terms, ' ') AS terms, expected, answer FROM judged")
def odd_one_out(spark, sf_dir):
    return V.odd_one_out(quality_tests(spark, sf_dir), record_table(spark, sf_dir))


@query(
    "eq_report",
    f"""WITH {_TESTS}, fam AS (SELECT family, count(*) AS n, sum(hit) AS c FROM judged GROUP BY family)
SELECT 'file' AS level, family, file, count(*) AS n_tests, CAST(sum(hit) AS BIGINT) AS n_correct, {rounded('sum(hit) * 100.0 / count(*)')} AS accuracy FROM judged GROUP BY family, file
UNION ALL SELECT 'family', family, NULL, n, CAST(c AS BIGINT), {rounded('c * 100.0 / n')} FROM fam
UNION ALL SELECT 'all', NULL, NULL, CAST(sum(n) AS BIGINT), CAST(sum(c) AS BIGINT), {rounded('avg(c * 100.0 / n)')} FROM fam""",
)
def eq_report(spark, sf_dir):
    return V.eq_report(V.odd_one_out(quality_tests(spark, sf_dir), record_table(spark, sf_dir)))
