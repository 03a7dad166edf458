import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.operators import embed
from rowloom.operators.knn import knn
from rowloom.options import TrainOptions


@pytest.fixture(scope="module")
def walks(spark):
    """Two groups of words that never meet."""
    word = lambda g: F.concat(F.lit(g), (F.pmod(F.xxhash64("id", "i"), F.lit(6))).cast("string"))
    rows = spark.range(600).select("id", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("i"))
    group = F.when(F.col("id") % 2 == 0, word("left")).otherwise(word("right"))
    return rows.groupBy(F.col("id").cast("string").alias("walk_id")).agg(F.collect_list(group).alias("walk")).cache()


@pytest.mark.parametrize("changes", [{}, {"method": "CBOW"}, {"algorithm": "fasttext", "epochs": 4}])
def test_groups_are_told_apart(walks, changes):
    options = TrainOptions(**{**dict(dimensions=16, window=3, epochs=8, learning_rate=0.1, sampling_factor=0.0, walks_per_shard=200), **changes})
    model = embed.train(walks, options)
    vectors = embed.vectors(model, options)
    assert {r.key for r in vectors.collect()} == {f"{g}{i}" for g in ("left", "right") for i in range(6)}
    near = knn(vectors, k=4).collect()
    same = np.mean([r.key[:-1] == r.nbr[:-1] for r in near])
    assert same > 0.9
    if options.algorithm == "fasttext":
        unknown = embed.subword_vectors(walks.sparkSession.createDataFrame([("left9",)], "key string"), model, options)
        assert unknown.count() == 1


def test_rare_words_and_warm_start(spark, walks):
    options = TrainOptions(dimensions=8, window=2, epochs=1)
    first = embed.train(walks.filter("cast(walk_id as int) % 2 = 0"), options)
    before = {r.key: r.vector for r in embed.vectors(first, options).collect()}
    more = spark.createDataFrame([("x", ["new", "new", "left1", "once"])], "walk_id string, walk array<string>")
    second = {r.key: r.vector for r in embed.vectors(embed.train(more, options, first), options).collect()}
    assert set(second) == set(before) | {"new"}
    assert second["left2"] == before["left2"]
    assert embed.empty_model(spark).count() == 0


def test_pca_keeps_the_variance(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 6)) + 5
    df = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(m)], "key string, vector array<double>")
    reduced = np.array([r.vector for r in embed.reduce_dimensions(df, 2).collect()])
    assert abs(reduced.var(0).sum() / m.var(0).sum() - 1) < 1e-3


@pytest.mark.parametrize("rate", [0.025, 0.1])
def test_learns_alike_with_any_number_of_shards(spark, rate):
    word = lambda g: F.concat(F.lit(g), (F.pmod(F.xxhash64("id", "i"), F.lit(60))).cast("string"))
    rows = spark.range(1500).select("id", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("i"))
    group = F.when(F.col("id") % 2 == 0, word("left")).otherwise(word("right"))
    walks = rows.groupBy(F.col("id").cast("string").alias("walk_id")).agg(F.collect_list(group).alias("walk")).cache()
    for walks_per_shard in (1500, 150, 15):
        options = TrainOptions(dimensions=32, epochs=3, learning_rate=rate, sampling_factor=0.0, walks_per_shard=walks_per_shard)
        found = embed.vectors(embed.train(walks, options), options).toPandas()
        m = np.array(found["vector"].tolist())
        assert np.isfinite(m).all()
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        near = m @ m.T
        np.fill_diagonal(near, -9)
        side = found["key"].str[0].to_numpy()
        assert (side == side[near.argmax(1)]).mean() > 0.95
