"""Embeddings trained on walks, on as many tasks as there are shards of walks.

Every shard holds a bounded number of walks. It receives, by a join, only the vectors of the words
in its own walks, runs skip-gram or CBOW updates with negative sampling on them, and returns what
it changed. A grouped mean, weighted by how often a shard used the word, makes the next model. The
model is a table all the way: neither the driver nor any task ever holds the whole vocabulary.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.options import TrainOptions
from rowloom.session import freeze, large

MODEL_SCHEMA = "kind string, key string, vector array<float>, context array<float>, occurrences bigint"
_BATCH = 2048


def empty_model(spark: SparkSession) -> DataFrame:
    """The model before the first window of a stream."""
    return spark.createDataFrame([], MODEL_SCHEMA)


def vocabulary(walks: DataFrame, min_count: int = 2) -> DataFrame:
    words = walks.select(F.explode("walk").alias("key"))
    return words.groupBy("key").agg(F.count(F.lit(1)).alias("occurrences")).filter(F.col("occurrences") >= min_count)


def keep_probability(vocab: DataFrame, sampling_factor: float) -> DataFrame:
    """Chance that one occurrence of a word is used; frequent words are used less."""
    if sampling_factor <= 0:
        return vocab.withColumn("keep", F.lit(1.0))
    total = vocab.agg(F.sum("occurrences").alias("total"))
    ratio = F.lit(float(sampling_factor)) * F.col("total") / F.col("occurrences")
    return (
        vocab.join(F.broadcast(total), F.lit(True))  # one row
        .withColumn("keep", F.least(F.lit(1.0), F.sqrt(ratio) + ratio))
        .drop("total")
    )


def subwords(word: Column, opts: TrainOptions) -> Column:
    """Hashed character n-grams of ``<word>``, as keys of gram rows."""
    padded = F.concat(F.lit("<"), word, F.lit(">"))
    sizes = F.array(*[F.lit(n) for n in range(opts.subword_min, opts.subword_max + 1)])
    grams = F.flatten(
        F.transform(
            sizes,
            lambda n: F.when(
                F.length(padded) >= n,
                F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, n)),
            ).otherwise(F.array().cast("array<string>")),
        )
    )
    bucket = lambda g: F.pmod(F.xxhash64(g), F.lit(opts.subword_buckets)).cast("string")
    return F.array_distinct(F.transform(grams, bucket))


def _initial(keys: DataFrame, kind: str, opts: TrainOptions) -> DataFrame:
    """Small hash-made vectors, the same for a key in every run."""
    size = opts.dimensions
    vector = F.transform(
        F.sequence(F.lit(1), F.lit(size)),
        lambda i: ((F.pmod(F.xxhash64("key", i, F.lit(opts.seed)), F.lit(1 << 20)) / float(1 << 20) - 0.5) / size).cast("float"),
    )
    context = F.array_repeat(F.lit(0.0).cast("float"), size) if kind == "token" else F.lit(None).cast("array<float>")
    return keys.select(F.lit(kind).alias("kind"), "key", vector.alias("vector"), context.alias("context"), "occurrences")


def _grown_model(vocab: DataFrame, model: DataFrame | None, opts: TrainOptions) -> DataFrame:
    """The model with rows for the words (and grams) it does not hold yet."""
    wanted = _initial(vocab, "token", opts)
    if opts.algorithm == "fasttext":
        grams = vocab.select(F.explode(subwords(F.col("key"), opts)).alias("key"))
        counted = grams.groupBy("key").agg(F.count(F.lit(1)).alias("occurrences"))
        wanted = wanted.unionByName(_initial(counted, "gram", opts))
    if model is None:
        return wanted
    return model.unionByName(wanted.join(large(model.select("kind", "key")), ["kind", "key"], "left_anti"))


def train(walks: DataFrame, opts: TrainOptions, model: DataFrame | None = None) -> DataFrame:
    """Train on ``walk_id, walk`` and return the model table; ``model`` is where to go on from.

    New words need ``min_count`` occurrences in these walks. Words of an earlier model that do not
    occur here keep their vectors.
    """
    walks = freeze(walks.select("walk_id", "walk"))
    vocab = keep_probability(vocabulary(walks, opts.min_count), opts.sampling_factor)
    if model is not None:
        # words known from before count as vocabulary at any frequency
        known = vocabulary(walks, 1).join(large(model.filter("kind = 'token'").select("key")), "key", "left_semi")
        vocab = keep_probability(
            vocabulary(walks, opts.min_count).unionByName(known).distinct(), opts.sampling_factor
        )
    vocab = freeze(vocab)
    current = freeze(_grown_model(vocab, model, opts))

    n_shards = max(1, math.ceil(walks.count() / opts.walks_per_shard))
    shard = F.pmod(F.xxhash64("walk_id"), F.lit(n_shards)).cast("int").alias("shard")
    sharded = walks.select(shard, "walk_id", "walk")
    local = sharded.select("shard", F.explode("walk").alias("key")).distinct().join(large(vocab), "key")
    if opts.algorithm == "fasttext":
        tokens = local.select("shard", F.lit("token").alias("kind"), "key", "occurrences", "keep",
                              subwords(F.col("key"), opts).alias("features"))
        grams = tokens.select("shard", F.explode("features").alias("key")).distinct().select(
            "shard", F.lit("gram").alias("kind"), "key", F.lit(0).cast("bigint").alias("occurrences"),
            F.lit(1.0).alias("keep"), F.lit(None).cast("array<string>").alias("features"))
        local = tokens.unionByName(grams)
    else:
        local = local.select("shard", F.lit("token").alias("kind"), "key", "occurrences", "keep",
                             F.lit(None).cast("array<string>").alias("features"))
    local = freeze(local)
    for epoch in range(opts.epochs):
        current = freeze(_epoch(sharded, local, current, opts, epoch))
    return current


def _epoch(sharded: DataFrame, local: DataFrame, model: DataFrame, opts: TrainOptions, epoch: int) -> DataFrame:
    rate = opts.learning_rate * (1 - epoch / max(1, opts.epochs))
    vectors = model.select("kind", "key", "vector", "context")
    loaded = local.join(large(vectors), ["kind", "key"]).withColumnRenamed("shard", "part")

    def update(key, walks: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        return _train_shard(walks, words, opts, rate, seed=hash((opts.seed, epoch, int(key[0]))) % (2**32))

    updates = (
        sharded.groupBy("shard")
        .cogroup(loaded.groupBy("part"))
        .applyInPandas(update, "kind string, key string, vector array<float>, context array<float>")
    )
    total = lambda c: vector_to_array(Summarizer.sum(array_to_vector(F.col(c))), "float32")
    merged = updates.filter("kind = 'token'").groupBy("kind", "key").agg(total("vector").alias("v"), total("context").alias("c"))
    if opts.algorithm == "fasttext":
        grams = updates.filter("kind = 'gram'").groupBy("kind", "key").agg(
            total("vector").alias("v"), F.lit(None).cast("array<float>").alias("c"))
        merged = merged.unionByName(grams)
    return model.join(large(merged), ["kind", "key"], "left").select(
        "kind", "key", _moved("vector", "v", opts.max_step).alias("vector"), _moved("context", "c", opts.max_step).alias("context"), "occurrences"
    )


def _moved(vector: str, step: str, longest: float) -> Column:
    """A vector after the sum of the shards' steps, which is cut to the length ``longest``."""
    length = F.sqrt(F.aggregate(step, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    scale = F.least(F.lit(1.0), F.lit(longest) / F.greatest(length, F.lit(1e-30)))
    moved = F.zip_with(vector, step, lambda x, y: (x + y * scale).cast("float"))
    return F.when(F.col(step).isNull(), F.col(vector)).otherwise(moved)


def _train_shard(walks: pd.DataFrame, words: pd.DataFrame, opts: TrainOptions, rate: float, seed: int) -> pd.DataFrame:
    """The sum of the gradient steps on the walks of one shard, with the words of that shard only."""
    columns = ["kind", "key", "vector", "context"]
    tokens = words[words["kind"] == "token"].sort_values("key").reset_index(drop=True)
    if walks.empty or tokens.empty:
        return pd.DataFrame({c: [] for c in columns})
    rng = np.random.default_rng(seed)
    grams = words[words["kind"] == "gram"].sort_values("key").reset_index(drop=True)
    n = len(tokens)
    w_in = np.array(tokens["vector"].tolist() + grams["vector"].tolist(), dtype=np.float32)
    w_out = np.array(tokens["context"].tolist(), dtype=np.float32)
    word_no = {w: i for i, w in enumerate(tokens["key"])}
    features = _feature_rows(tokens, grams, n)
    counts = tokens["occurrences"].to_numpy(dtype=np.float64)
    noise = np.cumsum(counts**0.75) / (counts**0.75).sum()
    keep = tokens["keep"].to_numpy()

    old_in, old_out = w_in.copy(), w_out.copy()
    for inputs, target in _examples(walks.sort_values("walk_id")["walk"], word_no, keep, opts, rng):
        _update(w_in, w_out, features, inputs, target, noise, opts.negative, rate, opts.max_step, rng)
    return pd.DataFrame(
        {
            "kind": ["token"] * n + ["gram"] * len(grams),
            "key": list(tokens["key"]) + list(grams["key"]),
            "vector": list(w_in - old_in),
            "context": list(w_out - old_out) + [None] * len(grams),
        }
    )


def _feature_rows(tokens: pd.DataFrame, grams: pd.DataFrame, n: int) -> np.ndarray:
    """Rows of the input matrix that make up each word, padded with -1."""
    if grams.empty:
        return np.arange(n)[:, None]
    gram_no = {g: n + i for i, g in enumerate(grams["key"])}
    lists = [[i] + [gram_no[g] for g in f if g in gram_no] for i, f in enumerate(tokens["features"])]
    width = max(map(len, lists))
    return np.array([row + [-1] * (width - len(row)) for row in lists])


def _examples(walks, word_no: dict, keep: np.ndarray, opts: TrainOptions, rng):
    """Batches of (input words padded with -1, target word)."""
    inputs, targets, held = [], [], 0
    width = 1 if opts.method == "skipgram" else 2 * opts.window
    for walk in walks:
        ids = np.array([word_no[w] for w in walk if w in word_no], dtype=np.int64)
        ids = ids[rng.random(len(ids)) < keep[ids]]
        if len(ids) < 2:
            continue
        reach = rng.integers(1, opts.window + 1, len(ids))
        offsets = np.concatenate([np.arange(-opts.window, 0), np.arange(1, opts.window + 1)])
        at = np.arange(len(ids))[:, None] + offsets[None, :]
        valid = (at >= 0) & (at < len(ids)) & (np.abs(offsets)[None, :] <= reach[:, None])
        around = np.where(valid, ids[np.clip(at, 0, len(ids) - 1)], -1)
        if opts.method == "skipgram":
            rows, cols = np.nonzero(valid)
            inputs.append(ids[rows][:, None])
            targets.append(around[rows, cols])
        else:
            some = valid.any(1)
            inputs.append(around[some])
            targets.append(ids[some])
        held += len(targets[-1])
        if held >= 64 * _BATCH:
            yield from _shuffled(inputs, targets, width, rng)
            inputs, targets, held = [], [], 0
    if held:
        yield from _shuffled(inputs, targets, width, rng)


def _shuffled(inputs, targets, width, rng):
    inputs, targets = np.concatenate(inputs), np.concatenate(targets)
    order = rng.permutation(len(targets))
    for start in range(0, len(order), _BATCH):
        part = order[start : start + _BATCH]
        yield inputs[part].reshape(len(part), width), targets[part]


def _update(w_in, w_out, features, inputs, target, noise, negative, rate, longest, rng) -> None:
    """One step of logistic updates: the target against words drawn from the noise distribution."""
    rows = np.where(inputs[:, :, None] >= 0, features[inputs], -1).reshape(len(inputs), -1)
    mask = rows >= 0
    size = np.maximum(mask.sum(1), 1).astype(np.float32)
    hidden = (w_in[rows] * mask[:, :, None]).sum(1) / size[:, None]
    drawn = np.minimum(np.searchsorted(noise, rng.random((len(target), negative))), len(noise) - 1)
    outs = np.concatenate([target[:, None], drawn], axis=1)
    label = np.zeros(outs.shape, dtype=np.float32)
    label[:, 0] = 1
    usable = np.ones(outs.shape, dtype=np.float32)
    usable[:, 1:] = drawn != target[:, None]
    score = np.clip(np.einsum("bd,bkd->bk", hidden, w_out[outs]), -8, 8)
    error = (label - 1 / (1 + np.exp(-score))) * usable * np.float32(rate)
    back = np.einsum("bk,bkd->bd", error, w_out[outs])
    # many rows of a batch may hit one word: the length of their sum is limited to stay stable
    _scatter(w_out, outs.ravel(), (error[:, :, None] * hidden[:, None, :]).reshape(-1, hidden.shape[1]), longest)
    owner, _ = np.nonzero(mask)
    touched = rows[mask]
    _scatter(w_in, touched, back[owner] / size[owner][:, None] if mask.shape[1] > 1 else back[owner], longest)


def _scatter(matrix: np.ndarray, rows: np.ndarray, steps: np.ndarray, longest: float) -> None:
    """Add the steps to their rows; the sum of a row's steps is cut to the length ``longest``."""
    order = np.argsort(rows, kind="stable")
    rows, steps = rows[order], steps[order]
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    sums = np.add.reduceat(steps, starts, axis=0)
    length = np.sqrt((sums.astype(np.float64) ** 2).sum(1))
    matrix[rows[starts]] += sums * np.minimum(1.0, longest / np.maximum(length, 1e-30))[:, None].astype(np.float32)


def vectors(model: DataFrame, opts: TrainOptions) -> DataFrame:
    """``key, vector`` of all words; with sub-words the mean of the word's and its grams' vectors."""
    tokens = model.filter("kind = 'token'").select("key", "vector")
    if opts.algorithm != "fasttext":
        return tokens
    return _composed(tokens.select("key"), model, opts)


def _composed(words: DataFrame, model: DataFrame, opts: TrainOptions) -> DataFrame:
    parts = words.select(
        F.col("key").alias("word"),
        F.inline(
            F.concat(
                F.array(F.struct(F.lit("token").alias("kind"), F.col("key").alias("key"))),
                F.transform(subwords(F.col("key"), opts), lambda g: F.struct(F.lit("gram").alias("kind"), g.alias("key"))),
            )
        ),
    )
    found = parts.join(large(model.select("kind", "key", "vector")), ["kind", "key"])
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("vector"))), "float32")
    return found.groupBy("word").agg(mean.alias("vector")).withColumnRenamed("word", "key")


def subword_vectors(words: DataFrame, model: DataFrame, opts: TrainOptions) -> DataFrame:
    """Vectors for any words (``key``), also unknown ones, from their n-grams."""
    return _composed(words.select("key").distinct(), model, opts)


def reduce_dimensions(vector_table: DataFrame, n: int) -> DataFrame:
    """Principal components of the centred vectors; only a dims x dims matrix reaches the driver."""
    dense = vector_table.select("key", array_to_vector(F.col("vector")).alias("raw"))
    centred = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(dense).transform(dense)
    reduced = PCA(k=n, inputCol="centred", outputCol="reduced").fit(centred).transform(centred)
    return reduced.select("key", vector_to_array("reduced", "float32").alias("vector"))
