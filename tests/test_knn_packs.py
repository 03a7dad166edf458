"""An exact search, or one with many probes, writes nothing per pair of a query and a block."""

import os

import numpy as np
import pytest

from rowloom.operators import knn as K
from rowloom.operators import vector_packs as P
from rowloom.session import ensure_checkpoint_dir


def table(spark, m):
    rows = [(f"idx__{i}", [float(x) for x in v]) for i, v in enumerate(m.astype(np.float32))]
    return spark.createDataFrame(rows, "key string, vector array<float>").cache()


def written(spark):
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(top) for f in files)


def found(df):
    return sorted((r.key, r["rank"], r.nbr, round(r.score, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(5, 6))[rng.integers(0, 5, 260)] + 0.4 * rng.normal(size=(260, 6))
    m[::7] = m[3]  # copies
    m[11] = 0
    m[40:80] = np.round(m[40:80])  # ties
    return table(spark, m)


@pytest.fixture
def small(monkeypatch):
    """So few rows in a pack and packs in a task that many of them meet."""
    for name, value in (("ASKED_ROWS", 30), ("PACK_ROWS", 16), ("_TASK_PACKS", 3)):
        monkeypatch.setattr(P, name, value)


def test_disk_does_not_grow_with_blocks(spark):
    df = table(spark, np.random.default_rng(4).normal(size=(1800, 6)))
    ensure_checkpoint_dir(spark)
    before = written(spark)
    assert K.knn(df, k=3, block_rows=2, max_pivots=16).count() == 5400
    assert written(spark) - before < 1_400_000  # 2.9 MB with lists of blocks, 0.7 MB without


@pytest.mark.parametrize("metric, pivots, floor", [("cosine", 4096, None), ("cosine", 3, None), ("cosine", 3, 0.7), ("l2", 4096, None), ("l2", 3, None)])
def test_packs_find_what_one_block_holds(vectors, small, metric, pivots, floor):
    whole = K.knn(vectors, k=6, metric=metric, floor=floor)
    assert found(K.knn(vectors, k=6, metric=metric, floor=floor, block_rows=3, max_pivots=pivots)) == found(whole)


@pytest.mark.parametrize("pivots", [4096, 3])
def test_packs_find_what_is_found_in_blocks(vectors, small, monkeypatch, pivots):
    search = {"k": 5, "block_rows": 3, "max_pivots": pivots, "probes": 2}
    some = vectors.filter("key <> 'idx__11'")  # all pivots are equally near to it
    sent = found(K.knn(some, **search))
    monkeypatch.setattr(K, "_FEW_PROBES", 0)
    assert found(K.knn(some, **search)) == sent


def test_packs_of_another_table(vectors, small):
    a, b = vectors.filter("key like '%3'"), vectors.filter("key not like '%3'")
    assert found(K.knn(a, b, k=4, block_rows=3, max_pivots=3)) == found(K.knn(a, b, k=4))


def test_a_search_is_laid_out_once_for_all_trials(vectors, monkeypatch):
    calls = []
    build = K.build
    monkeypatch.setattr(K, "build", lambda *a: calls.append(1) or build(*a))
    assert K.probes_for(vectors, k=5, goal=0.999, n_sample=40, block_rows=6) > 1
    assert len(calls) == 1


@pytest.mark.parametrize("rows", [7, 260])
def test_slices_of_queries_meet_their_home(vectors, monkeypatch, rows):
    monkeypatch.setattr(K, "BLOCK_ROWS", rows)
    a, b = vectors.filter("key like '%1'"), vectors.filter("key not like '%1'")
    assert found(K.knn(b, a, k=4, block_rows=7)) == found(K.knn(b, a, k=4, block_rows=4096))
