"""What a search holds and how many groups it compares don't grow with the number of blocks."""

import numpy as np
import pandas as pd
import pytest

from rowloom.operators import knn as K
from rowloom.operators import vector_cells as C


@pytest.fixture(scope="module")
def vectors(spark):
    m = np.random.default_rng(5).normal(size=(300, 6)).astype(np.float32)
    return spark.createDataFrame([(f"idx__{i}", [float(x) for x in v]) for i, v in enumerate(m)], "key string, vector array<float>").cache()


@pytest.mark.parametrize("pivots", [4096, 4])
def test_a_query_is_sent_once_per_group(spark, vectors, pivots):
    tree, right = C.build(vectors, "cosine", 3, pivots)
    asked = right.selectExpr("key", "vector", "block AS q_block", "block AS home", "CAST(NULL AS DOUBLE) AS worst")
    sent = tree.targets(asked, None, None, 1)
    # nothing is known, so all blocks are open: every query, once per parent that it went through, and not per block
    parents = 1 + sum(level.select("node").distinct().count() for level in tree.levels)
    assert sent.count() <= 300 * parents
    blocks = right.select("block").distinct().count()
    assert sent.selectExpr("key", "explode(t_blocks) AS b").join(right.selectExpr("block AS b").distinct(), "b").count() == 300 * (blocks - 1)


def test_visits_come_in_bounded_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    n = 50
    cells = C.Siblings("l2", np.arange(n), rng.normal(size=(n, 4)), np.zeros(n), np.full(n, 9.0), np.full(n, 2), np.zeros(n, bool))
    batch = pd.DataFrame({"key": [str(i) for i in range(64)], "vector": list(rng.normal(size=(64, 4))), "q_block": 0, "home": -1, "worst": np.nan})
    whole = pd.concat(cells.visits(batch, None, None, 3))
    monkeypatch.setattr(C, "TILE", 1000)
    pieces = list(cells.visits(batch, None, None, 3))
    assert max(p["t_blocks"].map(len).sum() for p in pieces) <= 1000 and len(pieces) == 7
    again = pd.concat(pieces)
    for name in ("t_groups", "starts", "counts", "t_blocks", "nodes"):
        assert [list(x) for x in again[name]] == [list(x) for x in whole[name]]


def test_a_block_that_holds_nothing_hides_no_other():
    corpus = pd.DataFrame({"key": ["a", "b"], "block": [3, 7], "vector": [[1.0, 0.0], [0.0, 1.0]]})
    queries = pd.DataFrame({"key": ["q"], "vector": [[1.0, 1.0]], "q_block": [0], "worst": [np.nan], "t_blocks": [np.array([3, 7, 9])]})
    assert sorted(K._search(queries, corpus, 5, "cosine", None)["nbr"]) == ["a", "b"]
