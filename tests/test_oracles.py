"""A sample of the registered queries next to their SQL; ``tools/check_oracles.py`` runs them all."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from check_oracles import compare  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
SAMPLE = ["edge_list", "edge_list_tokens", "dict_codes", "adjacency", "walks_weighted", "walks_hidden_nodes", "knn_pruned", "er_report",
          "similarity_merge", "kendall_per_key", "eq_report", "count_sliding", "stream_windows", "similarity_upsert"]

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test data not here")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    status, _, _, note = compare(spark, con, str(DATA), name)
    assert status == "ok", note


def test_contract(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).count() == 1
