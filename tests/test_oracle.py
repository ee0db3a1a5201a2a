"""Every query with SQL gives the same rows in DuckDB on the same files."""
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import compare, frame

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# fits whose single purpose is a model: one run each, rows only
LIGHT = ["ridge", "decision_tree_classifier", "train_many", "ar_forecast", "trend_season_forecast", "lowess_trend",
         "chunk_by_separator", "embed_text", "step_log", "smote", "feature_importance", "score_probabilities"]


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    for p in glob.glob(folder + "/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, folder, con):
    df = QUERIES[name](spark, folder)
    got = frame(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(SQL[name])
    want = frame([d[0] for d in cur.description], cur.fetchall())
    assert compare(got, want) is None


@pytest.mark.parametrize("name", LIGHT)
def test_gives_rows(name, spark, folder):
    assert QUERIES[name](spark, folder).count() > 0


def test_contract(spark):
    assert set(SQL) <= set(QUERIES)
    assert entry.entry(spark).count() > 0
