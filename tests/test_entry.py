import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from vecquarry.queries import ORACLE, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def same(spark, con, name, queries, sql):
    got, want = queries[name](spark, DATA), con.sql(sql[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=repr)
    a, b = order(got.select(*[f"`{c}`" for c in columns]).collect()), order(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, rel=1e-9, abs=1e-9) if all(isinstance(v, float) for v in x) else x == y


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(ORACLE) <= set(QUERIES) and len(QUERIES) > 80


@pytest.mark.parametrize("name", ["knn_cosine", "knn_hamming", "query_stats", "ivf_search", "ivf_runs", "quantize_uint8", "fastest_at", "pareto_front", "radar_score", "difficulty_split", "holm", "order_positions", "events_sessions", "grid_runs", "dataset_names"])
def test_queries_agree_with_sql(spark, con, name):
    same(spark, con, name, QUERIES, ORACLE)
