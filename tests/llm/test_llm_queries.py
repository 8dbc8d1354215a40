import glob
import os

import duckdb
import pytest

from vecquarry.llm.oracle import ORACLE
from vecquarry.llm.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else round(float(v), 9) if isinstance(v, (int, float)) else v


@pytest.mark.parametrize("name", list(ORACLE))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = QUERIES[name](spark, DATA), con.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=repr)
    assert order(got.select(*columns).collect()) == order(want.project(", ".join(columns)).fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
