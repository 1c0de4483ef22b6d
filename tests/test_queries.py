"""Each query against its SQL over the smallest tables."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb
import pytest

from cuelake.plans.catalog import ORACLE_SQL, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "null" if math.isnan(x) else repr(round(x, 9) + 0.0)
    if isinstance(x, (list, tuple)):
        return str([plain(v) for v in x])
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return "null" if x is None else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    rows = sorted(tuple(map(plain, r)) for r in found.select([f"`{c}`" for c in columns]).collect())
    if name not in ORACLE_SQL:
        assert len(set(columns)) == len(columns)
        return
    result = sql.execute(ORACLE_SQL[name])
    assert sorted(d[0] for d in result.description) == columns
    order = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted(tuple(plain(r[k]) for k in order) for r in result.fetchall())
    assert rows == want
