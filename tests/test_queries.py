"""Every query with SQL gives the same rows in DuckDB."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from larkspur.plans import catalog

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    rows = df.collect()
    if name not in catalog.SQL:
        assert rows  # held against plain Python in test_operators.py and test_more_operators.py
        return
    want = tables.sql(catalog.SQL[name])
    columns, found = want.columns, want.fetchall()
    assert sorted(columns) == sorted(df.columns)
    names = sorted(columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in rows)
    assert got == sorted(repr([plain(r[columns.index(c)]) for c in names]) for r in found)
