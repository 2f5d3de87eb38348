"""Every registered query with SQL against DuckDB, and the others for rows."""

import glob
import os

import duckdb
import pytest

from signalspark.plans import catalog

SF = "/root/testdata/sf0.001"


def canonical(rows):
    def cell(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = got.collect()
    assert rows
    if name in catalog.ORACLES:
        want = con.sql(catalog.ORACLES[name])
        assert sorted(got.columns) == sorted(want.columns)
        want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({catalog.ORACLES[name]})")
        assert canonical(rows) == canonical(want.fetchall())
