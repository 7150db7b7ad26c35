"""Every registered query runs; those with SQL give the rows that DuckDB gives."""

import glob
import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__

QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return round(float(value), 6) if type(value).__name__ == "Decimal" else value


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    if name not in ORACLES:
        assert len(set(columns)) == len(columns)
        return
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    assert rows == sorted((tuple(map(plain, r)) for r in want.select(*(f'"{c}"' for c in columns)).fetchall()), key=repr)


def test_imports_without_a_session():
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], cwd=root).returncode == 0
