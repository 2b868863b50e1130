"""Every registered query over the smallest tables, held against its SQL where it has one."""

import math
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables here")


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return "" if v is None else str(v)


def canonical(rows):
    return sorted("|".join(map(cell, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if sql := entry.oracle_sql().get(name):
        assert canonical(rows) == canonical(duck.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
