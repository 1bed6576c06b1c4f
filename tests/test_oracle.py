"""Every registered query of the library's own operators against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from tracelake.plans.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = sorted(p.stem for p in DATA.glob("*.parquet"))


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, (str, datetime.datetime)):
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return f"{float(x):.9g}"
    return str([plain(v) for v in x])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert sorted([plain(v) for v in r] for r in rows) == sorted([plain(r[k]) for k in order] for r in want.fetchall())
