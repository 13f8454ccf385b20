"""Every query that has SQL gives DuckDB's rows on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from planwright import plans
from planwright.sources.views import TABLES

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    cursor = duck.execute(plans.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted((repr(plain(tuple(r[c] for c in columns))) for r in df.collect()))
    assert got == sorted(repr(plain(r)) for r in cursor.fetchall())
