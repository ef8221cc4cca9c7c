"""Every query with SQL equals DuckDB on the small tables; the others return rows."""

import math
import os

import duckdb
import pytest

from framewarden.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    out = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in out.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(([plain(r[columns.index(c)]) for c in sorted(columns)] for r in out.fetchall()), key=repr)
    assert sorted(([plain(r[c]) for c in sorted(columns)] for r in rows), key=repr) == want
