"""Every signal query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from signalframe import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(v):
    if v is None or v != v:
        return None
    return round(v, 4) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in ("lineitem", "orders", "events", "embeddings", "nation", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(queries.SQL[name])
    assert sorted(rel.columns) == cols
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    a = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=key)
    b = sorted((tuple(norm(v) for v in r) for r in con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({queries.SQL[name]})").fetchall()), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and math.isclose(u, float(v), abs_tol=2e-4)), (x, y)
