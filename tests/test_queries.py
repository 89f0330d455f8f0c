"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from folioscan.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(([float(v) if isinstance(v, decimal.Decimal) else v for v in r] for r in rows), key=lambda r: [str(v) for v in r])


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLE])
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cur = duck.execute(catalog.ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    wanted = plain(tuple(r[k] for k in at) for r in cur.fetchall())
    assert plain(map(tuple, df.collect())) == wanted
    assert wanted
