"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from sensorgate.plans import catalog

FOLDER = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def _text(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, str(FOLDER))
    cols = sorted(df.columns)
    got = sorted(tuple(_text(r[c]) for c in cols) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    want = sorted(tuple(_text(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(names) == cols
    assert got == want
