"""Every query that has SQL gives the rows that the SQL gives, on the smallest tables."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def norm(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool):
        return None if v != v else f"{float(v):.9g}"
    return v if v is None else str(v).replace("+00:00", "")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(D):
        c.execute(f"create view {f[:-8]} as select * from '{D}/{f}'")
    return c


CORE = {k: v for k, v in entry.oracle_sql().items() if not (k[0] == "p" and k[1].isdigit())}


@pytest.mark.parametrize("name", sorted(CORE))
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, D)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = con.execute(CORE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in cur.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() == 100
