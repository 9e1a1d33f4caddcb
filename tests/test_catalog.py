"""Every registered query of the engine against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from tessella.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLANS, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


def rows_of(rows, order):
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(type(x)), x) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, duck):
    df = PLANS[name](spark, SF)
    columns = sorted(df.columns)
    got = rows_of(df.collect(), [df.columns.index(c) for c in columns])
    found = duck.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = rows_of(found.fetchall(), [names.index(c) for c in columns])
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) < 2e-5 for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(ORACLES)))
def test_rows_without_sql(name, spark):
    assert PLANS[name](spark, SF).count() > 0
