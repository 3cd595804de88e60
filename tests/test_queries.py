"""Each query against its SQL in DuckDB, at the smallest scale."""

import os

import pytest

from readloom import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(rows):
    show = lambda v: None if v is None else str(bool(v)) if isinstance(v, bool) else str(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(str(show(v)) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{SF}/events.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    cur = duck.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == names
    want = [tuple(r[cols.index(n)] for n in names) for r in cur.fetchall()]
    assert plain(tuple(r[n] for n in names) for r in df.collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
