"""Every registered query against its DuckDB oracle on the smallest tables (the driver's gate runs sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.oracle_check import TABLES, rows_of

from conftest import SMALL

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return c


def test_every_query_is_registered_with_a_callable():
    assert len(QUERIES) >= 100
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    cols = df.columns
    got = rows_of(cols, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    want = rows_of(dcols, cur.fetchall())
    assert sorted(cols) == sorted(dcols)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, name):
    rows = QUERIES[name](spark, SMALL).collect()
    assert rows and all(any(r[c] is not None for r in rows) for c in rows[0].__fields__)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert "f1" in df.columns
