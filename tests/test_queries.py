"""Every registered query against its SQL in an independent engine, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from quillon.session import TABLES
from tools.compare import table

SF = "/root/testdata/sf0.001"
OWN = sorted(set(entry.queries()) - set(entry.LLM_QUERIES))  # the others have their tests beside their code


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def test_every_query_has_its_sql():
    assert set(OWN) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(entry.oracle_sql()[name])
    assert got == table([d[0] for d in result.description], result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
