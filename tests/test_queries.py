"""Every registered query against its SQL on the smallest tables; streams against their batch twins' SQL."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import verify

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def core() -> list[str]:
    from streamroute.plans import broker, events, lifecycle, streams

    return [*broker.QUERIES, *events.QUERIES, *lifecycle.QUERIES, *streams.QUERIES]


@pytest.mark.parametrize("name", core())
def test_query(spark, con, name):
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    if name in (sql := entry.oracle_sql()):
        want = con.execute(sql[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert verify.canon(got) == verify.canon(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert not set(entry.oracle_sql()) - set(entry.queries())
