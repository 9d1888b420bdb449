from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import verify
from streamroute.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", [*queries.QUERIES])
def test_query(spark, name):
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    if name in queries.SQL:
        con = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            con.execute(f"create view {p.stem} as select * from '{p}'")
        assert verify.canon(got) == verify.canon(con.execute(queries.SQL[name]).df())
    assert len(got)


def test_the_rest_doesnt_import_the_subpackage():
    root = Path(entry.__file__).parent / "streamroute"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "streamroute.llm" not in p.read_text()
