"""Every query of the library proper against its SQL, where the test tables are there."""

from pathlib import Path

import pytest

import __spark_entry__
from folioflow.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


def shown(value):
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return "null" if value is None else str(value)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    want = duck.execute(registry.SQL[name])
    names = sorted(c[0] for c in want.description)
    assert sorted(got.columns) == names
    order = [[c[0] for c in want.description].index(n) for n in names]
    assert sorted(tuple(shown(r[n]) for n in names) for r in got.collect()) == sorted(tuple(shown(r[i]) for i in order) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 15


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
