"""Every registered query runs over whole tables and equals its SQL where it has one."""

import datetime as dt
import os

import pytest

import __spark_entry__ as entry_point

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DATE": "date", "DOUBLE": "double", "BOOLEAN": "boolean"}

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(entry_point.queries()))
def test_query(spark, tables, name):
    df = entry_point.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = ordered(df.select(*(f"`{c}`" for c in columns)).collect())
    sql = entry_point.oracle_sql().get(name)
    if sql is None:
        return
    quoted = ", ".join(f'"{c}"' for c in columns)
    result = tables.execute(f"SELECT {quoted} FROM ({sql})")
    kinds = {d[0]: TYPES.get(str(d[1])) for d in result.description}
    assert kinds == {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert rows == ordered(result.fetchall())
    assert not rows or not isinstance(rows[0][0], dt.datetime)


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
