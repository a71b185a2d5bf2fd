"""Every registered query against plain SQL on the same tables."""

import duckdb
import pytest

import __spark_entry__ as driver
from tendergrid import catalog, oracle

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def database(tables):
    with duckdb.connect() as connection:
        for name in NAMES:
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tables}/{name}.parquet')")
        yield connection


def ordered(rows):
    return sorted(rows, key=lambda row: [(value is None, str(value)) for value in row])


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(oracle.SQL)
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, database, name):
    rows = driver.queries()[name](spark, tables)
    columns = sorted(rows.columns)
    result = database.execute(driver.oracle_sql()[name])
    described = {column[0]: str(column[1]) for column in result.description}
    fetched = result.fetchall()
    order = [list(described).index(column) for column in columns]
    assert sorted(described) == columns
    assert {c: TYPES[t] for c, t in rows.dtypes} == described
    expected = [tuple(row[i] for i in order) for row in fetched]
    assert ordered(tuple(r) for r in rows.select(*columns).collect()) == ordered(expected)


def test_entry(spark):
    assert not driver.entry(spark).isEmpty()
