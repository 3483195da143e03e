"""Every registered query against its SQL equivalent in another engine."""

import duckdb
import pytest

from __spark_entry__ import entry
from promptledger.workload.oracles import ORACLES
from promptledger.workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "documents conversations events pages".split()


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def normalised(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


def test_every_query_has_an_equivalent():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, engine, name):
    df = QUERIES[name](spark, SF)
    result = engine.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    got, expected = normalised(df.collect(), df.columns), normalised(result.fetchall(), columns)
    assert got == expected and got


def test_entry_runs(spark):
    assert entry(spark).count() == 200
