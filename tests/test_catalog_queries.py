"""Every registered query against its check SQL."""

from __future__ import annotations

import os

import duckdb
import pytest
from catalog.oracles import ORACLES
from catalog.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the fixed tables are not here")


@pytest.fixture(scope="module")
def base():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda row: [(value is None, str(value)) for value in row])


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_check_sql(spark, base, name):
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    rows = [tuple(row) for row in found.select(*[f"`{c}`" for c in columns]).collect()]
    if name not in ORACLES:
        assert rows
        return
    expected = base.execute(ORACLES[name])
    names = [c[0] for c in expected.description]
    assert sorted(names) == columns
    assert ordered(rows) == ordered(tuple(row[names.index(c)] for c in columns) for row in expected.fetchall())
