"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entries

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def ordered(rows, columns):
    by_name = sorted(range(len(columns)), key=columns.__getitem__)

    def cell(value):
        return None if isinstance(value, float) and math.isnan(value) else value

    rows = [tuple(cell(row[i]) for i in by_name) for row in rows]
    return sorted(rows, key=lambda row: [(v is None, str(v)) for v in row])


# Queries of the corpus operators have tests of their own.
NAMES = [name for name in entries.queries() if not name.startswith("op") and name != "pipeline"]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, sql, name):
    got = entries.queries()[name](spark, SF)
    want = sql.execute(entries.oracle_sql()[name])
    columns = [column[0] for column in want.description]
    assert sorted(got.columns) == sorted(columns)
    want = ordered(want.fetchall(), columns)
    assert want
    assert ordered(map(tuple, got.collect()), got.columns) == want


def test_entry(spark):
    assert entries.entry(spark).count() > 0
