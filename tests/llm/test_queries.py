"""The registered queries: against their SQL where there is one, whole results where not."""

import duckdb
import pytest

import __spark_entry__ as entries
from tidemark.llm import queries as corpus

from test_queries import SF, TABLES, ordered

ROWS = {"op2_warc": "pages", "op12_prefix_trie": None}  # None: its rows are no table's


@pytest.mark.parametrize("name", list(corpus.queries()))
def test_registered_query(spark, name):
    sql = duckdb.connect()
    for table in TABLES:
        sql.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = entries.queries()[name](spark, SF)
    rows = got.collect()
    if source := ROWS.get(name, "documents"):
        assert len(rows) == sql.execute(f"SELECT count(*) FROM {source}").fetchone()[0]
    if name in entries.oracle_sql():
        want = sql.execute(entries.oracle_sql()[name])
        columns = [column[0] for column in want.description]
        assert sorted(got.columns) == sorted(columns)
        assert ordered(map(tuple, rows), got.columns) == ordered(want.fetchall(), columns)


def test_all_are_registered():
    assert [n for n in entries.queries() if n.startswith("op")] == list(corpus.queries())
    assert "pipeline" in entries.queries() and {int(n[2:].split("_")[0]) for n in corpus.queries()} == set(range(1, 14))
