"""The corpus queries against their DuckDB statements."""

from __future__ import annotations

import pytest

from stratalog.llm import queries as llm

SQL = llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, sf, duck, same_rows, name):
    df = llm.queries()[name](spark, sf)
    other = duck.execute(SQL[name])
    columns = [c[0] for c in other.description]
    same_rows(df.columns, df.collect(), columns, other.fetchall())


def test_one_query_for_each_operator():
    names = [n for n in llm.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
