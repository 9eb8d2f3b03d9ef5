"""Every registered query of the engine against its DuckDB statement."""

from __future__ import annotations

import pytest

from stratalog import queries as core

QUERIES, SQL = core.queries(), core.oracle_sql()
#: Sequential or sampled algorithms that SQL cannot express; test_graph and test_operators hold them against other versions.
WITHOUT_SQL = {"compression_distance", "graph_min_cut", "graph_louvain", "graph_persistence"}


def test_all_that_sql_can_express_has_a_statement():
    assert set(QUERIES) - set(SQL) <= WITHOUT_SQL and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, sf, duck, same_rows, name):
    df = QUERIES[name](spark, sf)
    other = duck.execute(SQL[name])
    columns = [c[0] for c in other.description]
    same_rows(df.columns, df.collect(), columns, other.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as driver

    df = driver.entry(spark)
    assert df.columns and df.count() >= 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_the_engine_stands_without_the_corpus_operators(tmp_path):
    """A copy without the corpus folders and pipeline imports and registers the engine's own queries."""
    import shutil
    import subprocess
    import sys

    from .conftest import ROOT

    shutil.copytree(ROOT / "stratalog", tmp_path / "stratalog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
