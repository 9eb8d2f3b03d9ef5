from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from stratalog.session import local_session

    session = local_session(os.environ.get("TEST_CPUS", "*"), 4, **{"spark.driver.memory": "4g", "spark.default.parallelism": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    """The smallest of the driver's tables."""
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for path in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def plain(value):
    """Comparable form of a cell from Spark, DuckDB or Pandas."""
    if value is None or value != value:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, list | tuple) or type(value).__name__ == "ndarray":
        return tuple(plain(x) for x in value)
    if type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return value


@pytest.fixture(scope="session")
def same_rows():
    """Whether two sets of (columns, rows) hold the same rows, in any order of rows and columns."""

    def check(columns, rows, other_columns, other_rows):
        assert sorted(columns) == sorted(other_columns)

        def form(names, data):
            order = sorted(range(len(names)), key=names.__getitem__)
            return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)

        a, b = form(list(columns), rows), form(list(other_columns), other_rows)
        assert len(a) == len(b)
        assert a == b

    return check
