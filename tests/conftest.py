"""One local session for all tests, and the comparison with DuckDB that the oracle tests use."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in sorted(Path(SF_DIR).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    """A value that compares equal across the two engines: floats to 9 digits, nested values as tuples."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, (bytearray, memoryview)):
        return bytes(value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    """Rows with columns by name, sorted; nested Spark rows become dicts."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    nested = lambda v: v.asDict(recursive=True) if hasattr(v, "asDict") else [nested(x) for x in v] if isinstance(v, list) else v
    return sorted((tuple(plain(nested(r[i])) for i in order) for r in rows), key=repr)


def assert_same(frame, relation) -> None:
    """Same columns and the same multiset of rows."""
    assert sorted(frame.columns) == sorted(relation.columns)
    ours, theirs = rows_of(frame.columns, frame.collect()), rows_of(relation.columns, relation.fetchall())
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert a == b
