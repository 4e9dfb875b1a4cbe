"""Every query of the engine that has SQL, compared with DuckDB on the smallest data set."""

import glob
import math
import os

import duckdb
import pytest

from vectorloom import registry

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: None if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    a, b = canonical(got.columns, [tuple(r) for r in got.collect()]), canonical(columns, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=2e-6) if all(isinstance(v, (int, float)) for v in (*x, *y)) else x == y


def test_all_queries_are_whole():
    """Queries without SQL are those whose result SQL cannot state."""
    assert len(registry.ORACLES) > 0.75 * len(registry.QUERIES)
