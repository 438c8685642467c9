"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from panelspark.plans.registry import QUERIES, SQL

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    got = df.collect()
    assert got
    if name not in SQL:
        return
    r = duck.execute(SQL[name])
    columns, want = [d[0] for d in r.description], r.fetchall()
    order = sorted(columns)
    assert sorted(df.columns) == order and len(got) == len(want)
    a = sorted(([x[c] for c in order] for x in got), key=str)
    b = sorted(([x[columns.index(c)] for c in order] for x in want), key=str)
    assert all(same(p, q) for x, y in zip(a, b, strict=True) for p, q in zip(x, y, strict=True))
