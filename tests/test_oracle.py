"""Every registered query of the library's own operators against its SQL form, as the driver compares them."""

import math
from pathlib import Path

import duckdb
import pytest

from anomalake.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, float) else v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    assert got
    if name in ORACLE:
        cur = duck.execute(ORACLE[name])
        want, cols = cur.fetchall(), [d[0] for d in cur.description]
        assert sorted(df.columns) == sorted(cols)
        assert rows(df.columns, got) == rows(cols, want)
