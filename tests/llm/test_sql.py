"""The llm queries that SQL can express, against it, as the driver compares them."""

import pytest

from anomalake.llm.queries import ORACLE, QUERIES
from tests.test_oracle import duck, rows  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE[name])
    want, cols = cur.fetchall(), [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, df.collect()) == rows(cols, want)
