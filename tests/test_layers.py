import duckdb

from anomalake.plans.tables import MEASURES, layers
from anomalake.queries import ORACLE, QUERIES

LINES = "'/root/testdata/sf0.01/lineitem.parquet'"


def parted(path):
    """lineitem in four files that each hold some lines of nearly every order."""
    path.mkdir()
    for i in range(4):
        duckdb.sql(f"copy (select * from {LINES} where (l_linenumber + l_partkey) % 4 = {i}) to '{path}/part-{i}.parquet' (format parquet)")
    one = duckdb.connect()
    one.execute("set threads = 1")  # its sums follow the files' order then only
    one.execute(f"create view lineitem as select * from '{path}/*.parquet'")
    return one


def test_method_projections_equal_sql_where_orders_span_files(spark, tmp_path):
    cur = parted(tmp_path / "lineitem.parquet").execute(ORACLE["method_projections"])
    df = QUERIES["method_projections"](spark, str(tmp_path))
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    want = {r[0]: [r[i] for i in at] for r in cur.fetchall()}
    got = {r.image: list(r) for r in df.collect()}
    assert len(got) == len(want) and [k for k in want if got[k] != want[k]] == []


def test_layers_in_order_leave_out_nulls(spark, tmp_path):
    rows = [(1, 1.0, None, 0.1, 0.0), (1, None, None, 0.2, 0.0), (1, 2.0, None, 0.3, 0.0)]
    spark.createDataFrame(rows, "l_orderkey long, " + ", ".join(f"l_{c} double" for c in MEASURES)).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.layer: r.raw for r in layers(spark, str(tmp_path), in_order=True).collect()}
    assert got == {"quantity": 3.0, "extendedprice": None, "discount": 0.1 + 0.2 + 0.3, "tax": 0.0}
