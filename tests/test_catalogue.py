import glob
import os

import duckdb
import pytest

from docweave import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = db.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    rows = lambda rs: sorted(map(str, rs))
    assert rows(tuple(r) for r in df.select(*names).collect()) == rows(want.fetchall())
