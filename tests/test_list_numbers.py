import duckdb
from pyspark.sql import functions as F

from docweave import catalogue, catalogue_layout  # noqa: F401
from docweave.functions import marks as K


def test_long_list_numbers(spark):
    """Letters past ZZZZ, in both cases and all shapes."""
    df = spark.createDataFrame([(475_254,), (475_255,), (12_356_631,)], "n int")
    of = lambda scheme: [r.s for r in df.select(K.numbered(F.col("n"), scheme).alias("s")).collect()]
    assert of("alphaLcParenBoth") == ["(zzzz)", "(aaaaa)", "(aaaaaa)"] and of("alphaUcPlain") == ["ZZZZ", "AAAAA", "AAAAAA"]


def test_list_numbers_of_nulls_equal_sql(spark, tmp_path):
    rows = [(None, 5), (3, None), (0, 1), (-2, 7), (28, 50), (18_278, 2)]
    spark.createDataFrame(rows, "p_partkey bigint, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = [tuple(r) for r in catalogue.QUERIES["list_numbers"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"create view part as from '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(map(str, got)) == sorted(map(str, con.execute(catalogue.ORACLE_SQL["list_numbers"]).fetchall()))
