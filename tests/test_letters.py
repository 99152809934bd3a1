import duckdb
from pyspark.sql import functions as F

from docweave import catalogue
from docweave.functions import text as T


def letters(n):
    out = ""
    while n > 0:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def test_letters_have_no_end(spark):
    """Both sides of each change in the number of letters, up to the largest bigint."""
    firsts = [sum(26**i for i in range(k + 1)) for k in range(14)]
    numbers = sorted({-5, 0, 475_254, 475_255, 2**53 + 1, 2**63 - 1} | {n + d for n in firsts for d in (-1, 0, 1, 25, 26)})
    df = spark.createDataFrame([(n,) for n in [*numbers, None]], "n bigint")
    got = [r.s for r in df.select(T.column_letter(F.col("n")).alias("s")).collect()]
    assert got == [*map(letters, numbers), None]


def test_sql_has_three_letters(spark):
    """column_letters' SQL equals the letters as far as three go; after ZZZ it begins again, so 18279 is AAA as 703 is."""
    sql = lambda n: duckdb.execute(catalogue.ORACLE_SQL["column_letters"].replace("from part", f"from (select {n} as p_partkey)")).fetchone()[1]
    assert all(sql(n) == letters(n) for n in (-1, 0, 1, 26, 27, 702, 703, 18_278))
    assert sql(18_279) == sql(703) == "AAA" and letters(18_279) == "AAAA"
