from pyspark.sql import functions as F

from docweave.functions import text as T


def test_late_years_have_no_sign(spark):
    """Seconds of 9999-12-31 23:59:59, one later, and of two years far later, with the year first and last."""
    df = spark.createDataFrame([(0,), (253402300799,), (253402300800,), (900001 * 1000003,), (8999999999999,), (None,)], "s bigint").select(F.timestamp_seconds("s").alias("t"))
    block = lambda times: T.labelled_metadata({"create_time": F.col("t")}, "en", times, ("<m>", "</m>"))
    got = [tuple(r) for r in df.select(block("yyyy-MM-dd HH:mm:ss"), block("dd.MM.yyyy")).collect()]
    days = [("1970-01-01 00:00:00", "01.01.1970"), ("9999-12-31 23:59:59", "31.12.9999"), ("10000-01-01 00:00:00", "01.01.10000")]
    days += [("30489-12-24 11:46:43", "24.12.30489"), ("287168-08-24 15:59:59", "24.08.287168")]
    shown = lambda s: f"<m>\n  Created: {s}\n</m>"
    assert got[:5] == [tuple(map(shown, d)) for d in days]
    assert got[5] == ("", "")
