"""Display formats by the published format-code rules (sections, digit places, scaling commas, date parts)."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.functions.formats import format_cell, is_date, shown


@settings(max_examples=150, deadline=None)
@given(st.integers(-(10**9), 10**9))
def test_grouped_integers(n):
    assert shown(n, "#,##0") == f"{n:,}" and shown(n, "0") == str(n) and shown(abs(n), "000000") == f"{abs(n):06d}"


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**7))
def test_places_and_percent(n):
    assert shown(n / 8, "0.000") == f"{n / 8:.3f}"
    assert shown(n / 4, "0%") == f"{25 * n}%"


@settings(max_examples=150, deadline=None)
@given(st.dates(dt.date(1901, 1, 1), dt.date(2099, 12, 31)))
def test_serial_days(day):
    serial = (day - dt.date(1899, 12, 30)).days
    for value in (serial, dt.datetime(day.year, day.month, day.day)):
        assert shown(value, "yyyy-mm-dd") == day.isoformat()
        assert shown(value, "d/m/yy") == f"{day.day}/{day.month}/{day.year % 100:02d}"


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 86399))
def test_serial_times(second):
    time = (dt.datetime(2000, 1, 1) + dt.timedelta(seconds=second)).time()
    assert shown(dt.time(time.hour, time.minute, time.second), "hh:mm:ss") == time.isoformat()
    assert shown(dt.time(time.hour, time.minute), "h AM/PM").split() == [str(time.hour % 12 or 12), "AM" if time.hour < 12 else "PM"]


def test_sections_literals_and_scaling():
    code = '0.0;"minus "0.0;"none"'
    assert [shown(x, code) for x in (7.25, -3.5, 0)] == ["7.3", "minus 3.5", "none"]
    assert shown(8_450_000, "0.0,,") == "8.5" and shown(8_450_000, '#,##0,"k"') == "8,450k"
    assert shown(19, '"no. "0') == "no. 19" and shown("plain", "0.00") == "plain" and shown(None, "0.00") == ""


@pytest.mark.parametrize(("code", "want"), [("d mmm yyyy", True), ("mm:ss", True), ("[h]:mm:ss", True), ("0.00", False), ('"day "0', False), ("General", False), ("0.0E+00", False), ("# ?/?", False)])
def test_what_is_a_date(code, want):
    assert bool(is_date(code)) is want


def test_column(spark):
    rows = [(i / 4, c) for i in range(-6, 7) for c in ("0.00", "0%", None)] + [(None, "0.00")]
    df = spark.createDataFrame(rows, "v double, c string")
    got = df.select("v", "c", format_cell(F.col("v"), F.col("c")).alias("s")).collect()
    assert len(got) == len(rows) and all(r.s == (None if r.v is None else shown(r.v, r.c)) for r in got)


def test_queries_call_the_operator(spark):
    from docweave.catalogue import QUERIES

    plans = [QUERIES[f"cell_format_{n}"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString() for n in ("number", "rounded", "percent", "date")]
    assert all("each(" in p for p in plans)
