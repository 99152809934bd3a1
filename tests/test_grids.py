import itertools
import random

import pytest

from pyspark.sql import functions as F

from docweave.functions.marks import Tags, found_tags, numbered, pdf_date, tag, without_tags
from docweave.operators import grids as D
from docweave.operators import positions as P


def test_merged_boxes_against_repeated_unions(spark):
    rnd = random.Random(2)
    rows = [(s, s % 2, r, c, r + rnd.randint(0, 6), c + rnd.randint(0, 6)) for s in range(4) for _ in range(25) for r, c in [(rnd.randint(0, 60), rnd.randint(0, 40))]]
    got = D.merged_boxes(spark.createDataFrame(rows, "doc long, sheet int, r1 int, c1 int, r2 int, c2 int")).collect()
    for s in range(4):
        left = [x[2:] for x in rows if x[0] == s]
        while True:
            met = next(((a, b) for a, b in itertools.combinations(left, 2) if a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]), None)
            if met is None:
                break
            left.remove(met[0]), left.remove(met[1])
            left.append((*(min(met[0][i], met[1][i]) for i in (0, 1)), *(max(met[0][i], met[1][i]) for i in (2, 3))))
        assert [(r.r1, r.c1, r.r2, r.c2) for r in sorted((r for r in got if r.doc == s), key=lambda r: r.block)] == sorted(left)


def test_own_tags_and_odd_values(spark):
    tags = Tags(page=("<<p:", ">>"), sheet=("{{", "}}"))
    df = spark.createDataFrame([(3,), (None,)], "n int").select("n", tag("page", F.col("n"), tags).alias("t"))
    rows = df.select("n", "t", found_tags(F.concat(F.lit("a "), "t", F.lit(" b")), "page", tags).alias("f"), without_tags(F.concat("t", F.lit("\nrest")), "page", tags).alias("w"), numbered(F.col("n"), "romanLcParenR").alias("r")).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(3, "<<p:3>>", ["3"], "rest", "iii)"), (None, None, None, None, None)], key=str)
    dates = spark.createDataFrame([("D:20240230",), ("x",), (None,), ("19991231235959Z",)], "s string").select(pdf_date(F.col("s")).cast("string")).collect()
    assert [r[0] for r in dates] == [None, None, None, "1999-12-31 23:59:59"]
    with pytest.raises(AttributeError):
        numbered(F.col("n"), "unknown")


def test_page_map_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "pdf", ""), (2, None, "a\nb"), (3, "docx", "x" * 3001), (4, "pptx", "[Slide Number: 2]a"), (5, "xls", "no sheet"), (6, "pdf", None)], "doc_id long, ext string, text string")
    got = sorted((r.doc_id, r.page, r.start, r.end) for r in P.page_map(docs).collect())
    assert got == [(1, 1, 0, 0), (2, 1, 0, 3), (3, 1, 0, 1500), (3, 2, 1500, 3000), (3, 3, 3000, 3001), (4, 2, 0, 18), (5, 1, 0, 8)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc long, page int, way string, at double, start double, end double, thickness double")
    assert D.merged_lines(none).count() == D.grid_positions(none).count() == D.double_lines(D.line_classes(none)).count() == 0
