import re

from pyspark.sql import functions as F

from docweave import catalogue
from docweave.functions import text as T
from docweave.operators import geometry as G
from docweave.operators import tags as M

SF = "/root/testdata/sf0.001"


def test_components_equal_flood_fill(spark):
    got = sorted(tuple(r)[:7] for r in catalogue.QUERIES["sheet_components"](spark, SF).collect())
    cells = {tuple(r) for r in catalogue._cells(spark, SF).distinct().collect()}
    want = []
    while cells:
        todo, box = [cells.pop()], []
        while todo:
            d, s, r, c = todo.pop()
            box.append((d, s, r, c))
            for near in ((d, s, r - 1, c), (d, s, r + 1, c), (d, s, r, c - 1), (d, s, r, c + 1)):
                if near in cells:
                    cells.discard(near)
                    todo.append(near)
        rs, cs = [x[2] for x in box], [x[3] for x in box]
        want.append((*box[0][:2], min(rs), min(cs), max(rs), max(cs)))
    assert sorted((d, s, *b) for d, s, _, *b in got) == sorted(want)


def test_components_over_bands(spark):
    """Snakes and combs through many bands, equal whatever the bands' height; odd input."""
    cells = [(1, 0, r, c) for r in range(40) for c in range(9) if r % 4 == 0 or c == (8 if r % 8 < 4 else 0)]
    cells += [(1, 1, r, c) for r in range(30) for c in (0, 2, 4)] + [(1, 1, 29, c) for c in range(5)] + [(2, 0, 7, 3)] * 3
    odd = [(None, 0, 1, 1), (1, None, 1, 1), (1, 0, None, 1), (1, 0, 1, None)]
    df = spark.createDataFrame(cells + odd, "doc int, sheet int, r int, c int")
    n_runs = {(1, 0): 10 + 10 * 3, (1, 1): 29 * 3 + 1, (2, 0): 1}
    for rows in (2, 5, 64):
        got = sorted(map(tuple, G.components(df, rows).collect()))
        assert got == [(1, 0, 0, 0, 0, 39, 8, n_runs[1, 0]), (1, 1, 0, 0, 0, 29, 4, n_runs[1, 1]), (2, 0, 0, 7, 3, 7, 3, 1)]
    assert G.components(df.where("false")).count() == 0


def test_suppression_equals_loop(spark):
    rows = catalogue.boxes(spark, SF).selectExpr("doc", "page", "id", "x0", "y0", "x1", "y1", "id % 10 / 10D as c", "id % 3 as p").collect()
    taken = []
    for r in sorted(rows, key=lambda r: (-(r.c - 0.15 * r.p), r.id)):
        area = (r.x1 - r.x0) * (r.y1 - r.y0)
        for o in taken:
            shared = max(0, min(r.x1, o.x1) - max(r.x0, o.x0)) * max(0, min(r.y1, o.y1) - max(r.y0, o.y0))
            if (o.doc, o.page) == (r.doc, r.page) and (shared >= 0.3 * area or shared >= 0.3 * (o.x1 - o.x0) * (o.y1 - o.y0)):
                break
        else:
            taken.append(r)
    assert sorted(r.id for r in catalogue.QUERIES["table_nms"](spark, SF).collect()) == sorted(r.id for r in taken)


def test_complexity_levels(spark):
    page = "width double, height double, n_drawings long, n_curves long, n_fills long, n_images long, n_columns long, text_quality double, complex_share double"
    rows = [(600.0, 800.0, 0, 0, 0, 0, 1, 1.0, 0.0), (600.0, 800.0, 3000, 1000, 0, 30, 8, 0.5, 0.0), (600.0, 800.0, 3000, 0, 0, 30, 5, 0.9, 0.0), (600.0, 800.0, 0, 0, 0, 0, 1, 0.3, 0.0)]
    got = [(r.level, r.strategy) for r in G.complexity(spark.createDataFrame(rows, page)).collect()]
    assert got == [("SIMPLE", "TEXT"), ("EXTREME", "FULL_PAGE_OCR"), ("COMPLEX", "HYBRID"), ("SIMPLE", "FULL_PAGE_OCR")]


def test_text_folds(spark):
    df = spark.createDataFrame([(["[Page Number: 1]", " ", "a", "[Page Number: 2] ", "[Slide Number: 3]"], ["x", "y" * 200, "z"], "가\n나\n다\n라\n마\n바")], "c array<string>, s array<string>, t string")
    r = df.select(M.joined_markers(F.col("c")).alias("c"), M.merged_small(F.col("s")).alias("s"), T.is_fragmented(F.col("t")).alias("f"), T.needs_ocr(F.col("t")).alias("o")).first()
    assert r.c == ["[Page Number: 1]\n\na\n\n[Page Number: 2]\n\n[Slide Number: 3]"]
    assert r.s == ["x\n\n" + "y" * 200 + "\n\nz"] and r.f and r.o


def test_tags_in_cells(spark):
    docs = spark.createDataFrame([(1, "a [image : {p.png}] <td>b [Image:p.png]</td> [Image:q.png]"), (2, None), (3, "plain [x]")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in M.substituted_tags(docs, lambda p: F.when(p.startswith("p"), F.lit("```\n<b>1 & 2</b> | 3\n```"))).collect()}
    assert got[1] == "a ```\n<b>1 & 2</b> | 3\n``` <td>b 1 &amp; 2 3</td> [Image:q.png]"
    assert got[3] == "plain [x]" and not got.get(2)


def test_sections_before_the_first_marker(spark):
    docs = spark.createDataFrame([(1, "front\n[Page Number: 4]\nfour\n[Page Number: 5]\n"), (2, None)], "doc_id long, text string")
    assert [(r.page, r.section) for r in M.page_sections(docs).collect()] == [(0, "front"), (4, "four")]
    assert re.match(M.MARKER, "[Page Number: 4 (OCR)]")
