import random
import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from docweave import catalogue
from docweave.functions import text as T
from docweave.functions.table_functions import register
from docweave.operators import chunking as C
from docweave.operators import frames as D
from docweave.sources import images as I

SF = "/root/testdata/sf0.001"
TABLE = "doc int, page int, id int, x0 double, y0 double, x1 double, y1 double"


def test_gaps_of_frames_by_points(spark):
    rnd = random.Random(5)
    tables = [(1, 1, i, 0.0, 0.0, 100.0, 60.0) for i in range(30)]
    strokes = []
    for i in range(30):
        for _ in range(rnd.randint(0, 9)):
            a = float(rnd.randint(-20, 90))
            b = a + rnd.randint(3, 80)
            at = rnd.choice([0.0, 4.0, 60.0, 100.0, 30.0])
            strokes.append((1, 1, i, a, at, b, at) if rnd.random() < 0.5 else (1, 1, i, at, a, at, b))
    schema = TABLE
    got = {}
    for r in D.side_gaps(spark.createDataFrame(tables, schema), spark.createDataFrame(strokes + [(1, None, 1, 0.0, 0.0, 1.0, 0.0)], schema)).collect():
        got.setdefault((r.id, r.side), []).append((r.start, r.end))
    for i in range(30):
        for side, flat, place, high in (("top", 1, 0.0, 100), ("bottom", 1, 60.0, 100), ("left", 0, 0.0, 60), ("right", 0, 100.0, 60)):
            open_ = set(range(high))
            for *_, t, x0, y0, x1, y1 in (s for s in strokes if s[2] == i):
                if flat and y0 == y1 and abs(y0 - place) <= 5:
                    open_ -= set(range(int(x0), int(x1)))
                if not flat and x0 == x1 and abs(x0 - place) <= 5:
                    open_ -= set(range(int(y0), int(y1)))
            mine = {p for a, b in got.get((i, side), []) for p in range(int(a), int(b))}
            assert mine == open_, (i, side)


def test_frames_are_completed_from_three_sides(spark):
    tables = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 100.0, 60.0), (1, 1, 2, 0.0, 0.0, 100.0, 60.0), (1, 1, 3, 0.0, 0.0, 100.0, 60.0)], TABLE)
    strokes = [(1, 1, t, *s) for t in (1, 2, 3) for s in ((0.0, 0.0, 100.0, 0.0), (0.0, 60.0, 95.0, 60.0))] + [(1, 1, t, 0.0, 0.0, 0.0, 60.0) for t in (1, 3)] + [(1, 1, 3, 100.0, 0.0, 100.0, 60.0)]
    got = sorted(tuple(r)[2:] for r in D.completed_frames(tables, spark.createDataFrame(strokes, TABLE)).collect())
    assert got == [(1, "bottom", 95.0, 60.0, 100.0, 60.0), (1, "right", 100.0, 0.0, 100.0, 60.0), (3, "bottom", 95.0, 60.0, 100.0, 60.0)]


def test_parts_of_plain_and_drawn_tables(spark):
    tables = spark.createDataFrame([(1, 1, i, 0.0, 0.0, 100.0, 60.0) for i in (1, 2, 3)], TABLE)
    items = [(1, 1, 1, 0, "re", False, 0.0, 0.0, 100.0, 60.0), (1, 1, 1, 0, "l", False, 100.0, 30.0, 0.0, 30.0), (1, 1, 1, 0, "l", False, 50.0, 0.0, 50.0, 60.0)]
    items += [(1, 1, 2, 0, "c", True, 0.0, 0.0, 9.0, 9.0), (1, 1, 2, 1, "l", None, 0.0, 0.0, 50.0, 50.0), (1, 1, None, 1, "l", None, 0.0, 0.0, 50.0, 50.0)]
    df = spark.createDataFrame(items, "doc int, page int, id int, drawing int, kind string, filled boolean, x0 double, y0 double, x1 double, y1 double")
    got = {r.id: (r.border, r.grid, r.cells, r.simplicity) for r in D.table_parts(tables, df).collect()}
    assert got == {1: (1.0, 0.6, 1.0, 1.0), 2: (0.0, 0.4, 0.5, 0.2), 3: (0.0, 0.0, 0.5, 1.0)}
    from docweave.operators.grids import table_grades

    assert {r.id: r.grade for r in table_grades(D.table_parts(tables, df)).collect()}[1] == "GOOD"


def program(ext, rnd):
    parts = [p.strip() for p in C.code_separators(ext) if p.strip()]
    lines = []
    for _ in range(120):
        lines.append(rnd.choice(["", "", "    x = 1", "// note " * rnd.randint(1, 9), "z" * 300] + [f"{p} name{rnd.randint(0, 9)}" for p in parts]))
    return "\n".join(lines)


@pytest.mark.parametrize("ext", ["py", "js", "ts", "java", "cpp", "c", "cs", "go", "rs", "php", "rb", "swift", "kt", "scala", "html", "jsx", "tsx", "none", None])
def test_code_is_cut_without_loss(ext):
    text = program(ext, random.Random(ext))
    for size, overlap in ((100, 0), (200, 60), (10**6, 10)):
        rows = C.code_rows(text, ext, size, overlap)
        at = 0
        for i, (n, part, line, end, a, b) in enumerate(rows):
            assert n == i and part == text[a : b + 1] and len(part) <= size and line == 1 + text.count("\n", 0, a) and end == line + part.count("\n")
            assert a <= at or not text[at:a].strip()
            assert i == 0 or overlap or a >= at
            at = max(at, b + 1)
        assert not text[at:].strip()


def test_code_is_cut_at_its_parts():
    text = "import os\n\nclass A:\n\tdef f(self):\n\t\tpass\n\tdef g(self):\n\t\tpass\n\ndef h():\n    return 1\n"
    assert [r[1].split("\n")[0] for r in C.code_rows(text, "py", 30, 0)] == ["import os", "def f(self):", "def g(self):", "def h():"]
    assert [r[1] for r in C.code_rows("<p>one</p><div>two</div><p>three</p>", "html", 14, 0)] == ["<p>one</p>", "<div>two</div>", "<p>three</p>"]


def test_code_rows_of_tables(spark):
    df = spark.createDataFrame([(1, "py", "def a():\n  1\ndef b():\n  2"), (2, None, "x y"), (3, "go", None), (4, "zz", " \n")], "doc_id int, ext string, text string")
    got = sorted((r.doc_id, r.chunk_index, r.text, r.line_start) for r in C.chunk_code(df, size=14, overlap=0).collect())
    assert got == [(1, 0, "def a():\n  1", 1), (1, 1, "def b():\n  2", 3), (2, 0, "x y", 1), (3, 0, "", 1), (4, 0, "", 1)]
    with pytest.raises(ValueError):
        C.chunk_code(df, size=10, overlap=10)


def test_chunk_in_sql_equals_chunks(spark):
    want = sorted(map(tuple, catalogue.QUERIES["chunks"](spark, SF).select("doc_id", "chunk_index", "text", "page_number", "line_start", "line_end", "global_start", "global_end").collect()))
    got = sorted(map(tuple, catalogue.QUERIES["chunk_lateral"](spark, SF).collect()))
    assert got == want and len(got) > 500


def test_chunk_in_sql_has_the_columns_of_its_type(spark):
    register(spark)
    one = lambda args: spark.sql(f"select c.* from (select 'def a():\n  1\ndef b():\n  2' as t) d, lateral chunk({args}) c")
    assert one("d.t").columns == ["chunk_index", "text", "page_number", "line_start", "line_end", "global_start", "global_end"]
    code = one("d.t, 14, 0, 'py'")
    assert "page_number" not in code.columns and [r.text for r in code.collect()] == ["def a():\n  1", "def b():\n  2"]
    assert [r.text for r in spark.sql("select c.* from lateral chunk(null) c").collect()] == [""]
    for wrong in ("d.t, 10, 10", "d.t, length(d.t)", "1"):
        with pytest.raises(AnalysisException):
            one(wrong).schema


def test_images_are_saved_once(spark, tmp_path):
    png, gif, other = b"\x89PNG\r\n\x1a\n" + b"a" * 50, b"GIF89a" + b"b" * 9, b"something"
    rows = [(i, x) for i, x in enumerate([png, gif, other, png, png, None, b"", gif] * 5)]
    df = spark.createDataFrame(rows, "id int, content binary").repartition(4)
    folder = tmp_path / "images"
    I.save_images(df, str(folder))
    names = sorted(p.name for p in folder.iterdir())
    assert len(names) == 3 and sorted(n.split(".")[1] for n in names) == ["gif", "png", "png"]
    assert sorted((folder / n).read_bytes() for n in names) == sorted([png, gif, other])
    before = {p.name: p.stat().st_mtime_ns for p in folder.iterdir()}
    I.save_images(df, f"file://{folder}")
    assert {p.name: p.stat().st_mtime_ns for p in folder.iterdir()} == before
    tags = {r.t for r in df.select(I.image_tag(F.col("content"), "images").alias("t")).collect()}
    assert tags == {None, *(f"[Image:images/{n}]" for n in names)}
    I.save_images(df.where("id = 1"), str(folder), "overwrite")
    assert [p.name.split(".")[1] for p in folder.iterdir()] == ["gif"]


def test_failed_and_repeated_tasks_leave_each_image_once(spark, tmp_path):
    """A task that ends in the middle, then the same rows again, as Spark does with a lost task."""
    writer = I.ImageWriter(str(tmp_path), False)
    rows = [{"name": f"{i}.png", "content": bytes([i])} for i in range(6)]

    def failing():
        yield from rows[:3]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(failing())
    first = writer.write(iter(rows))
    again = writer.write(iter(rows))
    assert (first.images, again.images) == (3, 0)
    writer.commit([first, again, None])
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"{i}.png" for i in range(6)]
    other = I.ImageWriter(str(tmp_path), False)
    with pytest.raises(RuntimeError):
        other.write(failing())
    other.abort([None])
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"{i}.png" for i in range(6)]


def test_compatible_and_recognised_text(spark):
    every = "".join(T.COMPATIBILITY) + "abc"
    lines = ["", "  ", "--- *** ...", "rainmoon", "123", "12°", "Only letters here", "‥‥‥", "· • ●", "한국어 text", "  매출 12 ", "PLATEER v2.0", "Report 2024", "a1b2c3d4e5f6", "ab1", "x1 OK2 zz", "2024 1 2 3 4 5 a b c", "ÉÉÉ 1"]
    df = spark.createDataFrame([(every, "\n".join(lines)), (None, None), ("", "")], "c string, o string")
    got = df.select(T.compatible(F.col("c")).alias("c"), T.recognised(F.col("o")).alias("o")).collect()
    assert got[0].c == "".join(T.COMPATIBILITY.values()) + "abc" and got[1].c is None and got[2].c == ""

    def keeps(x):
        if not x or re.fullmatch(T.SYMBOLS, x) or any(re.fullmatch(n, x, re.I) for n in T.NOISE):
            return False
        if re.search("[가-힣]", x):
            return True
        n = sum(c.isalpha() for c in x)
        return n >= 3 and 2 * n >= len(x.replace(" ", "")) and (any(c.islower() for c in x) or any(w.isupper() and len(w) >= 2 for w in x.split()))

    assert got[0].o.split("\n") == [x.strip() for x in lines if keeps(x.strip())]
    assert got[1].o is None and got[2].o == ""
