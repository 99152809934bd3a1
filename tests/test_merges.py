import random

from pyspark.sql import functions as F

from docweave.functions import marks as K
from docweave.operators import merges as M
from docweave.operators import positions as P
from docweave.operators import tags as T

CELL = "doc int, sheet int, r int, c int, text string, kind string"
BOX = "doc int, sheet int, r1 int, c1 int, r2 int, c2 int"


def sheet(spark, *grids):
    """(blocks, cells) of the blocks of each grid given as rows of texts; `_` is no cell, digits are numbers."""
    cells, blocks = [], []
    for s, grid in enumerate(grids):
        full = {(r, c): t for r, row in enumerate(grid, 1) for c, t in enumerate(row, 1) if t != "_"}
        cells += [(1, s, r, c, t, "number" if t.isdigit() else "text") for (r, c), t in full.items()]
        left = set(full)
        while left:
            todo, box = [min(left)], []
            left.discard(todo[0])
            while todo:
                r, c = todo.pop()
                box.append((r, c))
                for near in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                    if near in left:
                        left.discard(near)
                        todo.append(near)
            blocks.append((1, s, min(r for r, _ in box), min(c for _, c in box), max(r for r, _ in box), max(c for _, c in box)))
    return spark.createDataFrame(blocks, BOX), spark.createDataFrame(cells, CELL)


def merged(spark, *grids):
    return sorted((r.sheet, r.block, r.r1, r.c1, r.r2, r.c2, tuple(r.skipped)) for r in M.gap_merged(*sheet(spark, *grids)).collect())


def test_gaps_of_sheets(spark):
    spacer = [["item", "n", "_", "store", "note"]] + [[f"i{k}", "5", "_", "s", "ok"] for k in range(4)]
    groups = [["unit", "name"], ["a", "b"], ["c", "d"], ["_", "_"], ["e", "f"], ["g", "h"], ["_", "_"], ["i", "j"]]
    again = [["unit", "n"], ["a", "1"], ["b", "2"], ["_", "_"], ["unit", "n"], ["c", "3"], ["_", "_"], ["d", "4"], ["_", "_"], ["unit", "n"], ["e", "5"]]
    apart = [["unit", "n"], ["a", "1"], ["_", "_"], ["_", "_"], ["b", "2"], ["c", "3"], ["_", "_"], ["4", "d"]]
    wide = [["a", "b", "_"], ["1", "2", "_"], ["_", "_", "_"], ["3", "4", "5"]]
    assert merged(spark, spacer, groups, again, apart, wide) == [
        (0, 0, 1, 1, 5, 5, ()),
        (1, 0, 1, 1, 8, 2, ()),
        (2, 0, 1, 1, 11, 2, (5, 10)),
        (3, 0, 1, 1, 2, 2, ()), (3, 1, 5, 1, 6, 2, ()), (3, 2, 8, 1, 8, 2, ()),
        (4, 0, 1, 1, 2, 2, ()), (4, 1, 4, 1, 4, 3, ()),
    ]


def test_gaps_across_and_then_down(spark):
    grid = [["a", "_", "b"], ["1", "_", "2"], ["_", "_", "_"], ["3", "_", "4"], ["5", "_", "6"]]
    assert merged(spark, grid) == [(0, 0, 1, 1, 5, 3, ())]


def test_gaps_of_odd_rows(spark):
    blocks, cells = sheet(spark, [["a"], ["b"]])
    odd = spark.createDataFrame([(1, 0, 1, 1, 2, 1), (1, 0, 1, 1, 2, 1), (1, None, 1, 1, 2, 1), (1, 0, None, 1, 2, 1)], BOX)
    more = cells.union(spark.createDataFrame([(1, 0, 1, 1, "other", None), (1, 0, None, 1, "x", "text"), (1, 0, 2, 1, "", "text")], CELL))
    assert [tuple(r)[2:] for r in M.gap_merged(odd, more).collect()] == [(0, 1, 1, 2, 1, [])]
    assert M.gap_merged(blocks.where("false"), cells).count() == 0
    assert M.gap_merged(blocks, cells.where("false")).count() == 1


CANDIDATE = "doc int, page int, id long, x0 double, y0 double, x1 double, y1 double, n_rows int, n_cols int"


def loop(rows, most=2):
    """Each page's candidates one after the other, from the top."""
    out = []
    rows = sorted(rows, key=lambda r: (r[4], r[3], r[2]))
    used = set()
    for i, head in enumerate(rows):
        if i in used:
            continue
        box, cols, members = list(head[3:7]), head[8], [head]
        if head[7] <= most:
            for j in range(i + 1, len(rows)):
                d = rows[j]
                wide = max(box[2] - box[0], d[5] - d[3])
                common = max(0.0, min(box[2], d[5]) - max(box[0], d[3]))
                if not -5 <= d[4] - box[3] <= 10 or (wide > 0 and common < 0.7 * wide) or cols > d[8] + 1:
                    break
                box, cols = [min(box[0], d[3]), box[1], max(box[2], d[5]), d[6]], max(cols, d[8])
                used.add(j)
                members.append(d)
        out += [(m[2], head[2], max(x[8] for x in members) - m[8]) for m in members]
    return sorted(out)


def test_headers_take_in_what_follows(spark):
    rnd = random.Random(8)
    pages = []
    for p in range(12):
        y, rows = 0.0, []
        for i in range(rnd.randint(1, 14)):
            x, high = rnd.choice([0.0, 5.0, 60.0]), rnd.choice([10.0, 30.0])
            rows.append((1, p, i, x, y, x + rnd.choice([100.0, 110.0, 200.0]), y + high, rnd.randint(1, 4), rnd.randint(1, 5)))
            y += high + rnd.choice([-5.0, 0.0, 3.0, 10.0, 11.0, -6.0])
        pages.append(rows)
    df = spark.createDataFrame([r for rows in pages for r in rows] + [(1, 50, 1, None, 1.0, 2.0, 3.0, 1, 1), (None, 1, 1, 0.0, 1.0, 2.0, 3.0, 1, 1)], CANDIDATE).repartition(3)
    got = {}
    for r in M.header_merged(df).collect():
        got.setdefault(r.page, []).append((r.id, r.table, r.missing))
    assert {p: sorted(x) for p, x in got.items()} == {p: loop(rows) for p, rows in enumerate(pages)}
    assert any(t != i for x in got.values() for i, t, _ in x)
    assert M.header_merged(df.where("false")).count() == 0


def merges_by_grid(rows):
    """Owners in a grid, column by column, row by row."""
    owner, shown = {}, {}
    for r in sorted({x[0] for x in rows}):
        c = 0
        for _, _, width, merge, text in sorted(x for x in rows if x[0] == r):
            above = [owner[q, c] for q in range(r - 1, -1, -1) if (q, c) in owner and owner[q, c][1]] if merge == "continue" else []
            mine = above[0] if above else ((r, c, width, merge), True)
            if not above:
                shown[r, c] = [1, width, text]
            for k in range(width):
                owner[r, c + k] = (mine[0], merge != "continue")
                if merge == "continue":
                    owner[r, c + k] = (mine[0], False)
            if above and mine[0][3] == "restart" and mine[0][1] == c and mine[0][2] == width and shown[mine[0][:2]][0] == r - mine[0][0]:
                shown[mine[0][:2]][0] += 1
            c += width
    return sorted((r, c, *x) for (r, c), x in shown.items())


def test_vertical_merges(spark):
    rnd = random.Random(3)
    tables = [
        [(0, 0, 1, "restart", "a"), (0, 1, 2, "restart", "b"), (1, 0, 1, "continue", ""), (1, 1, 2, "continue", ""), (2, 0, 1, "continue", ""), (2, 1, 1, "none", "c"), (2, 2, 1, "none", "d")],
        [(0, 0, 1, "continue", "lost"), (1, 0, 1, "continue", "lost too")],
    ]
    tables += [[(r, i, rnd.randint(1, 2), rnd.choice(["none", "restart", "continue", "continue"]), f"{r}.{i}") for r in range(8) for i in range(rnd.randint(1, 4))] for _ in range(25)]
    rows = [(1, t, *x) for t, table in enumerate(tables) for x in table]
    df = spark.createDataFrame(rows, "doc int, id int, r int, i int, width int, merge string, text string").repartition(3)
    got = {}
    for r in M.vertical_merges(df).collect():
        got.setdefault(r.id, []).append((r.r, r.c, r.row_span, r.col_span, r.text))
    assert sorted(got[0]) == [(0, 0, 3, 1, "a"), (0, 1, 2, 2, "b"), (2, 1, 1, 1, "c"), (2, 2, 1, 1, "d")]
    assert sorted(got[1]) == [(0, 0, 1, 1, "lost"), (1, 0, 1, 1, "lost too")]
    assert {t: sorted(x) for t, x in got.items()} == {t: merges_by_grid(x) for t, x in enumerate(tables)}
    odd = spark.createDataFrame([(1, 1, 0, 0, None, None, None), (1, 1, None, 0, 1, "none", "x")], df.schema)
    assert [tuple(r) for r in M.vertical_merges(odd).collect()] == [(1, 1, 0, 0, 1, 1, None)]


def test_uncovered_cells(spark):
    rows = [(1, 1, 0, 0, 2, 2, "a"), (1, 1, 0, 1, 1, 1, "under"), (1, 1, 1, 1, 1, 3, "under"), (1, 1, 1, 3, 1, 1, "under too"), (1, 1, 2, 0, None, None, "b"), (1, 2, 0, 1, 1, 1, "c")]
    df = spark.createDataFrame(rows, "doc int, id int, r int, c int, row_span int, col_span int, text string")
    assert sorted(r.text for r in M.uncovered(df).collect()) == ["a", "b", "c"]
    assert M.uncovered(df).columns == df.columns


def filled(rows):
    taken, out = set(), []
    for r, row in enumerate(rows, 1):
        c = 1
        for i, (down, across) in enumerate(row, 1):
            while (r, c) in taken:
                c += 1
            taken |= {(r + a, c + b) for a in range(down) for b in range(across)}
            out.append((r, i, c))
            c += across
    return out


def test_cells_of_random_html_tables(spark):
    rnd = random.Random(7)
    tables = [[[(rnd.choice([1, 1, 2, 4]), rnd.choice([1, 1, 3])) for _ in range(rnd.randint(0, 5))] for _ in range(rnd.randint(1, 12))] for _ in range(40)]
    html = lambda t: "<Table class='x'>" + "".join("<tr>" + "".join(f"<{'TH' if r == 0 else 'td'} ROWSPAN = '{d}' colspan={a}>t &amp;\n <i>{r}</i></td>" for d, a in row) + ("</tr>" if r % 2 else "") for r, row in enumerate(t)) + "</table>"
    docs = [(i, f"<p>x</p>{html(t)} between {html(t[::-1])}") for i, t in enumerate(tables)] + [(90, None), (91, "<tr><td>no table</td></tr>"), (92, "<table><tr><td rowspan=x colspan=0>a<td rowspan=5000>b")]
    df = spark.createDataFrame(docs, "doc_id int, html string").repartition(3)
    got = {}
    for r in M.placed_cells(M.table_cells(df)).collect():
        got.setdefault((r.doc_id, r.id), []).append((r.r, r.i, r.c))
        assert r.doc_id > 50 or (r.text == f"t &amp; {r.r - 1}" and r.header == (r.r == 1) or r.id == 1)
    want = {(i, k): filled(x) for i, t in enumerate(tables) for k, x in ((0, t), (1, t[::-1])) if any(x)}
    assert {k: sorted(v) for k, v in got.items() if k[0] < 50} == want
    odd = [(r.row_span, r.col_span, r.c, r.text) for r in M.placed_cells(M.table_cells(df.where("doc_id > 50"))).collect()]
    assert sorted(odd) == [(1, 1, 1, "a"), (1000, 1, 2, "b")]


def test_nested_fields(spark):
    texts = ["x \x13F1 \x14\x13F0 \x14A\x15\x15 y", "\x13A\x14b\x13C\x15\x14\x15", "a\x15b\x13c", "no fields", "", None, "\x13" * 60 + "\x14in\x15" * 60, "\x13a \x13b\x14B\x15 c\x14D \x13e\x14E\x15\x15!"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.x for r in df.select("i", K.without_fields(F.col("t")).alias("x")).orderBy("i").collect()]

    def opened(text):
        """What a field shows, by a stack."""
        stack = [["", None]]
        for c in text:
            if c == "\x13":
                stack.append(["", None])
            elif c == "\x14" and len(stack) > 1:
                stack[-1][1] = stack[-1][1] or ""
            elif c == "\x15" and len(stack) > 1:
                _, shown = stack.pop()
                part = 0 if stack[-1][1] is None else 1
                stack[-1][part] += shown or ""
            elif c not in "\x14\x15":
                part = 0 if stack[-1][1] is None else 1
                stack[-1][part] += c
        return stack[0][0] if len(stack) == 1 else None

    assert got[0] == "x A y" and got[3:6] == ["no fields", "", None] and got[2] == "abc"
    for i in (0, 1, 7):
        assert got[i] == opened(texts[i]), i
    assert got[6] == "in"


def test_page_numbers_too_long(spark):
    docs = spark.createDataFrame([(1, "pdf", "[Page Number: 99999999999]\nx[Page Number: 2]\ny")], "doc_id int, ext string, text string")
    assert sorted((r.page, r.start) for r in P.page_map(docs).collect()) == [(0, 0), (2, 28)]


def test_substituted_tags_by_row(spark):
    docs = spark.createDataFrame([(1, "a [Image: p.png] b"), (1, "c [Image: q.png] d"), (1, "c [Image: q.png] d"), (None, "[Image: p.png]"), (2, None), (3, ""), (4, "<td>[Image:p.png]</td>")], "doc_id int, text string")
    got = sorted(map(str, ((r.doc_id, r.text) for r in T.substituted_tags(docs, lambda p: F.when(F.trim(p) == "p.png", "| P |")).collect())))
    assert got == sorted(map(str, [(1, "a | P | b"), (1, "c [Image: q.png] d"), (1, "c [Image: q.png] d"), (None, "| P |"), (2, None), (3, ""), (4, "<td>P</td>")]))
