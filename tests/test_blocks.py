import random

from docweave.operators import blocks as B
from docweave.operators import near as N

ELEMENT = "doc int, page int, id long, kind string, length int, size double, x0 double, y0 double, x1 double, y1 double"
BOX = "doc int, page int, x0 double, y0 double, x1 double, y1 double"


def groups(n, touches):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if touches(i, j) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def gap(a, b, axis):
    lo, hi = (0, 2) if axis == "x" else (1, 3)
    return max(0.0, b[lo] - a[hi], a[lo] - b[hi])


def boxes(rnd, n, far=600):
    out = []
    for _ in range(n):
        x, y = rnd.uniform(0, far), rnd.uniform(0, far)
        out.append((x, y, x + rnd.choice([0.5, 20, 90, 300]), y + rnd.choice([0.5, 12, 60])))
    return out


def test_near_pairs_and_components_equal_all_pairs(spark):
    rnd = random.Random(6)
    for reach in (5.0, 40.0, 250.0):
        rows = [(d, i, *b) for d in (1, 2) for i, b in enumerate(boxes(rnd, 70))]
        df = spark.createDataFrame(rows, "doc int, id long, x0 double, y0 double, x1 double, y1 double").repartition(3)
        near = (N.gap("x") <= reach) & (N.gap("y") <= reach / 2)
        got = sorted(map(tuple, N.near_pairs(df, ["doc"], near, reach).collect()))
        want = sorted((d, i, j) for d in (1, 2) for i, j in ((i, j) for i in range(70) for j in range(i + 1, 70)) if (lambda a, b: gap(a, b, "x") <= reach and gap(a, b, "y") <= reach / 2)(rows[(d - 1) * 70 + i][2:], rows[(d - 1) * 70 + j][2:]))
        assert got == want
        found = {(r.doc, r.id): r.root for r in N.connected(df, N.near_pairs(df, ["doc"], near, reach), ["doc"]).collect()}
        edges = {(d, i, j) for d, i, j in want}
        for d in (1, 2):
            assert [found[d, i] for i in range(70)] == groups(70, lambda i, j: (d, j, i) in edges)


def test_components_of_paths_and_odd_edges(spark):
    nodes = spark.createDataFrame([(1, i) for i in range(60)] + [(2, 3)], "k int, id long")
    path = list(range(59))
    random.Random(1).shuffle(path)
    edges = spark.createDataFrame([(1, a, b) for a, b in zip(path, path[1:])] + [(1, 4, 4), (1, path[0], path[1])], "k int, a long, b long")
    got = {(r.k, r.id): r.root for r in N.connected(nodes, edges, ["k"]).collect()}
    assert got == {(1, i): 0 for i in range(59)} | {(1, 59): 59, (2, 3): 3}
    assert N.connected(nodes.where("false"), edges.where("false"), ["k"]).count() == 0


def page(spark, elements, lines=(), frames=(), most=10):
    e = spark.createDataFrame([(1, 1, i, *x) for i, x in enumerate(elements)], ELEMENT)
    pages = spark.createDataFrame([(1, 1, 600.0, 800.0)], "doc int, page int, width double, height double")
    shapes = lambda rows: spark.createDataFrame([(1, 1, *map(float, r)) for r in rows], BOX)
    found = B.layout_blocks(e, pages, shapes(lines), shapes(frames), most=most)
    return [(r.kind, r.column, r.members, r.x0, r.y0, r.x1, r.y1) for r in sorted(found.collect(), key=lambda r: r.place)]


def text(x0, y0, x1, y1, length=50, size=10.0):
    return ("text", length, size, float(x0), float(y0), float(x1), float(y1))


def image(x0, y0, x1, y1):
    return ("image", 0, None, float(x0), float(y0), float(x1), float(y1))


def test_two_columns_header_footer_and_images(spark):
    left = [text(50, y, 280, y + 12) for y in (100, 120, 140, 160, 180)]
    right = [text(320, y, 560, y + 12) for y in (100, 120, 140, 160, 180)]
    rest = [image(320, 300, 560, 420), text(320, 425, 500, 440, 15), image(50, 300, 280, 400), text(50, 20, 200, 32, 12), text(280, 780, 310, 790, 2)]
    got = page(spark, left + right + rest)
    assert [g[:3] for g in got] == [("HEADER", 0, 1), ("ARTICLE", 0, 5), ("STANDALONE_IMAGE", 0, 1), ("ARTICLE", 1, 5), ("IMAGE_WITH_CAPTION", 1, 2), ("FOOTER", 0, 1)]
    assert got[1][3:] == (50, 100, 280, 192) and got[4][3:] == (320, 300, 560, 440)


def test_separators_cut_blocks_and_frames_tell_kinds(spark):
    lines = [text(50, y, 400, y + 12, 80) for y in range(100, 300, 16)]
    assert [g[2] for g in page(spark, lines)] == [13]
    cut = page(spark, lines, lines=[(40, 196, 410, 197)])
    assert [g[2] for g in cut] == [6, 7]
    assert [g[0] for g in page(spark, lines, lines=[(40, 196, 410, 197)], frames=[(45, 190, 405, 300)])] == ["ARTICLE", "SIDEBAR"]
    few = [text(50, y, 400, y + 12, 10) for y in range(100, 300, 16)]
    assert page(spark, few, frames=[(45, 95, 405, 310)])[0][0] == "ADVERTISEMENT"
    few[0] = text(50, 100, 400, 112, 10, 20.0)
    assert page(spark, few, frames=[(45, 95, 405, 310)])[0][0] == "ARTICLE"


def test_many_blocks_are_joined_by_column(spark):
    stacked = [text(50, 100 + 110 * i, 400, 165 + 110 * i) for i in range(6)]
    assert len(page(spark, stacked)) == 6
    assert [g[2] for g in page(spark, stacked, most=5)] == [2, 2, 2]


def test_small_blocks_odd_rows_and_empty_tables(spark):
    assert page(spark, [text(50, 300, 100, 320)]) == []
    e = spark.createDataFrame([(1, 1, None, "text", 5, 9.0, 0.0, 0.0, 9.0, 9.0), (None, 1, 4, "text", 5, 9.0, 0.0, 0.0, 9.0, 9.0), (1, 1, 5, "text", None, None, 50.0, 300.0, 250.0, 400.0), (1, 1, 5, "text", None, None, 50.0, 300.0, 250.0, 400.0), (1, 1, 6, None, None, None, 50.0, 500.0, 250.0, 600.0), (1, 1, 7, "text", 5, 9.0, None, 0.0, 9.0, 9.0)], ELEMENT)
    pages = spark.createDataFrame([(1, 1, 600.0, 800.0)], "doc int, page int, width double, height double")
    none = spark.createDataFrame([], BOX)
    got = sorted((r.kind, r.members) for r in B.layout_blocks(e, pages, none, none).collect())
    assert got == [("ARTICLE", 1), ("UNKNOWN", 1)]
    assert B.layout_blocks(e.where("false"), pages, none, none).count() == 0


def regions_by_pairs(rows, rounds=5):
    groups_ = [([i], r[:4]) for i, r in enumerate(rows) if r[2] > r[0] and r[3] > r[1]]
    for _ in range(rounds):
        root = groups(len(groups_), lambda i, j: gap(groups_[i][1], groups_[j][1], "x") <= 20 and gap(groups_[i][1], groups_[j][1], "y") <= 20)
        new = {}
        for r, (ids, b) in zip(root, groups_):
            old = new.get(r)
            new[r] = (ids, b) if old is None else (old[0] + ids, (min(old[1][0], b[0]), min(old[1][1], b[1]), max(old[1][2], b[2]), max(old[1][3], b[3])))
        if len(new) == len(groups_):
            break
        groups_ = list(new.values())
    return sorted((min(ids), len(ids), *b) for ids, b in groups_)


def test_graphic_regions_against_all_pairs(spark):
    rnd = random.Random(12)
    schema = "doc int, page int, id long, x0 double, y0 double, x1 double, y1 double, curves int, lines int, rects int, fill string, stroke string"
    pages = spark.createDataFrame([(1, 1, 2000.0, 2000.0), (1, 2, 100.0, 100.0)], "doc int, page int, width double, height double")
    for n in (3, 60, 150):
        rows = [(*b[:2], b[0] + (b[2] - b[0]) / 4, b[3], rnd.choice([0, 5, None]), rnd.randint(0, 3), 1, rnd.choice(["red", None]), None) for b in boxes(rnd, n, 1500)]
        rows[0] = (5.0, 5.0, 5.0, 9.0, 1, 1, 1, None, None)
        df = spark.createDataFrame([(1, 1, i, *r) for i, r in enumerate(rows)] + [(1, None, 1, *rows[1])], schema).repartition(3)
        got = sorted((r.region, r.members, r.x0, r.y0, r.x1, r.y1) for r in B.graphic_regions(df, pages).collect())
        assert got == regions_by_pairs(rows)


def test_scores_of_regions(spark):
    schema = "doc int, page int, id long, x0 double, y0 double, x1 double, y1 double, curves int, lines int, rects int, fill string, stroke string"
    pages = spark.createDataFrame([(1, p, 600.0, 800.0) for p in range(6)], "doc int, page int, width double, height double")
    box = (100.0, 100.0, 300.0, 300.0)
    rows = [(1, 0, 1, *box, 20, 5, 0, "a", "b"), (1, 1, 1, *box, 0, 0, 9, "a", None), (1, 2, 1, 5.0, 5.0, 595.0, 795.0, 20, 5, 0, "a", "b"), (1, 3, 1, *box, 0, 0, 0, None, None), (1, 4, 1, 10.0, 10.0, 20.0, 20.0, 20, 0, 0, None, None)]
    rows += [(1, 5, i, 100.0 + 20 * i, 100.0, 115.0 + 20 * i, 200.0, 2, 0, 0, f"c{i}", None) for i in range(4)]
    got = {r.page: (r.score, r.is_graphic) for r in B.graphic_regions(spark.createDataFrame(rows, schema), pages).collect()}
    assert got == {0: (0.8, True), 1: (0.0, False), 2: (0.0, False), 3: (0.0, False), 4: (0.3, False), 5: (1.0, True)}
    assert B.graphic_regions(spark.createDataFrame([], schema), pages).count() == 0
