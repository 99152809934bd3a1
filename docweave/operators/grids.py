"""Drawn lines, grids, cells and page regions: range explosions to equi-joins, islands and grouped aggregates.

Boxes are columns x0, y0, x1, y1 in points, y growing downwards. Every function groups by (doc, page), by a table or by a
sheet, so one of these is the largest group. Numbers given as defaults are fixed values of the document model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import islands
from .near import connected, cut, freed, near_pairs

PAGE = ["doc", "page"]


def line_classes(lines: DataFrame, thin: float = 0.5, thick: float = 2) -> DataFrame:
    """Add weight (thin, normal or thick) by thickness to lines (doc, page, way, at, start, end, thickness)."""
    weight = F.when(F.col("thickness") <= thin, "thin").when(F.col("thickness") >= thick, "thick").otherwise("normal")
    return lines.withColumn("weight", weight)


def merged_lines(lines: DataFrame, apart: float = 3) -> DataFrame:
    """(doc, page, way, at, start, end, thickness, members): parallel lines at most `apart` from the next that also overlap are one.

    way is h or v; at is the lines' mean place, thickness the largest.
    """
    near = islands(lines, [*PAGE, "way"], "at", apart)
    order = Window.partitionBy(*PAGE, "way", "cluster").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    near = near.withColumn("_new", (reach.isNull() | (F.col("start") > reach)).cast("int")).withColumn("_part", F.sum("_new").over(order))
    found = near.groupBy(*PAGE, "way", "cluster", "_part").agg(F.avg("at").alias("at"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("thickness").alias("thickness"), F.count("*").alias("members"))
    return found.drop("cluster", "_part")


def double_lines(lines: DataFrame, gap: float = 5) -> DataFrame:
    """Add double: the line before it (same page and way) lies at most `gap` away and overlaps it."""
    order = Window.partitionBy(*PAGE, "way").orderBy("at", "start")
    near = (F.col("at") - F.lag("at").over(order) <= gap) & (F.lag("end").over(order) >= F.col("start")) & (F.lag("start").over(order) <= F.col("end"))
    return lines.withColumn("double", F.coalesce(near, F.lit(False)))


def grid_positions(lines: DataFrame, tolerance: float = 5) -> DataFrame:
    """(doc, page, rows, columns): mean places of clustered horizontal and vertical lines, only of pages that have two of each."""
    places = islands(lines, [*PAGE, "way"], "at", tolerance).groupBy(*PAGE, "way", "cluster").agg(F.avg("at").alias("at"))
    side = lambda way: F.array_sort(F.collect_list(F.when(F.col("way") == way, F.col("at"))))
    found = places.groupBy(*PAGE).agg(side("h").alias("rows"), side("v").alias("columns"))
    return found.where((F.size("rows") >= 2) & (F.size("columns") >= 2))


def cell_spans(cells: DataFrame, tolerance: float = 5) -> DataFrame:
    """(doc, page, id, cell, r, c, row_span, col_span) of cells (doc, page, id, cell and box): edges at most `tolerance` from the next are one grid line."""
    edges = cells.select(*PAGE, "id", "cell", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(e).alias("edge"), F.col(f"{a}{e}").cast("double").alias("at")) for a in "xy" for e in (0, 1)])).alias("e")).select(*PAGE, "id", "cell", "e.*")
    numbered = islands(edges, [*PAGE, "id", "axis"], "at", tolerance)
    of = lambda axis, edge: F.max(F.when((F.col("axis") == axis) & (F.col("edge") == edge), F.col("cluster")))
    found = numbered.groupBy(*PAGE, "id", "cell").agg(of("y", 0).alias("r"), of("x", 0).alias("c"), of("y", 1).alias("r1"), of("x", 1).alias("c1"))
    at_least_one = lambda a, b: F.greatest(F.lit(1), F.col(b) - F.col(a))
    return found.select(*PAGE, "id", "cell", "r", "c", at_least_one("r", "r1").alias("row_span"), at_least_one("c", "c1").alias("col_span"))


def page_borders(drawings: DataFrame, pages: DataFrame, margin: float = 0.1, spans: float = 0.85, thickness: float = 10) -> DataFrame:
    """(doc, page, has_border): thin drawings that span over `spans` of the page within `margin` of all four of its edges."""
    both = drawings.join(pages.select(*PAGE, "width", "height"), PAGE)
    edge = F.least("width", "height") * margin
    wide = (F.col("y1") - F.col("y0") <= thickness) & (F.col("x1") - F.col("x0") > F.col("width") * spans)
    high = (F.col("x1") - F.col("x0") <= thickness) & (F.col("y1") - F.col("y0") > F.col("height") * spans)
    top, left = F.col("y0") < edge, F.col("x0") < edge
    sides = [wide & top, wide & ~top & (F.col("y1") > F.col("height") - edge), high & left, high & ~left & (F.col("x1") > F.col("width") - edge)]
    found = both.groupBy(*PAGE).agg(*[F.max(s).alias(f"s{i}") for i, s in enumerate(sides)])
    return found.select(*PAGE, (F.col("s0") & F.col("s1") & F.col("s2") & F.col("s3")).alias("has_border"))


def _tiles(boxes: DataFrame, grid: int) -> DataFrame:
    """One row for each grid cell that a box overlaps."""
    span = lambda a: F.sequence(F.floor(F.col(f"{a}0") / grid).cast("int"), F.greatest(F.floor(F.col(f"{a}0") / grid), F.ceil(F.col(f"{a}1") / grid) - 1).cast("int"))
    return boxes.withColumn("gx", F.explode(span("x"))).withColumn("gy", F.explode(span("y")))


def region_grid(pages: DataFrame, drawings: DataFrame, texts: DataFrame, grid: int = 200) -> DataFrame:
    """(doc, page, gx, gy, n_drawings, text_quality, score, level, strategy) of each `grid` points of pages (doc, page, width, height).

    drawings and texts are boxes, texts with quality. Boxes are dealt to the grid cells they overlap, so the joins are on
    equal keys. A cell without text has quality 1.
    """
    cells = pages.select(*PAGE, "width", "height", F.explode(F.sequence(F.lit(0), F.ceil(F.col("width") / grid).cast("int") - 1)).alias("gx"))
    cells = cells.withColumn("gy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("height") / grid).cast("int") - 1)))
    key = [*PAGE, "gx", "gy"]
    drawn = _tiles(drawings, grid).groupBy(*key).agg(F.count("*").alias("n_drawings"))
    written = _tiles(texts, grid).groupBy(*key).agg(F.avg("quality").alias("text_quality"))
    both = cells.join(drawn, key, "left").join(written, key, "left")
    side = lambda g, whole: F.least((F.col(g) + 1) * grid, F.col(whole)) - F.col(g) * grid
    density = F.coalesce("n_drawings", F.lit(0)) * 1000 / (side("gx", "width") * side("gy", "height"))
    quality = F.coalesce("text_quality", F.lit(1.0))
    score = F.round(F.least(F.lit(1.0), density / 3 + (1 - quality) * 0.5), 6)
    found = both.select(*key, F.coalesce("n_drawings", F.lit(0).cast("long")).alias("n_drawings"), F.round(quality, 6).alias("text_quality"), score.alias("score"))
    level = F.when(F.col("score") >= 0.7, "COMPLEX").when(F.col("score") >= 0.4, "MODERATE").otherwise("SIMPLE")
    strategy = F.when(F.col("level") == "COMPLEX", "BLOCK_IMAGE_OCR").when(F.col("text_quality") < 0.7, "HYBRID").otherwise("TEXT")
    return found.withColumn("level", level).withColumn("strategy", strategy)


def table_grades(tables: DataFrame) -> DataFrame:
    """Add score, grade and by (table or image) to tables with border, grid, cells and simplicity, each from 0 to 1."""
    score = F.round(F.col("border") * 0.3 + F.col("grid") * 0.3 + F.col("cells") * 0.2 + F.col("simplicity") * 0.2, 6)
    grade = F.lit("UNPROCESSABLE")
    for least, name in ((0.4, "POOR"), (0.65, "MODERATE"), (0.85, "GOOD"), (0.95, "EXCELLENT")):
        grade = F.when(F.col("score") >= least, name).otherwise(grade)
    return tables.withColumn("score", score).withColumn("grade", grade).withColumn("by", F.when(F.col("score") >= 0.65, "table").otherwise("image"))


def lines_of_characters(characters: DataFrame, apart: float = 3) -> DataFrame:
    """(doc, page, line, text): characters (doc, page, x, y, ch) at most `apart` from the next in y are a line, read by x."""
    near = islands(characters, PAGE, "y", apart)
    parts = F.array_sort(F.collect_list(F.struct("x", "y", "ch")))
    return near.groupBy(*PAGE, F.col("cluster").alias("line")).agg(F.array_join(F.transform(parts, lambda p: p["ch"]), "").alias("text"))


def continued_tables(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (doc, seq, r, first, second) whose blank first column takes the last category, in tables that continue the one before.

    tables: (doc, seq, page, y0, y1, height, n_cols), seq their order. A table continues the one before if that is on an
    earlier page and ends in its lowest three tenths, this begins in the upper three, and both have equal columns. Only rows
    with something in the second column are filled; the category is the last first column, of whatever table.
    """
    order = Window.partitionBy("doc").orderBy("seq")
    up = lambda c: F.lag(c).over(order)
    goes_on = (F.col("page") > up("page")) & (up("y1") > up("height") * 0.7) & (F.col("y0") < F.col("height") * 0.3) & (F.col("n_cols") == up("n_cols"))
    known = tables.select("doc", "seq", F.coalesce(goes_on, F.lit(False)).alias("_goes_on"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    category = F.last(F.when(~blank("first"), F.trim("first")), ignorenulls=True).over(Window.partitionBy("doc").orderBy("seq", "r"))
    filled = F.when(F.col("_goes_on") & blank("first") & ~blank("second"), F.coalesce(category, F.col("first"))).otherwise(F.col("first"))
    return rows.join(known, ["doc", "seq"]).withColumn("first", filled).drop("_goes_on")


def single_columns(cells: DataFrame) -> DataFrame:
    """(doc, id, text): tables of cells (doc, id, r, c, text) that have one column only, as lines of what isn't blank."""
    filled = F.when(F.trim("text") != "", F.struct("r", F.trim("text").alias("t")))
    found = cells.groupBy("doc", "id").agg(F.max("c").alias("c"), F.array_sort(F.collect_list(filled)).alias("rows"))
    return found.where("c = 0").select("doc", "id", F.array_join(F.transform("rows", lambda x: x["t"]), "\n").alias("text"))


def _escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def rendered_tables(cells: DataFrame) -> DataFrame:
    """(doc, id, html, markdown, plain) of cells (doc, id, r, c, row_span, col_span, header, text).

    HTML: escaped, header cells th, spans above 1 given. Markdown: bars escaped, line ends as spaces, the first row
    over the separator. Plain: tabs between cells. Null texts are empty.
    """
    text = F.coalesce("text", F.lit(""))
    name = F.when(F.col("header"), "th").otherwise("td")
    span = lambda c: F.when(F.col(f"{c}_span") > 1, F.concat(F.lit(f" {c}span='"), F.col(f"{c}_span").cast("string"), F.lit("'"))).otherwise("")
    html = F.concat(F.lit("<"), name, span("row"), span("col"), F.lit(">"), _escaped(text), F.lit("</"), name, F.lit(">"))
    flat = F.replace(F.regexp_replace(text, r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))
    both = cells.select("doc", "id", "r", F.struct("c", html.alias("h"), flat.alias("m"), text.alias("p")).alias("x"))
    rows = both.groupBy("doc", "id", "r").agg(F.array_sort(F.collect_list("x")).alias("x"))
    part = lambda f: F.transform("x", lambda x: x[f])
    rule = F.when(F.col("r") == F.min("r").over(Window.partitionBy("doc", "id")), F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.size("x")))).otherwise("")
    lines = rows.select("doc", "id", F.struct("r", F.concat(F.lit("<tr>"), F.array_join(part("h"), ""), F.lit("</tr>")).alias("h"), F.concat(F.lit("| "), F.array_join(part("m"), " | "), F.lit(" |"), rule).alias("m"), F.array_join(part("p"), "\t").alias("p")).alias("y"))
    tables = lines.groupBy("doc", "id").agg(F.array_sort(F.collect_list("y")).alias("y"))
    join = lambda f, by: F.array_join(F.transform("y", lambda y: y[f]), by)
    return tables.select("doc", "id", F.concat(F.lit("<table border='1'>"), join("h", ""), F.lit("</table>")).alias("html"), join("m", "\n").alias("markdown"), join("p", "\n").alias("plain"))


def merged_boxes(boxes: DataFrame) -> DataFrame:
    """(doc, sheet, block, r1, c1, r2, c2): boxes of a sheet, overlapping ones replaced by their union until none overlap, in order.

    In each round boxes that hang together by overlaps become one, as a union may reach boxes that were apart before;
    rounds end when no two overlap. Overlaps come from a join on tiles, so a sheet may hold any number of boxes. Equal
    boxes are one, boxes with a null are left out, an empty table gives none.
    """
    keys, sides = ["doc", "sheet"], ["r1", "c1", "r2", "c2"]
    left = cut(boxes.select(*keys, *[F.col(c).cast("int").alias(c) for c in sides]).dropna().distinct())
    meets = (F.col("a.x0") <= F.col("b.x1")) & (F.col("b.x0") <= F.col("a.x1")) & (F.col("a.y0") <= F.col("b.y1")) & (F.col("b.y0") <= F.col("a.y1"))
    while True:
        named = left.select(*keys, F.struct(*sides).alias("id"), F.col("c1").alias("x0"), F.col("r1").alias("y0"), F.col("c2").alias("x1"), F.col("r2").alias("y1"))
        pairs = cut(near_pairs(named, keys, meets, 0))
        if pairs.isEmpty():
            break
        roots = connected(named, pairs, keys)
        union = [F.min("id.r1").alias("r1"), F.min("id.c1").alias("c1"), F.max("id.r2").alias("r2"), F.max("id.c2").alias("c2")]
        old, left = (left, pairs), cut(roots.groupBy(*keys, "root").agg(*union).select(*keys, *sides))
        for t in old:
            freed(t)
    block = F.row_number().over(Window.partitionBy(*keys).orderBy(*sides)) - 1
    return left.select(*keys, block.alias("block"), *sides)
