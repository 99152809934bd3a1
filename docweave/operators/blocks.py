"""Blocks of a page: adjacent elements joined within columns and between separators, classified and put in reading order;
and drawings joined to regions that are judged to be graphics or not.

Boxes are columns x0, y0, x1, y1 in points, y growing downwards; (doc, page) and id name an element. Numbers given as
defaults are fixed values of the document model. Rows whose doc, page, id or box is null take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import islands
from .near import connected, gap, near_pairs, over

PAGE = ["doc", "page"]
BOX = ["x0", "y0", "x1", "y1"]


def _known(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.dropna(subset=[*PAGE, *columns, *BOX])


def column_edges(elements: DataFrame, gap: float = 30, least: int = 3, apart: float = 20) -> DataFrame:
    """(doc, page, edges): x between the columns of a page, ascending; pages of one column have none.

    Columns are clusters of `least` or more starts of texts over 20 characters, at most `gap` from the next; an edge lies
    midway between the means of neighbouring clusters that are `apart` or more from each other.
    """
    starts = elements.where((F.col("kind") == "text") & (F.col("length") > 20))
    near = islands(starts, PAGE, "x0", gap).groupBy(*PAGE, "cluster").agg(F.avg("x0").alias("at"), F.count("*").alias("n")).where(F.col("n") >= least)
    after = F.lead("at").over(Window.partitionBy(*PAGE).orderBy("at"))
    middle = F.when(after - F.col("at") >= apart, (F.col("at") + after) / 2)
    return near.withColumn("edge", middle).groupBy(*PAGE).agg(F.array_sort(F.collect_list("edge")).alias("edges"))


def placed_elements(elements: DataFrame, pages: DataFrame, lines: DataFrame, margin: float = 0.1, highest: float = 60) -> DataFrame:
    """elements with zone (0 header, 1 body, 2 footer), column (from 0) and part (from 0, between separators).

    Header and footer: what lies in the band of the texts that are wholly in the top or bottom `margin` of the page, if that
    band is at most `highest`. An element is of the column that holds its centre, on an edge of the left one. A
    separator is a line less than 5 high over the element's column; it cuts what begins more than 5 above it from the
    rest, so an element that crosses one stays above.
    """
    text = F.col("kind") == "text"
    both = elements.join(pages.select(*PAGE, "width", "height"), PAGE)
    top, bottom = text & (F.col("y1") <= F.col("height") * margin), text & (F.col("y0") >= F.col("height") * (1 - margin))
    band = lambda side, name: [F.min(F.when(side, F.col("y0"))).alias(f"{name}0"), F.max(F.when(side, F.col("y1"))).alias(f"{name}1")]
    bands = both.groupBy(*PAGE).agg(*band(top, "h"), *band(bottom, "f"), F.first("width").alias("width"))
    edges = column_edges(elements)
    joined = elements.join(bands, PAGE).join(edges, PAGE, "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<double>")))
    inside = lambda n: F.coalesce((F.col(f"{n}1") - F.col(f"{n}0") <= highest) & (F.col("y0") >= F.col(f"{n}0")) & (F.col("y1") <= F.col(f"{n}1")) & (F.col("x0") >= 0) & (F.col("x1") <= F.col("width")), F.lit(False))
    zone = F.when(inside("h"), 0).when(inside("f"), 2).otherwise(1)
    centre = (F.col("x0") + F.col("x1")) / 2
    joined = joined.withColumn("zone", zone).withColumn("column", F.size(F.filter("edges", lambda e: e < centre)))
    # A separator is listed with every column that it touches; a page has few of both.
    flat = _known(lines).where("abs(y1 - y0) < 5").join(edges, PAGE, "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<double>")))
    first, last = (F.size(F.filter("edges", f)) for f in (lambda e: e < F.col("x0"), lambda e: e <= F.col("x1")))
    cuts = flat.withColumn("column", F.explode(F.sequence(first, F.greatest(first, last)))).groupBy(*PAGE, "column").agg(F.collect_list("y0").alias("cuts"))
    joined = joined.join(cuts, [*PAGE, "column"], "left")
    part = F.coalesce(F.size(F.filter("cuts", lambda y: y <= F.col("y0") + 5)), F.lit(0))
    return joined.withColumn("part", part).select(*elements.columns, "zone", "column", "part")


def adjacent(down: float = 40, across: float = 15) -> Column:
    """Boxes a and b that overlap across at most `down` apart, or overlap down at most `across` apart."""
    return (over("x") & (gap("y") <= down)) | (over("y") & (gap("x") <= across))


def layout_blocks(elements: DataFrame, pages: DataFrame, lines: DataFrame, frames: DataFrame, most: int = 10, width: float = 80, height: float = 60) -> DataFrame:
    """(doc, page, place, kind, column, x0, y0, x1, y1, members): the blocks of each page in reading order.

    elements: doc, page, id, kind (text or image), length (of the text), size (of the letters), box; pages: width, height;
    lines and frames: boxes. Adjacent elements of a column and part are a block; blocks under `width` or
    `height` go. Header first, then by column and down, footer last; ties by x0, then the smallest id. kind: HEADER, FOOTER,
    IMAGE_WITH_CAPTION (texts and images), STANDALONE_IMAGE, ARTICLE, or in a frame, without a headline,
    ADVERTISEMENT (under 200 characters) or SIDEBAR. On pages of over `most` blocks those of a column are joined, two or
    three to a column. Pages without elements have no rows; repeated elements are one.
    """
    known = _known(elements, "id").dropDuplicates([*PAGE, "id"])
    placed = placed_elements(known, pages, lines)
    cell = [*PAGE, "column", "part"]
    body = placed.where("zone = 1")
    roots = connected(body, near_pairs(body, cell, adjacent(), 40), cell).select(*cell, "id", "root")
    joined = placed.join(roots, [*cell, "id"], "left")
    edge_zone = F.col("zone") != 1
    joined = joined.withColumn("root", F.when(~edge_zone, F.col("root"))).withColumn("column", F.when(edge_zone, F.lit(0)).otherwise(F.col("column"))).withColumn("part", F.when(edge_zone, F.lit(0)).otherwise(F.col("part")))
    text, image = F.col("kind") == "text", F.col("kind") == "image"
    found = joined.groupBy(*PAGE, "zone", "column", "part", "root").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("id").alias("first"), F.count("*").alias("members"),
        F.count(F.when(text, 1)).alias("texts"), F.count(F.when(image, 1)).alias("images"), F.coalesce(F.sum(F.when(text, F.col("length"))), F.lit(0)).alias("letters"), F.avg(F.when(text, F.col("size"))).alias("mean"), F.max(F.when(text, F.col("size"))).alias("largest"),
    )
    found = found.where(edge_zone | ((F.col("x1") - F.col("x0") >= width) & (F.col("y1") - F.col("y0") >= height)))
    b, f = found.alias("b"), _known(frames).select(*PAGE, *BOX).alias("f")
    framed = b.join(f, (F.col("b.doc") == F.col("f.doc")) & (F.col("b.page") == F.col("f.page")) & (F.col("b.x0") >= F.col("f.x0") - 10) & (F.col("b.y0") >= F.col("f.y0") - 10) & (F.col("b.x1") <= F.col("f.x1") + 10) & (F.col("b.y1") <= F.col("f.y1") + 10), "left_semi")
    found = found.join(framed.select(*PAGE, "zone", "first", F.lit(True).alias("framed")), [*PAGE, "zone", "first"], "left")
    headline = F.coalesce((F.col("largest") >= 14) & (F.col("largest") >= F.col("mean") * 1.3), F.lit(False))
    kind = F.when(F.col("zone") == 0, "HEADER").when(F.col("zone") == 2, "FOOTER").when((F.col("images") > 0) & (F.col("texts") > 0), "IMAGE_WITH_CAPTION").when(F.col("images") > 0, "STANDALONE_IMAGE").when(F.col("texts") == 0, "UNKNOWN")
    kind = kind.when(headline | F.col("framed").isNull(), "ARTICLE").when(F.col("letters") < 200, "ADVERTISEMENT").otherwise("SIDEBAR")
    found = found.withColumn("kind", kind)
    # Too many blocks: a column's are joined to two or three of nearly equal numbers.
    page, order = Window.partitionBy(*PAGE), ["y0", "x0", "first"]
    column = Window.partitionBy(*PAGE, "zone", "column")
    found = found.withColumn("n", F.count("*").over(page)).withColumn("m", F.count("*").over(column)).withColumn("i", F.row_number().over(column.orderBy(*order)) - 1)
    groups = F.greatest(F.lit(2), F.least(F.lit(3), F.floor(F.col("m") / 2)))
    joins = (F.col("n") > most) & (F.col("m") > 2) & (F.col("zone") == 1)
    found = found.withColumn("group", F.when(joins, F.least(groups - 1, F.floor(F.col("i") / F.floor(F.col("m") / groups)))).otherwise(F.col("i").cast("long")))
    top = F.min_by("kind", F.struct(*order)).alias("kind")
    whole = found.groupBy(*PAGE, "zone", "column", "group").agg(top, F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("first").alias("first"), F.sum("members").alias("members"))
    place = F.row_number().over(page.orderBy("zone", "column", *order)) - 1
    return whole.select(*PAGE, place.alias("place"), "kind", "column", *BOX, "members")


def graphic_regions(drawings: DataFrame, pages: DataFrame, apart: float = 20, rounds: int = 5) -> DataFrame:
    """(doc, page, region, x0, y0, x1, y1, members, curves, lines, rects, fills, colors, score, is_graphic).

    drawings: doc, page, id, box, curves, lines, rects (numbers of items), fill and stroke (colours or null); pages: width,
    height. Boxes at most `apart` from each other along both axes are a region, and regions whose boxes then lie so near are
    one, in at most `rounds` rounds. region: the smallest id. Empty boxes don't count, null numbers are 0.
    """
    items = ["curves", "lines", "rects"]
    known = _known(drawings, "id").where("x1 > x0 and y1 > y0").dropDuplicates([*PAGE, "id"])
    member = known.select(*PAGE, "id", F.col("id").alias("region"))
    boxes = known.select(*PAGE, "id", *BOX)
    for _ in range(rounds):
        pairs = near_pairs(boxes, PAGE, (gap("x") <= apart) & (gap("y") <= apart), apart)
        roots = connected(boxes, pairs, PAGE)
        if roots.where("id <> root").isEmpty():
            break
        member = member.join(roots.withColumnRenamed("id", "region"), [*PAGE, "region"]).select(*PAGE, "id", F.col("root").alias("region"))
        joined = boxes.join(roots, [*PAGE, "id"]).groupBy(*PAGE, F.col("root").alias("id"))
        boxes = joined.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    total = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in items]
    colours = F.size(F.array_distinct(F.flatten(F.collect_set(F.array_compact(F.array("fill", "stroke")))))).alias("colors")
    found = known.join(member, [*PAGE, "id"]).groupBy(*PAGE, "region").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("members"), *total, F.count("fill").alias("fills"), colours)
    found = found.join(pages.select(*PAGE, "width", "height"), PAGE)
    n = F.col("curves") + F.col("lines") + F.col("rects")
    plus = lambda when, x: F.when(when, F.lit(x)).otherwise(F.lit(0.0))
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    only_rects = (F.col("rects") >= 5) & (F.col("curves") == 0) & (F.col("lines") == 0)
    score = plus(F.col("curves") >= n * 0.3, 0.4) + plus(F.col("curves") >= 10, 0.2) + plus(F.col("fills") >= F.greatest(F.lit(1), F.floor(n / 10)) * 0.2, 0.2) + plus(F.col("colors") >= 3, 0.2) + plus((F.col("curves") >= 5) & (F.col("fills") >= 3), 0.3)
    score = score + F.when(only_rects, F.when(F.col("colors") >= 3, 0.2).otherwise(-0.3)).otherwise(0.0)
    score = F.when((n == 0) | ((wide > F.col("width") * 0.9) & (high > F.col("height") * 0.9)), 0.0).otherwise(score)
    score = F.round(score * F.when(wide * high < 500, 0.5).otherwise(1.0), 6)
    scored = found.withColumn("raw", score)
    return scored.select(*PAGE, "region", *BOX, "members", *items, "fills", "colors", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "raw")).alias("score"), (F.col("raw") >= 0.5).alias("is_graphic"))
