"""Frames of tables: what of each side is drawn, sides to complete, and the four parts of a table's grade.

Tables are doc, page, id and a box; strokes are doc, page, id (of the table) and the two ends x0, y0, x1, y1 of a straight
line, x0 <= x1. Numbers given as defaults are fixed values of the document model. Rows with a null among these take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .layout import islands, merged_intervals

TABLE = ["doc", "page", "id"]
BOX = ["x0", "y0", "x1", "y1"]


def strokes_of(items: DataFrame) -> DataFrame:
    """(doc, page, id, x0, y0, x1, y1) of items (doc, page, id, kind, box): lines as they are, rectangles as their four sides."""
    known = items.dropna(subset=[*TABLE, "kind", *BOX]).where("kind in ('l', 're')")
    side = lambda *c: F.struct(*[F.col(x).cast("double").alias(n) for x, n in zip(c, BOX, strict=True)])
    whole = F.array(side("x0", "y0", "x1", "y0"), side("x0", "y1", "x1", "y1"), side("x0", "y0", "x0", "y1"), side("x1", "y0", "x1", "y1"))
    # A line drawn from right to left is turned round.
    turned = F.when(F.col("x0") <= F.col("x1"), side("x0", "y0", "x1", "y1")).otherwise(side("x1", "y1", "x0", "y0"))
    return known.withColumn("s", F.explode(F.when(F.col("kind") == "re", whole).otherwise(F.array(turned)))).select(*TABLE, "s.*")


def _ways(strokes: DataFrame, angle: float) -> DataFrame:
    """strokes with way: h, v or null for slanted ones; at, start and end along it."""
    flat, steep = F.abs(F.col("y1") - F.col("y0")) <= angle, F.abs(F.col("x1") - F.col("x0")) <= angle
    way = F.when(flat, "h").when(steep, "v")
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    return strokes.dropna(subset=[*TABLE, *BOX]).select(*TABLE, way.alias("way"), F.when(flat, low).otherwise(F.col("x0")).alias("at"), F.when(flat, F.col("x0")).otherwise(low).alias("start"), F.when(flat, F.col("x1")).otherwise(high).alias("end"))


def side_gaps(tables: DataFrame, strokes: DataFrame, near: float = 5, angle: float = 2) -> DataFrame:
    """(doc, page, id, side, start, end): what no stroke covers of each side (top, bottom, left, right) of each table, in order.

    A stroke belongs to a side at most `near` away that runs its way; a side wholly covered has no rows.
    """
    known = tables.dropna(subset=[*TABLE, *BOX])
    sides = [("top", "h", "y0", "x"), ("bottom", "h", "y1", "x"), ("left", "v", "x0", "y"), ("right", "v", "x1", "y")]
    one = lambda n, way, at, along: F.struct(F.lit(n).alias("side"), F.lit(way).alias("way"), F.col(at).cast("double").alias("place"), F.col(f"{along}0").cast("double").alias("a"), F.col(f"{along}1").cast("double").alias("b"))
    each = known.select(*TABLE, F.explode(F.array(*[one(*s) for s in sides])).alias("s")).select(*TABLE, "s.*")
    drawn = each.join(_ways(strokes, angle), [*TABLE, "way"]).where(F.abs(F.col("at") - F.col("place")) <= near)
    drawn = drawn.select(*TABLE, "side", F.greatest("start", "a").alias("start"), F.least("end", "b").alias("end")).where("start < end")
    covered = merged_intervals(drawn, [*TABLE, "side"])
    # The gaps lie before each covered range, and after the last one.
    order = Window.partitionBy(*TABLE, "side").orderBy("start")
    before = each.join(covered, [*TABLE, "side"], "left").withColumn("from", F.coalesce(F.lag("end").over(order), F.col("a")))
    inner = before.select(*TABLE, "side", F.col("from").alias("start"), F.coalesce("start", "b").alias("end"))
    last = before.where("start is not null").groupBy(*TABLE, "side", "b").agg(F.max("end").alias("start")).select(*TABLE, "side", "start", F.col("b").alias("end"))
    return inner.union(last).where("start < end")


def completed_frames(tables: DataFrame, strokes: DataFrame, drawn: int = 3, share: float = 0.8, near: float = 5) -> DataFrame:
    """(doc, page, id, side, x0, y0, x1, y1): strokes that close the frames of tables of which `drawn` sides or more are there.

    A side is there if `share` of it is covered; each gap of each side of such a table becomes a stroke on the table's edge.
    Tables whose frames are whole have none.
    """
    known = tables.dropna(subset=[*TABLE, *BOX])
    gaps = side_gaps(known, strokes, near)
    lengths = F.when(F.col("side").isin("top", "bottom"), F.col("x1") - F.col("x0")).otherwise(F.col("y1") - F.col("y0"))
    open_ = gaps.join(known.select(*TABLE, *BOX), TABLE).groupBy(*TABLE, "side").agg((F.sum(F.col("end") - F.col("start")) > F.first(lengths) * (1 - share)).alias("missing"))
    good = open_.groupBy(*TABLE).agg(F.count(F.when(F.col("missing"), 1)).alias("n")).where(F.col("n") <= 4 - drawn).select(*TABLE)
    both = gaps.join(good, TABLE).join(known.select(*TABLE, *BOX), TABLE)
    across = F.col("side").isin("top", "bottom")
    edge = F.when(F.col("side") == "top", F.col("y0")).when(F.col("side") == "bottom", F.col("y1")).when(F.col("side") == "left", F.col("x0")).otherwise(F.col("x1"))
    ends = [F.when(across, F.col("start")).otherwise(edge), F.when(across, edge).otherwise(F.col("start")), F.when(across, F.col("end")).otherwise(edge), F.when(across, edge).otherwise(F.col("end"))]
    return both.select(*TABLE, "side", *[e.alias(n) for e, n in zip(ends, BOX, strict=True)])


def table_parts(tables: DataFrame, items: DataFrame, near: float = 5, angle: float = 2, aligned: float = 3, least: float = 10, longest: float = 20) -> DataFrame:
    """(doc, page, id, border, grid, cells, simplicity), each from 0 to 1, of tables by their items.

    items: doc, page, id, drawing, kind (l, re, c for curves, …), filled, box. border: sides that a stroke within the box lies
    on; grid: 0.6 of the share of strokes that run straight and 0.4 of the mean shares of both ways' strokes at most `aligned` from another;
    cells: 1 less 0.2 for a row or column under `least` and 0.2 for cells over `longest` times as long as wide, 0.5 without
    two strokes each way; simplicity: 1 less up to 0.3 for curves, 0.3 for slanted lines, 0.2 for filled drawings. Tables
    without items have 0, 0, 0.5 and 1.
    """
    known = tables.dropna(subset=[*TABLE, *BOX]).select(*TABLE, *[F.col(c).alias(f"t_{c}") for c in BOX])
    strokes = strokes_of(items)
    ways = _ways(strokes, angle).join(known, TABLE)
    inside = F.when(F.col("way") == "h", (F.col("start") >= F.col("t_x0")) & (F.col("end") <= F.col("t_x1"))).otherwise((F.col("start") >= F.col("t_y0")) & (F.col("end") <= F.col("t_y1")))
    lies = lambda way, edge: F.max(((F.col("way") == way) & inside & (F.abs(F.col("at") - F.col(edge)) <= near)).cast("int"))
    # A stroke that lies on the first of two sides isn't looked at for the second.
    second = lambda way, edge, first: F.max(((F.col("way") == way) & inside & (F.abs(F.col("at") - F.col(edge)) <= near) & (F.abs(F.col("at") - F.col(first)) > near)).cast("int"))
    sides = ways.groupBy(*TABLE).agg((lies("h", "t_y0") + second("h", "t_y1", "t_y0") + lies("v", "t_x0") + second("v", "t_x1", "t_x0")).alias("sides"), F.count("*").alias("n"), F.count("way").alias("straight"))
    straight = ways.where("way is not null").select(*TABLE, "way", "at")
    groups = islands(straight, [*TABLE, "way"], "at", aligned).groupBy(*TABLE, "way", "cluster").agg(F.count("*").alias("m"))
    in_line = groups.groupBy(*TABLE, "way").agg(F.sum("m").alias("all"), F.sum(F.when(F.col("m") > 1, F.col("m")).otherwise(0)).alias("in_line"))
    share = F.when(F.col("all") < 2, 1.0).otherwise(F.col("in_line") / F.col("all"))
    step = F.col("at") - F.lag("at").over(Window.partitionBy(*TABLE, "way").orderBy("at"))
    steps = straight.withColumn("step", F.when(step > 0, step)).groupBy(*TABLE, "way").agg(F.count("*").alias("m"), F.min("step").alias("low"), F.max("step").alias("high"))
    both = in_line.withColumn("share", share).join(steps, [*TABLE, "way"])
    of = lambda way, c: F.max(F.when(F.col("way") == way, F.col(c)))
    pairs = both.groupBy(*TABLE).agg(*[of(w, c).alias(f"{w}_{c}") for w in "hv" for c in ("share", "m", "low", "high")])
    tiny = F.coalesce(F.least("h_low", "v_low") < least, F.lit(False))
    thin = F.coalesce(F.greatest(F.col("h_high") / F.col("v_low"), F.col("v_high") / F.col("h_low")) > longest, F.lit(False))
    cells = F.when((F.coalesce("h_m", F.lit(0)) < 2) | (F.coalesce("v_m", F.lit(0)) < 2), 0.5).otherwise(1 - F.when(tiny, 0.2).otherwise(0.0) - F.when(thin, 0.2).otherwise(0.0))
    grid = F.col("straight") / F.col("n") * 0.6 + (F.coalesce("h_share", F.lit(1.0)) + F.coalesce("v_share", F.lit(1.0))) / 2 * 0.4
    slanted = (F.col("kind") == "l") & (F.abs(F.col("x1") - F.col("x0")) > angle) & (F.abs(F.col("y1") - F.col("y0")) > angle)
    kinds = items.dropna(subset=[*TABLE, "kind"]).groupBy(*TABLE, "drawing").agg(F.count("*").alias("k"), F.count(F.when(F.col("kind") == "c", 1)).alias("curves"), F.count(F.when(slanted, 1)).alias("slanted"), F.max(F.coalesce("filled", F.lit(False)).cast("int")).alias("filled"))
    kinds = kinds.groupBy(*TABLE).agg(F.sum("k").alias("k"), F.sum("curves").alias("curves"), F.sum("slanted").alias("slanted"), F.sum("filled").alias("filled"), F.count("*").alias("drawings"))
    minus = lambda c, of_, by, most: F.least(F.lit(most), F.col(c) / F.col(of_) * by)
    simple = F.when(F.col("k").isNull(), 1.0).otherwise(1 - minus("curves", "k", 3.0, 0.3) - minus("slanted", "k", 3.0, 0.3) - minus("filled", "drawings", 0.4, 0.2))
    simple = F.greatest(F.lit(0.0), simple)
    rated = known.join(sides, TABLE, "left").join(pairs, TABLE, "left").join(kinds, TABLE, "left")
    part = lambda value, none, name: F.round(F.coalesce(value, F.lit(none)), 6).alias(name)
    return rated.select(*TABLE, part(F.col("sides") / 4, 0.0, "border"), part(grid, 0.0, "grid"), part(cells, 0.5, "cells"), part(simple, 1.0, "simplicity"))
