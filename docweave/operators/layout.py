"""Positions and geometry as windows and joins: line tables, page lookup, interval merge, islands, overlap, fill-down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, line, start, length) for each line of each text, counted from line 1 and position 0; only lengths are shuffled.

    Repeated doc_ids stay apart. Null texts have no lines, empty ones have one.
    """
    rows = docs.where("text is not null").select("doc_id", F.monotonically_increasing_id().alias("_row"), F.transform(F.split("text", "\n", -1), F.length).alias("n"))
    each = rows.select("doc_id", "_row", F.posexplode("n").alias("i", "length"))
    before = F.sum(F.col("length") + 1).over(Window.partitionBy("_row").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    return each.select("doc_id", (F.col("i") + 1).alias("line"), F.coalesce(before, F.lit(0)).cast("int").alias("start"), "length")


def merged_intervals(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Union of the half-open intervals of each key; intervals that only touch stay apart."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(before.isNull() | (F.col(start) >= before), 1).otherwise(0)).over(order)
    numbered = rows.withColumn("_before", before).withColumn("_island", island)
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def islands(rows: DataFrame, keys: list[str], value: str, gap: float) -> DataFrame:
    """Add cluster (from 0) to rows: values of a key whose sorted neighbours lie at most `gap` apart are together."""
    order = Window.partitionBy(*keys).orderBy(value)
    far = F.coalesce((F.col(value) - F.lag(value).over(order) > gap).cast("int"), F.lit(0))
    return rows.withColumn("_far", far).withColumn("cluster", F.sum("_far").over(order).cast("int")).drop("_far")


def fill_down(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The last value of the rows above where there is none."""
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order)))


def as_of(left: DataFrame, marks: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """Add the value of the last mark at or before each left row's position; both have key and position."""
    none = F.lit(None).cast(dict(marks.dtypes)[value])
    both = left.withColumn(value, none).withColumn("_kind", F.lit(1)).unionByName(marks.select(key, position, value).withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(position, "_kind")
    return both.withColumn(value, F.last(value, ignorenulls=True).over(order)).where("_kind = 1").drop("_kind")


def overlap_ratio(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Area of the intersection of two boxes (x0, y0, x1, y1) as a share of the first one's."""
    wide = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    high = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])
    return F.when(area > 0, wide * high / area).otherwise(F.lit(0.0))


def best_cells(images: DataFrame, cells: DataFrame, least: float = 0.6, keys: list[str] | None = None, tile: float = 50) -> DataFrame:
    """(keys, image, cell, ratio): the cell of most overlap of each image, if that is at least `least`; ties go to the smaller cell.

    keys: what images and cells must share, such as doc and page. Boxes that are alike are compared once, however many images
    and cells have them. Both are dealt to the tiles they touch, so that the join is on equal keys and tiles.
    """
    keys, corners = keys or ["page"], ["x0", "y0", "x1", "y1"]
    box = lambda p: {c: F.col(f"{p}.{c}") for c in corners}
    most = F.max(F.struct("ratio", (-F.col("cell")).alias("m"))).alias("x")

    def tiled(boxes: DataFrame) -> DataFrame:
        for a in "xy":
            first, last = (F.floor(F.col(f"{a}{e}") / tile).cast("int") for e in (0, 1))
            boxes = boxes.withColumn(f"_{a}", F.explode(F.sequence(first, F.greatest(first, last))))
        return boxes

    i = tiled(images.select(*keys, *corners).distinct()).alias("i")
    c = tiled(cells.groupBy(*keys, *corners).agg(F.min("cell").alias("cell"))).alias("c")
    near = (F.col("i.x0") < F.col("c.x1")) & (F.col("c.x0") < F.col("i.x1")) & (F.col("i.y0") < F.col("c.y1")) & (F.col("c.y0") < F.col("i.y1"))
    for k in (*keys, "_x", "_y"):
        near &= F.col(f"i.{k}") == F.col(f"c.{k}")
    found = i.join(c, near).select(*[f"i.{k}" for k in (*keys, *corners)], "c.cell", overlap_ratio(box("i"), box("c")).alias("ratio"))
    best = found.groupBy(*keys, *corners).agg(most).where(F.col("x.ratio") >= least)
    placed = images.select("image", *keys, *corners).join(best, [*keys, *corners]).select(*keys, "image", F.col("x.ratio").alias("ratio"), (-F.col("x.m")).alias("cell"))
    return placed.groupBy(*keys, "image").agg(most).select(*keys, "image", (-F.col("x.m")).alias("cell"), F.col("x.ratio").alias("ratio"))
