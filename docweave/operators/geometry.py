"""Page geometry as windows, range joins and small folds: columns, bands, tables and their candidates, components, elements.

Boxes are columns x0, y0, x1, y1 in points, y growing downwards. Every function groups by (doc, page) or (doc, sheet), so
one page is the largest group.
"""

from __future__ import annotations

import pandas as pd
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import islands
from .near import connected, cut

PAGE = ["doc", "page"]


def layout_columns(blocks: DataFrame, gap: float = 30, least: int = 3, apart: float = 20) -> DataFrame:
    """(doc, page, column, left, members, boundary): clusters of block starts; boundary lies midway to the next one.

    Blocks of 20 characters or fewer and clusters under `least` members don't count; boundary is null without a next
    cluster at least `apart` away.
    """
    near = islands(blocks.where(F.length("text") > 20), PAGE, "x0", gap)
    found = near.groupBy(*PAGE, "cluster").agg(F.avg("x0").alias("left"), F.count("*").alias("members")).where(F.col("members") >= least)
    order = Window.partitionBy(*PAGE).orderBy("left")
    after = F.lead("left").over(order)
    middle = F.when(after - F.col("left") >= apart, (F.col("left") + after) / 2)
    return found.select(*PAGE, F.row_number().over(order).alias("column"), "left", "members", middle.alias("boundary"))


def bands(blocks: DataFrame, pages: DataFrame, margin: float = 0.1, highest: float = 60) -> DataFrame:
    """(doc, page, header_end, footer_start) of the text wholly in the top or bottom margin; null if there is none or it is too high."""
    both = blocks.join(pages.select(*PAGE, "height"), PAGE)
    top, bottom = F.col("y1") <= F.col("height") * margin, F.col("y0") >= F.col("height") * (1 - margin)
    found = both.groupBy(*PAGE).agg(*[f(F.when(side, F.col(c))).alias(name) for side, f, c, name in ((top, F.min, "y0", "a"), (top, F.max, "y1", "b"), (bottom, F.min, "y0", "c"), (bottom, F.max, "y1", "d"))])
    return found.select(*PAGE, F.when(F.col("b") - F.col("a") <= highest, F.col("b")).alias("header_end"), F.when(F.col("d") - F.col("c") <= highest, F.col("c")).alias("footer_start"))


def shared_area(a: str, b: str) -> Column:
    """Area that the boxes of two aliases have in common."""
    side = lambda x: F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{x}1"), F.col(f"{b}.{x}1")) - F.greatest(F.col(f"{a}.{x}0"), F.col(f"{b}.{x}0")))
    return side("x") * side("y")


def lines_outside_tables(lines: DataFrame, tables: DataFrame, least: float = 0.5) -> DataFrame:
    """Lines of which less than `least` of their area lies in any one table of their page: an anti-join on overlap."""
    line, table = lines.alias("l"), tables.alias("t")
    area = (F.col("l.x1") - F.col("l.x0")) * (F.col("l.y1") - F.col("l.y0"))
    inside = (F.col("l.doc") == F.col("t.doc")) & (F.col("l.page") == F.col("t.page")) & (area > 0) & (shared_area("l", "t") >= area * least)
    return line.join(table, inside, "left_anti")


def adjacent_tables(tables: DataFrame, gap: float = 30, overlap: float = 0.8) -> DataFrame:
    """Add part (from 0): tables of a page that follow each other within `gap` points, share `overlap` of the narrower width and have equal columns, or a one-row header of fewer columns above, are one."""
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "id")
    up = lambda c: F.lag(c).over(order)
    distance = F.col("y0") - up("y1")
    common = F.least("x1", up("x1")) - F.greatest("x0", up("x0"))
    narrow = F.least(F.col("x1") - F.col("x0"), up("x1") - up("x0"))
    joins = distance.between(0, gap) & (common >= narrow * overlap) & ((F.col("n_cols") == up("n_cols")) | ((up("n_rows") == 1) & (up("n_cols") < F.col("n_cols"))))
    first = tables.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    return first.withColumn("part", (F.sum("_new").over(order) - 1).cast("int")).drop("_new")


def candidate_scores(cells: DataFrame, boxes: DataFrame | None = None, least: float = 0.35) -> DataFrame:
    """(doc, page, id, n_rows, n_cols, fill, confidence, kept): what speaks for and against each candidate table.

    cells: doc, page, id, r, c, text; boxes, where they are known: doc, page, id, y0, y1, x0, x1, height (of the page), told (whether
    the cells were told by the file rather than guessed). Confidence 0 for fewer than two rows or columns, a cell of over 800 characters, over
    0.6 of the filled cells being paragraphs, or two columns of which the first is empty in 0.6 of the rows and the second
    over 80 characters long in 0.3. Null texts are empty; rows with a null doc, page, id, r or c take no part.
    """
    known = cells.dropna(subset=[*PAGE, "id", "r", "c"])
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    known = known.select(*PAGE, "id", "r", "c", text.alias("text"), F.length(text).alias("n"), F.size(F.split(text, r"\s+")).alias("words"), text.rlike("[.。?!,、]").alias("marks"))
    n, words, marks = F.col("n"), F.col("words"), F.col("marks")
    # How long texts of how many words are paragraphs, and the limits and penalties below.
    paragraph = ((n >= 100) & (words >= 8) & marks) | ((n >= 150) & marks) | ((n >= 80) & (words >= 10))
    count = lambda when: F.count(F.when(when, 1))
    rows = known.groupBy(*PAGE, "id", "r").agg(
        F.count("*").alias("cells"), count(n > 0).alias("full"), F.max("c").alias("c"), count(n >= 2).alias("meaning"), count(n > 300).alias("long"), F.max("n").alias("longest"), F.sum("n").alias("letters"), count(paragraph).alias("paragraphs"),
        F.max(F.when(F.col("c") == 0, n)).alias("first"), F.max(F.when(F.col("c") == 1, n)).alias("second"),
    )
    found = rows.groupBy(*PAGE, "id").agg(
        F.count("*").alias("n_rows"), (F.max("c") + 1).cast("long").alias("n_cols"), *[F.sum(x).alias(x) for x in ("cells", "full", "meaning", "long", "letters", "paragraphs")], count(F.col("full") == 0).alias("bare"), F.max("longest").alias("longest"),
        count(F.col("second").isNotNull() & (F.coalesce("first", F.lit(0)) == 0)).alias("blank_first"), count(F.col("second") > 80).alias("long_second"),
    )
    fill = F.col("full") / F.col("cells")
    minus = lambda when, x: F.when(when, F.lit(x)).otherwise(F.lit(0.0))
    base, more = F.lit(1.1), F.lit(0.0)
    if boxes is not None:
        found = found.join(boxes.select(*PAGE, "id", "x0", "y0", "x1", "y1", "height", "told"), [*PAGE, "id"])
        area, high = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.col("y1") - F.col("y0")
        base = F.when(F.col("told"), 1.1).otherwise(1.0)
        more = minus((area <= 0) | (F.col("letters") * 50 < area * 0.005), 0.1) + minus((high > F.col("height") * 0.7) & (F.col("n_rows") > 15) & (F.col("n_cols") == 2), 0.15)
    score = base - minus(fill < 0.05, 0.3) - minus((fill >= 0.05) & (fill < 0.15), 0.15) - minus(F.col("bare") >= F.col("n_rows") * 0.7, 0.15) - minus(F.col("meaning") < 2, 0.15) - minus(F.col("n_rows") - F.col("bare") < 2, 0.15)
    score = score - minus(F.col("n_cols") > 5 * F.col("n_rows"), 0.1) - minus(F.col("long") > 0.4 * F.col("full"), 0.2) - minus(F.col("paragraphs") > 0.1 * F.greatest(F.lit(1), F.col("full")), 0.15) - more
    two = (F.col("n_cols") == 2) & (F.col("blank_first") >= F.col("n_rows") * 0.6) & (F.col("long_second") >= F.col("n_rows") * 0.3)
    bad = (F.col("n_rows") < 2) | (F.col("n_cols") < 2) | (F.col("longest") > 800) | two | (F.col("paragraphs") > 0.6 * F.greatest(F.lit(1), F.col("full")))
    confidence = F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    scored = found.select(*PAGE, "id", "n_rows", "n_cols", F.round(fill, 6).alias("fill"), F.round(confidence, 6).alias("confidence"))
    return scored.withColumn("kept", F.col("confidence") >= least)


def best_candidates(candidates: DataFrame, most: float = 0.3, weight: float = 0.15) -> DataFrame:
    """Candidates that stay when each page takes them by confidence less `weight` times priority, leaving out those that
    share `most` or more of either box's area with one already taken; ties go to the smaller id."""

    def taken(page: pd.DataFrame) -> pd.DataFrame:
        rank = page["confidence"] - weight * page["priority"]
        page = page.assign(_rank=rank).sort_values(["_rank", "id"], ascending=[False, True]).drop(columns="_rank")
        kept: list[int] = []
        boxes = page[["x0", "y0", "x1", "y1"]].to_numpy()
        area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
        for i, b in enumerate(boxes):
            other = boxes[kept]
            wide = (other[:, 2].clip(max=b[2]) - other[:, 0].clip(min=b[0])).clip(min=0)
            high = (other[:, 3].clip(max=b[3]) - other[:, 1].clip(min=b[1])).clip(min=0)
            shared = wide * high
            if not ((shared >= most * area[i]) | (shared >= most * area[kept])).any():
                kept.append(i)
        return page.iloc[kept]

    return candidates.groupBy(*PAGE).applyInPandas(taken, candidates.schema)


def cell_runs(cells: DataFrame) -> DataFrame:
    """(doc, sheet, r, c1, c2): unbroken runs of occupied cells in each row, by gaps and islands."""
    order = Window.partitionBy("doc", "sheet", "r").orderBy("c")
    numbered = cells.select("doc", "sheet", "r", "c").distinct().withColumn("_i", F.col("c") - F.row_number().over(order))
    return numbered.groupBy("doc", "sheet", "r", "_i").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).drop("_i")


def touching_runs(runs: DataFrame) -> DataFrame:
    """(doc, sheet, a, b): ids of runs (doc, sheet, id, r, c1, c2) of neighbouring rows that share a column.

    Runs of one row are apart, so of two that share a column the one that starts later need only look at the last run of
    the other row that has started: a window over two rows, without pairing all their runs.
    """
    lower = F.explode(F.array(F.lit(0), F.lit(1)))
    both = runs.withColumn("_lower", lower).withColumn("_pair", F.col("r") - F.col("_lower"))
    so_far = Window.partitionBy("doc", "sheet", "_pair").orderBy("c1", "_lower").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda side: F.last(F.when(F.col("_lower") == side, F.struct("id", "c2")), ignorenulls=True).over(so_far)
    met = both.withColumn("_last0", last(0)).withColumn("_last1", last(1))
    met = met.select("doc", "sheet", "c1", F.col("id").alias("a"), F.when(F.col("_lower") == 0, F.col("_last1")).otherwise(F.col("_last0")).alias("_other"))
    return met.where("_other.c2 >= c1").select("doc", "sheet", "a", F.col("_other.id").alias("b"))


def _rooted(band: pd.DataFrame) -> pd.DataFrame:
    """A band's runs with root, the smallest id of those that hang together within the band."""
    band = band.sort_values(["r", "c1"], ignore_index=True)
    root = list(range(len(band)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    rows = {r: list(g) for r, g in band.groupby("r").groups.items()}
    c1, c2 = band["c1"].tolist(), band["c2"].tolist()
    for r in sorted(rows):
        above, k = rows.get(r - 1, []), 0
        for i in rows[r]:
            while k < len(above) and c2[above[k]] < c1[i]:
                k += 1
            j = k
            while j < len(above) and c1[above[j]] <= c2[i]:
                x, y = find(i), find(above[j])
                root[max(x, y)] = min(x, y)
                j += 1
    ids = band["id"].to_numpy()
    return band.assign(root=ids[[find(i) for i in range(len(band))]])


def components(cells: DataFrame, rows: int = 64) -> DataFrame:
    """(doc, sheet, block, r1, c1, r2, c2, runs): boxes of the cells that touch in rows or columns, counted by top and left.

    Runs come from windows over a row. Bands of `rows` rows (two at least), however long the sheet, are joined in a task
    each; what they leave is linked over their borders and joined by rounds of Spark joins. Boxes that tie count by
    bottom, right, then their first run. Repeated cells count once, cells without doc, sheet, r or c are left out, an
    empty table gives none.
    """
    keys = ["doc", "sheet"]
    runs = cell_runs(cells.dropna(subset=[*keys, "r", "c"]))
    runs = runs.withColumn("id", F.col("r").cast("long") * 2**31 + F.col("c1")).withColumn("band", F.floor(F.col("r") / rows))
    banded = cut(runs.groupBy(*keys, "band").applyInPandas(_rooted, ", ".join(f"{c} {t}" for c, t in runs.dtypes) + ", root long"))
    borders = touching_runs(banded.where(F.pmod("r", F.lit(rows)).isin(0, rows - 1))).join(banded.select(*keys, F.col("id").alias("a"), F.col("root").alias("ra"), F.col("band").alias("ba")), [*keys, "a"])
    borders = borders.join(banded.select(*keys, F.col("id").alias("b"), F.col("root").alias("rb"), F.col("band").alias("bb")), [*keys, "b"]).where("ba <> bb")
    edges = cut(borders.select(*keys, F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    nodes = edges.select(*keys, F.col("a").alias("id")).union(edges.select(*keys, F.col("b").alias("id")))
    over = connected(nodes, edges, keys).select(*keys, F.col("id").alias("root"), F.col("root").alias("whole"))
    ranges = [f(c).cast("int").alias(n) for f, c, n in ((F.min, "r", "r1"), (F.min, "c1", "c1"), (F.max, "r", "r2"), (F.max, "c2", "c2"))]
    parts = banded.groupBy(*keys, "root").agg(*ranges, F.count("*").alias("runs")).join(over, [*keys, "root"], "left")
    box = [F.min("r1").alias("r1"), F.min("c1").alias("c1"), F.max("r2").alias("r2"), F.max("c2").alias("c2"), F.sum("runs").alias("runs")]
    found = parts.groupBy(*keys, F.coalesce("whole", "root").alias("root")).agg(*box)
    block = F.row_number().over(Window.partitionBy(*keys).orderBy("r1", "c1", "r2", "c2", "root")) - 1
    return found.select(*keys, block.alias("block"), "r1", "c1", "r2", "c2", "runs")


def merged_elements(elements: DataFrame) -> DataFrame:
    """(doc, page, text): elements of a page joined by line ends from top to bottom and left to right, tables set off by one more."""
    content = F.when(F.col("type") == "table", F.concat(F.lit("\n"), "content", F.lit("\n"))).otherwise(F.col("content"))
    parts = F.array_sort(F.collect_list(F.struct("y0", "x0", "seq", content.alias("t"))))
    return elements.where("trim(content) != ''").groupBy(*PAGE).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text"))


def complexity(pages: DataFrame) -> DataFrame:
    """Add score, level and strategy to pages (width, height, n_drawings, n_curves, n_fills, n_images, n_columns, text_quality, complex_share)."""
    area = F.col("width") * F.col("height")
    steps = lambda x, cuts: F.when(x >= cuts[2][0], cuts[2][1]).when(x >= cuts[1][0], cuts[1][1]).when(x >= cuts[0][0], cuts[0][1]).otherwise(0.0)
    share = lambda c: F.when(F.col("n_drawings") > 0, F.col(c) / F.col("n_drawings")).otherwise(0.0)
    drawn = F.least(F.lit(1.0), steps(F.col("n_drawings") * 1000 / area, ((0.5, 0.4), (2, 0.7), (5, 1.0))) + share("n_curves") * 0.2 + share("n_fills") * 0.1)
    images = steps(F.col("n_images") * 10000 / area, ((0.1, 0.3), (0.3, 0.6), (0.5, 1.0)))
    columns = F.when(F.col("n_columns") >= 7, 0.95).otherwise(steps(F.col("n_columns"), ((2, 0.3), (3, 0.5), (5, 0.75))))
    score = drawn * 0.3 + images * 0.2 + (1 - F.col("text_quality")) * 0.25 + columns * 0.25
    score = F.round(F.when(columns >= 0.95, F.greatest(score, F.lit(0.9))).otherwise(score), 6)
    level = F.when(F.col("score") >= 0.9, "EXTREME").when(F.col("score") >= 0.65, "COMPLEX").when(F.col("score") >= 0.35, "MODERATE").otherwise("SIMPLE")
    quality = F.col("text_quality")
    full = (quality < 0.4) | ((F.col("level") == "EXTREME") & (quality < 0.6)) | ((F.col("complex_share") > 0.5) & (quality < 0.7))
    strategy = F.when(full, "FULL_PAGE_OCR").when(F.col("level").isin("COMPLEX", "MODERATE"), "HYBRID").otherwise("TEXT")
    return pages.withColumn("score", score).withColumn("level", level).withColumn("strategy", strategy)


def notes_of_tables(lines: DataFrame, tables: DataFrame, above: float = 3, below: float = 30) -> DataFrame:
    """(doc, page, id, notes): footnote lines from `above` points over to `below` points under a table's lower edge, in order."""
    notes = lines.where(F.col("text").rlike(r"^\s*(주\)|※|\*|†|‡|Note)")).alias("l")
    t = tables.alias("t")
    under = (F.col("l.doc") == F.col("t.doc")) & (F.col("l.page") == F.col("t.page")) & (F.col("l.y0") - F.col("t.y1")).between(-above, below) & (F.col("l.x0") < F.col("t.x1")) & (F.col("t.x0") < F.col("l.x1"))
    found = notes.join(t, under).groupBy("t.doc", "t.page", "t.id").agg(F.array_sort(F.collect_list(F.struct("l.y0", "l.x0", "l.text"))).alias("n"))
    return found.select("doc", "page", "id", F.array_join(F.transform("n", lambda x: x["text"]), "\n").alias("notes"))
