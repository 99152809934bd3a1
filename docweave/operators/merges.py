"""Blocks of a sheet over empty rows and columns, header and data candidates, and merged cells, as joins, islands and rounds.

Rows and columns of sheets count from 1. Numbers given as defaults are fixed values of the document model.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .near import connected, cut

SHEET, PAGE = ["doc", "sheet"], ["doc", "page"]


def gap_merged(blocks: DataFrame, cells: DataFrame, same: float = 0.8) -> DataFrame:
    """(doc, sheet, block, r1, c1, r2, c2, skipped): blocks of a sheet joined over one empty row or column, in order.

    blocks: doc, sheet, r1, c1, r2, c2; cells: doc, sheet, r, c, text, kind, those without text left out.
    1. Blocks of the same rows with one empty column between them are one.
    2. A block takes in the one that begins one empty row below it within its columns (of several the leftmost), and so on
       down, if it has two rows of text or more and the lower's first row of text repeats its own first, which is then
       skipped, or at least `same` of the columns in which both its last and the lower's first row have a kind have the same.
    Both are done in turn until nothing changes. Rows are compared over the upper's columns. skipped: rows that repeat a header.
    Repeated blocks are one; rows with a null in doc, sheet or a number take no part; blocks that overlap stay apart. A
    chain of blocks below each other is one fold.
    """
    box = ["r1", "c1", "r2", "c2"]
    grid = cells.dropna(subset=[*SHEET, "r", "c", "text"]).where("text != ''").dropDuplicates([*SHEET, "r", "c"]).select(*SHEET, "r", "c", "text", "kind")
    rows = cut(grid.groupBy(*SHEET, "r").agg(F.array_sort(F.collect_list(F.struct("c", "text", "kind"))).alias("cells")))
    now = cut(blocks.dropna(subset=[*SHEET, *box]).select(*SHEET, *[F.col(c).cast("int").alias(c) for c in box]).distinct().withColumn("skipped", F.array().cast("array<int>")))
    union = [F.min("r1").alias("r1"), F.min("c1").alias("c1"), F.max("r2").alias("r2"), F.max("c2").alias("c2"), F.array_sort(F.flatten(F.collect_list("skipped"))).alias("skipped")]
    number = F.row_number().over(Window.partitionBy(*SHEET).orderBy(*box))
    while True:
        across = Window.partitionBy(*SHEET, "r1", "r2").orderBy("c1", "c2")
        new = (F.col("c1") == F.lag("c2").over(across) + 2).eqNullSafe(False) | F.lag("c2").over(across).isNull()
        wide = now.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(across))
        wide = wide.groupBy(*SHEET, F.col("r1").alias("_r1"), F.col("r2").alias("_r2"), "_run").agg(*union).drop("_r1", "_r2", "_run")
        named = cut(wide.withColumn("id", number))
        down = cut(_stacked(named, rows, same))
        joined = named.join(down, [*SHEET, "id"], "left").withColumn("skipped", F.concat("skipped", F.coalesce("skips", F.array().cast("array<int>"))))
        before, now = now, cut(joined.groupBy(*SHEET, F.coalesce("head", "id").alias("head")).agg(*union).drop("head"))
        if now.count() == before.count():
            return now.select(*SHEET, (number - 1).alias("block"), *box, "skipped")


def _stacked(blocks: DataFrame, rows: DataFrame, same: float) -> DataFrame:
    """(doc, sheet, id, head, skips) of the blocks that have another above or below: the id of the block they are taken in by."""
    a, b = blocks.alias("a"), blocks.alias("b")
    below = (F.col("a.doc") == F.col("b.doc")) & (F.col("a.sheet") == F.col("b.sheet")) & (F.col("b.r1") == F.col("a.r2") + 2) & (F.col("b.c1") >= F.col("a.c1")) & (F.col("b.c2") <= F.col("a.c2"))
    pairs = a.join(b, below).groupBy("a.doc", "a.sheet", F.col("a.id").alias("a")).agg(F.min_by("b.id", "b.c1").alias("b"))
    pairs = cut(pairs.groupBy(*SHEET, "b").agg(F.min("a").alias("a")))
    members = pairs.select(*SHEET, F.explode(F.array("a", "b")).alias("id")).distinct()
    chains = connected(members, pairs, SHEET)
    # A block's first and last rows of text, with all cells of those rows.
    inner = blocks.join(members, [*SHEET, "id"], "left_semi").withColumn("r", F.explode(F.sequence("r1", "r2"))).join(rows, [*SHEET, "r"])
    inner = inner.where(F.exists("cells", lambda x: x["c"].between(F.col("c1"), F.col("c2")))).groupBy(*SHEET, "id")
    ends = inner.agg(F.min(F.struct("r", "cells")).alias("first"), F.max(F.struct("r", "cells")).alias("last"))
    each = blocks.join(chains, [*SHEET, "id"]).join(ends, [*SHEET, "id"], "left")
    one = F.struct("r1", "id", "c1", "c2", "r2", "first", "last")
    lists = each.groupBy(*SHEET, "root").agg(F.array_sort(F.collect_list(one)).alias("all"))
    within = lambda x, s: F.filter(x, lambda y: y["c"].between(s["c1"], s["c2"]))

    def alike(s, b):
        known = lambda x: F.filter(within(x["cells"], s), lambda y: y["kind"].isNotNull())
        up, low = known(s["last"]), known(b["first"])
        part = lambda x, *names: F.transform(x, lambda y: F.struct(*[y[n].alias(n) for n in names]))
        common = F.size(F.array_intersect(part(up, "c"), part(low, "c")))
        return (common > 0) & (F.size(F.array_intersect(part(up, "c", "kind"), part(low, "c", "kind"))) >= common * same)

    def step(s, b):
        texts = lambda x: F.transform(within(x, s), lambda y: F.struct(y["c"].alias("c"), y["text"].alias("text")))
        ready = (s["r2"] > s["r1"]) & (s["first"]["r"] < s["last"]["r"]) & b["first"].isNotNull()
        again = F.coalesce(ready & (texts(s["first"]["cells"]) == texts(b["first"]["cells"])), F.lit(False))
        joins = again | F.coalesce(ready & alike(s, b), F.lit(False))
        keep = lambda name: F.when(joins, s[name]).otherwise(b[name]).alias(name)
        head = F.when(joins, s["head"]).otherwise(b["id"])
        mark = F.struct(b["id"].alias("id"), head.alias("head"), F.when(again, F.array(b["first"]["r"])).otherwise(F.array().cast("array<int>")).alias("skips"))
        return F.struct(head.alias("head"), keep("c1"), keep("c2"), keep("r1"), b["r2"].alias("r2"), keep("first"), F.coalesce(b["last"], F.when(joins, s["last"])).alias("last"), F.concat(s["out"], F.array(mark)).alias("out"))

    row = lists.schema["all"].dataType.elementType["first"].dataType.simpleString()
    begin = F.lit(None).cast(f"struct<head:int,c1:int,c2:int,r1:int,r2:int,first:{row},last:{row},out:array<struct<id:int,head:int,skips:array<int>>>>")
    begin = F.struct(*[begin[c].alias(c) for c in ("head", "c1", "c2", "r1", "r2", "first", "last")], F.array().cast("array<struct<id:int,head:int,skips:array<int>>>").alias("out"))
    return lists.select(*SHEET, F.explode(F.aggregate("all", begin, step, lambda s: s["out"])).alias("x")).select(*SHEET, "x.id", "x.head", "x.skips")


def header_merged(candidates: DataFrame, most: int = 2, over: float = 5, under: float = 10, share: float = 0.7) -> DataFrame:
    """(doc, page, id, table, missing) for candidate tables (doc, page, id, x0, y0, x1, y1, n_rows, n_cols).

    From top to bottom (ties by x0, then id) a candidate of at most `most` rows takes in the next one, and the next after that,
    as long as it begins at most `over` above and `under` below the end of what was taken, shares `share` of the wider of both
    widths with all that was taken, and has at most one column less than it. table: the id of the first; missing: columns that a
    candidate lacks, over which its second cell (of two or more) spreads. Candidates with a null take no part, repeated ids of a
    page are told apart only by their boxes. A page's candidates are one fold.
    """
    known = candidates.dropna(subset=[*PAGE, "id", "x0", "y0", "x1", "y1", "n_rows", "n_cols"])
    double = lambda *names: [F.col(c).cast("double").alias(c) for c in names]
    one = F.struct(*double("y0", "x0"), F.col("id").cast("long").alias("id"), *double("x1", "y1"), *[F.col(c).cast("long").alias(c) for c in ("n_rows", "n_cols")])
    pages = known.groupBy(*PAGE).agg(F.array_sort(F.collect_list(one)).alias("all"))
    state = "struct<x0:double,x1:double,y1:double,n_cols:bigint,open:boolean,at:int,heads:array<int>>"
    begin = F.from_json(F.lit('{"open":false,"at":0,"heads":[]}'), state)

    def step(s, c):
        wider = F.greatest(s["x1"] - s["x0"], c["x1"] - c["x0"])
        common = F.greatest(F.lit(0.0), F.least(s["x1"], c["x1"]) - F.greatest(s["x0"], c["x0"]))
        fits = (c["y0"] - s["y1"]).between(-over, under) & ((wider <= 0) | (common >= wider * share)) & (s["n_cols"] <= c["n_cols"] + 1)
        joins = s["open"] & F.coalesce(fits, F.lit(False))
        pick = lambda f, name: F.when(joins, f(s[name], c[name])).otherwise(c[name]).alias(name)
        heads = F.when(joins, s["heads"]).otherwise(F.concat(s["heads"], F.array(s["at"])))
        return F.struct(pick(F.least, "x0"), pick(F.greatest, "x1"), c["y1"].alias("y1"), pick(F.greatest, "n_cols"), F.when(joins, True).otherwise(c["n_rows"] <= most).alias("open"), (s["at"] + 1).alias("at"), heads.alias("heads"))

    found = pages.withColumn("heads", F.aggregate("all", begin, step, lambda s: s["heads"]))
    each = found.select(*PAGE, "heads", "all", F.posexplode("all").alias("at", "c"))
    head = F.get("all", F.array_max(F.filter("heads", lambda h: h <= F.col("at"))))
    rows = each.select(*PAGE, F.col("c.id").alias("id"), head["id"].alias("table"), F.col("c.n_cols").alias("n"))
    return rows.select(*PAGE, "id", "table", (F.max("n").over(Window.partitionBy(*PAGE, "table")) - F.col("n")).alias("missing"))


def vertical_merges(cells: DataFrame) -> DataFrame:
    """(doc, id, r, c, row_span, col_span, text): the cells that are shown of rows whose vertical merges go on from above.

    cells: doc, id (of the table), r, i (order in the row), width (columns), merge (none, restart or continue), text. A cell's
    column follows from the widths before it. A cell that continues is shown by the last one above it, over its first column,
    that doesn't; without any it is shown itself. A restart spans the unbroken run of rows below that go on with it. Null
    widths are 1, null merges none; rows with a null doc, id, r or i take no part.
    """
    key = ["doc", "id"]
    known = cells.dropna(subset=[*key, "r", "i"])
    width = F.greatest(F.lit(1), F.coalesce("width", F.lit(1)))
    before = F.sum("width").over(Window.partitionBy(*key, "r").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    placed = known.select(*key, "r", "i", width.alias("width"), F.coalesce("merge", F.lit("none")).alias("merge"), "text").withColumn("c", F.coalesce(before, F.lit(0)).cast("int"))
    goes_on = F.col("merge") == "continue"
    # Every column of a cell, so that what is above a column is found whatever it begins in.
    each = placed.withColumn("column", F.explode(F.sequence(F.col("c"), (F.col("c") + F.col("width") - 1).cast("int"))))
    owner = F.last(F.when(~goes_on, F.struct("r", "c", "width", "merge")), ignorenulls=True).over(Window.partitionBy(*key, "column").orderBy("r"))
    owned = each.withColumn("owner", owner).where(F.col("column") == F.col("c"))
    alone = owned.where(~goes_on | F.col("owner").isNull())
    down = owned.where(goes_on & (F.col("owner.merge") == "restart") & (F.col("owner.c") == F.col("c")) & (F.col("owner.width") == F.col("width")))
    run = Window.partitionBy(*key, "c", "owner").orderBy("r")
    reached = down.withColumn("n", F.row_number().over(run)).where(F.col("r") == F.col("owner.r") + F.col("n"))
    spans = reached.groupBy(*key, F.col("owner.r").alias("r"), F.col("owner.c").alias("c")).agg((F.count("*") + 1).cast("int").alias("row_span"))
    return alone.join(spans, [*key, "r", "c"], "left").select(*key, "r", "c", F.coalesce("row_span", F.lit(1)).alias("row_span"), F.col("width").cast("int").alias("col_span"), "text")


def uncovered(cells: DataFrame) -> DataFrame:
    """Cells (doc, id, r, c, row_span, col_span, …) that no other cell of their table covers, by an anti-join on grid places.

    Spans below 1 or null count as 1. A cell is covered by any other whose spans reach it, itself covered or not.
    """
    key = ["doc", "id"]
    span = lambda c: F.greatest(F.lit(1), F.coalesce(f"{c}_span", F.lit(1)))
    wide = cells.where((span("row") > 1) | (span("col") > 1)).select(*key, F.col("r").alias("r0"), F.col("c").alias("c0"), span("row").alias("rs"), span("col").alias("cs"))
    reach = wide.withColumn("r", F.explode(F.expr("sequence(r0, cast(r0 + rs - 1 as int))"))).withColumn("c", F.explode(F.expr("sequence(c0, cast(c0 + cs - 1 as int))")))
    return cells.join(reach.where("r != r0 or c != c0").select(*key, "r", "c"), [*key, "r", "c"], "left_anti").select(cells.columns)


def table_cells(docs: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """(key, id, r, i, row_span, col_span, header, text): the cells of the tables in HTML texts, tables counted from 0, rows and cells from 1.

    Text without tags and white space squeezed. Spans that aren't numbers are 1, others lie from 1 to 1000. A table
    within a table ends the outer one's text where it begins; null texts have no tables.
    """
    tables = docs.where(F.col(html).isNotNull()).select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<table\b[^>]*>(.*?)(?=</table>|<table\b|$)"), F.lit(1))).alias("id", "t"))
    rows = tables.select(key, "id", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=<tr\b|</tr>|$)"), F.lit(1))).alias("r", "row"))
    cells = rows.select(key, "id", (F.col("r") + 1).alias("r"), F.posexplode(F.regexp_extract_all("row", F.lit(r"(?is)<t[dh]\b[^>]*>.*?(?=<t[dh]\b|</t[dh]>|$)"), F.lit(0))).alias("i", "cell"))
    tag = F.regexp_extract("cell", r"(?is)^<t[dh]\b[^>]*>", 0)
    span = lambda name: F.least(F.lit(1000), F.greatest(F.lit(1), F.coalesce(F.regexp_extract(tag, rf"""(?i)\b{name}\s*=\s*["']?\s*(\d+)""", 1).try_cast("int"), F.lit(1))))
    text = F.trim(F.regexp_replace(F.regexp_replace("cell", r"(?s)<[^>]*>", " "), r"\s+", " "))
    return cells.select(key, "id", "r", (F.col("i") + 1).alias("i"), span("rowspan").alias("row_span"), span("colspan").alias("col_span"), F.lower(F.substring("cell", 3, 1)).eqNullSafe("h").alias("header"), text.alias("text"))


def _columns(tables: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Of each table the column of each cell (in order of rows and cells), by rows and spans."""
    for rows, row_spans, col_spans in tables:
        out = []
        for table in zip(rows, row_spans, col_spans, strict=True):
            taken: list[int] = []  # the last row that each column is taken in
            places, at, last = [], 0, None
            for r, down, across in zip(*table, strict=True):
                at = at if r == last else 0
                last = r
                while at < len(taken) and taken[at] >= r:
                    at += 1
                taken += [0] * (at + across - len(taken))
                for c in range(at, at + across):
                    taken[c] = max(taken[c], r + down - 1)
                at += across
                places.append(at - across + 1)
            out.append(places)
        yield pd.Series(out)


def placed_cells(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add c, from 1, to cells (key, id, r, i, row_span, col_span, …): a cell begins in the first column, after the one before it
    in its row, that no cell of the rows above or before it takes.

    A table is the largest group; spans of null count as 1; null keys, rows or places take no part.
    """
    known = cells.dropna(subset=[key, "id", "r", "i"])
    rest = [c for c in cells.columns if c not in (key, "id")]
    tables = known.groupBy(key, "id").agg(F.sort_array(F.collect_list(F.struct("r", "i", *[c for c in rest if c not in ("r", "i")]))).alias("all"))
    place = F.pandas_udf(_columns, "array<int>")
    part = lambda name, none: F.transform("all", lambda x: F.coalesce(x[name], F.lit(none)))
    found = tables.withColumn("columns", place(part("r", 0), part("row_span", 1), part("col_span", 1)))
    each = found.select(key, "id", F.explode(F.arrays_zip("all", "columns")).alias("x"))
    return each.select(key, "id", *[F.col(f"x.all.{c}").alias(c) for c in rest], F.col("x.columns").alias("c"))
