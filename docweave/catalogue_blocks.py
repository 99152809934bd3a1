"""Registered queries of page blocks, graphic regions, merges and placed cells, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import BOXES, boxes, query, table
from .operators import blocks as B
from .operators import merges as M

PAGES = "select distinct doc, page, 600.0::double as width, 800.0::double as height from b"


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    kind = F.when(F.col("id") % 7 == 0, "image").otherwise("text")
    return b.select("doc", "page", "id", kind.alias("kind"), (F.col("id") % 90).alias("length"), (F.col("id") % 3 * 4 + 9).cast("double").alias("size"), (F.floor(F.col("x0") / 130) * 130 + F.col("x0") % 9).alias("x0"), "y0", (F.floor(F.col("x0") / 130) * 130 + F.col("x0") % 9 + 110).alias("x1"), "y1")


def _pages(rows: DataFrame) -> DataFrame:
    return rows.select("doc", "page").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(800.0)})


LAYOUT = f"""
with recursive b as (
  select * from ({BOXES})
), p as (
  {PAGES}
), e as (
  select doc, page, id, case when id % 7 = 0 then 'image' else 'text' end as kind, id % 90 as length, cast(id % 3 * 4 + 9 as double) as size,
    floor(x0 / 130) * 130 + x0 % 9 as x0, y0, floor(x0 / 130) * 130 + x0 % 9 + 110 as x1, y1
  from b
), far as (
  select doc, page, x0, coalesce(cast(x0 - lag(x0) over (partition by doc, page order by x0) > 30 as int), 0) as far
  from e where kind = 'text' and length > 20
), clusters as (
  select doc, page, k, avg(x0) as m from (select *, sum(far) over (partition by doc, page order by x0) as k from far)
  group by doc, page, k having count(*) >= 3
), edges as (
  select doc, page, (m + n) / 2 as edge from (select *, lead(m) over (partition by doc, page order by m) as n from clusters) where n - m >= 20
), bands as (
  select doc, page,
    min(case when kind = 'text' and y1 <= 80 then y0 end) as h0, max(case when kind = 'text' and y1 <= 80 then y1 end) as h1,
    min(case when kind = 'text' and y0 >= 720 then y0 end) as f0, max(case when kind = 'text' and y0 >= 720 then y1 end) as f1
  from e group by doc, page
), placed as (
  select e.*, case when h1 - h0 <= 60 and y0 >= h0 and y1 <= h1 and x0 >= 0 and x1 <= 600 then 0
      when f1 - f0 <= 60 and y0 >= f0 and y1 <= f1 and x0 >= 0 and x1 <= 600 then 2 else 1 end as zone,
    (select count(*) from edges d where d.doc = e.doc and d.page = e.page and d.edge < (x0 + x1) / 2) as col
  from e join bands using (doc, page)
), lines as (
  select doc, page, x0, y0, x1 from b where id % 11 = 0
), cuts as (
  select l.*, (select count(*) from edges d where d.doc = l.doc and d.page = l.page and d.edge < l.x0) as c0,
    (select count(*) from edges d where d.doc = l.doc and d.page = l.page and d.edge <= l.x1) as c1
  from lines l
), parts as (
  select p.*, (select count(*) from cuts c where c.doc = p.doc and c.page = p.page and p.col between c.c0 and c.c1 and c.y0 <= p.y0 + 5) as part from placed p
), body as (
  select * from parts where zone = 1
), pairs as (
  select a.id as a, b.id as b from body a join body b on a.doc = b.doc and a.page = b.page and a.col = b.col and a.part = b.part and a.id <> b.id
  where (greatest(a.x0, b.x0) < least(a.x1, b.x1) and greatest(0, b.y0 - a.y1, a.y0 - b.y1) <= 40)
    or (greatest(a.y0, b.y0) < least(a.y1, b.y1) and greatest(0, b.x0 - a.x1, a.x0 - b.x1) <= 15)
), reach as (
  select id, id as other from body union select r.id, p.b from reach r join pairs p on p.a = r.other
), roots as (
  select id, min(other) as root from reach group by id
), joined as (
  select p.doc, p.page, zone, case when zone = 1 then col else 0 end as col, case when zone = 1 then part else 0 end as part, root, p.*
  from parts p left join roots using (id)
), found as (
  select doc, page, zone, col, part, root, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, min(id) as first, count(*) as members,
    count(*) filter (kind = 'text') as texts, count(*) filter (kind = 'image') as images, coalesce(sum(length) filter (kind = 'text'), 0) as letters,
    avg(size) filter (kind = 'text') as mean, max(size) filter (kind = 'text') as largest
  from joined group by doc, page, zone, col, part, root
  having zone <> 1 or (max(x1) - min(x0) >= 80 and max(y1) - min(y0) >= 60)
), frames as (
  select doc, page, x0 - 40 as x0, y0 - 60 as y0, x1 + 120 as x1, y1 + 120 as y1 from b where id % 5 = 0
), kinds as (
  select f.*, case when zone = 0 then 'HEADER' when zone = 2 then 'FOOTER' when images > 0 and texts > 0 then 'IMAGE_WITH_CAPTION' when images > 0 then 'STANDALONE_IMAGE'
      when coalesce(largest >= 14 and largest >= mean * 1.3, false) or not exists (select 1 from frames r where r.doc = f.doc and r.page = f.page
        and f.x0 >= r.x0 - 10 and f.y0 >= r.y0 - 10 and f.x1 <= r.x1 + 10 and f.y1 <= r.y1 + 10) then 'ARTICLE'
      when letters < 200 then 'ADVERTISEMENT' else 'SIDEBAR' end as kind,
    count(*) over (partition by doc, page) as n, count(*) over (partition by doc, page, zone, col) as m,
    row_number() over (partition by doc, page, zone, col order by y0, x0, first) - 1 as i
  from found f
), grouped as (
  select *, case when n > 4 and m > 2 and zone = 1 then least(greatest(2, least(3, m // 2)) - 1, i // (m // greatest(2, least(3, m // 2)))) else i end as g from kinds
), whole as (
  select doc, page, zone, col, g, arg_min(kind, i) as kind, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, min(first) as first, sum(members) as members
  from grouped group by doc, page, zone, col, g
)
select doc, page, cast(row_number() over (partition by doc, page order by zone, col, y0, x0, first) - 1 as int) as place, kind, cast(col as int) as "column",
  x0, y0, x1, y1, cast(members as bigint) as members
from whole
"""


@query(LAYOUT)
def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pages of part boxes moved to three columns; some boxes are images, their upper edges separators, or frames."""
    b = boxes(spark, sf_dir)
    lines = b.where("id % 11 = 0").select("doc", "page", "x0", "y0", "x1", (F.col("y0") + 2).alias("y1"))
    frames = b.where("id % 5 = 0").selectExpr("doc", "page", "x0 - 40 as x0", "y0 - 60 as y0", "x1 + 120 as x1", "y1 + 120 as y1")
    return B.layout_blocks(_elements(spark, sf_dir), _pages(b), lines, frames, most=4)


def _graphic_sql(rounds: int = 5) -> str:
    """Rounds of joining as so many recursive tables."""
    near = "a.doc = b.doc and a.page = b.page and greatest(0, b.x0 - a.x1, a.x0 - b.x1) <= 20 and greatest(0, b.y0 - a.y1, a.y0 - b.y1) <= 20"
    out = [f"with recursive b as ({BOXES})", "d as (select doc, page, id, x0, y0, x0 + (x1 - x0) / 4 as x1, y0 + (y1 - y0) / 3 as y1, id % 4 * 2 as curves, id % 5 as lines, id % 3 * 2 as rects, case when id % 2 = 0 then 'c' || id % 4 end as fill, case when id % 3 = 0 then 'c' || id % 6 end as stroke from b)"]
    out.append("n0 as (select doc, page, id, id as region, x0, y0, x1, y1 from d)")
    for i in range(1, rounds + 1):
        out.append(f"g{i} as (select doc, page, region as id, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from n{i - 1} group by all)")
        out.append(f"p{i} as (select a.id as a, b.id as b from g{i} a join g{i} b on {near} and a.id <> b.id)")
        out.append(f"r{i} as (select id, id as other from g{i} union select r.id, p.b from r{i} r join p{i} p on p.a = r.other)")
        out.append(f"n{i} as (select n.doc, n.page, n.id, m.root as region, n.x0, n.y0, n.x1, n.y1 from n{i - 1} n join (select id, min(other) as root from r{i} group by id) m on m.id = n.region)")
    out.append(
        f"f as (select n.doc, n.page, region, min(n.x0) as x0, min(n.y0) as y0, max(n.x1) as x1, max(n.y1) as y1, count(*) as members, cast(sum(curves) as bigint) as curves, cast(sum(lines) as bigint) as lines, cast(sum(rects) as bigint) as rects, count(fill) as fills, cast(len(list_distinct(list_filter(list(fill) || list(stroke), lambda c: c is not null))) as int) as colors from n{rounds} n join d using (id) group by n.doc, n.page, region)"
    )
    score = "case when curves >= (curves + lines + rects) * 0.3 then 0.4 else 0 end + case when curves >= 10 then 0.2 else 0 end + case when fills >= greatest(1, (curves + lines + rects) // 10) * 0.2 then 0.2 else 0 end + case when colors >= 3 then 0.2 else 0 end + case when curves >= 5 and fills >= 3 then 0.3 else 0 end + case when rects >= 5 and curves = 0 and lines = 0 then case when colors >= 3 then 0.2 else -0.3 end else 0 end"
    out.append(f"s as (select *, cast(round(case when curves + lines + rects = 0 or (x1 - x0 > 540 and y1 - y0 > 720) then 0 else {score} end * case when (x1 - x0) * (y1 - y0) < 500 then 0.5 else 1 end, 6) as double) as raw from f)")
    return ", ".join(out) + " select doc, page, region, x0, y0, x1, y1, members, curves, lines, rects, fills, colors, least(1.0, greatest(0.0, raw)) as score, raw >= 0.5 as is_graphic from s"


@query(_graphic_sql())
def graphic_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of small boxes with made-up items and colours."""
    b = boxes(spark, sf_dir)
    colour = lambda when, n: F.when(when, F.concat(F.lit("c"), (F.col("id") % n).cast("string")))
    drawings = b.select("doc", "page", "id", "x0", "y0", (F.col("x0") + (F.col("x1") - F.col("x0")) / 4).alias("x1"), (F.col("y0") + (F.col("y1") - F.col("y0")) / 3).alias("y1"), (F.col("id") % 4 * 2).alias("curves"), (F.col("id") % 5).alias("lines"), (F.col("id") % 3 * 2).alias("rects"), colour(F.col("id") % 2 == 0, 4).alias("fill"), colour(F.col("id") % 3 == 0, 6).alias("stroke"))
    return B.graphic_regions(drawings, _pages(b))


STACK = """
with recursive o as (
  select o_custkey as doc, row_number() over (partition by o_custkey order by o_orderkey) as n, o_orderkey as k from orders
), s as (
  select *, coalesce(sum(2 + k % 2 + case when k % 3 = 0 then 2 else 1 end) over (partition by doc order by n rows between unbounded preceding and 1 preceding), 0) + 1 as r1,
    case when k % 5 = 0 then 'number' else 'text' end as kind, k % 4 = 0 as repeats from o
)"""


@query(
    STACK
    + """, h as (
  select *, n = 1 or repeats as heading from s
), g as (
  select doc, n, k, r1, kind, n as head, heading as headed, false as skip from h where n = 1
  union all
  select h.doc, h.n, h.k, h.r1, h.kind, case when j then g.head else h.n end, case when j then g.headed else h.heading end, j and h.heading and g.headed
  from g join h on h.doc = g.doc and h.n = g.n + 1, lateral (select g.k % 3 <> 0 and ((h.heading and g.headed) or h.kind = g.kind) as j) as x
), m as (
  select doc, head, min(r1) as r1, max(r1 + 1 + k % 2) as r2, coalesce(array_to_string(list_sort(list(r1) filter (skip)), ','), '') as skipped from g group by doc, head
)
select doc, cast(row_number() over (partition by doc order by r1) - 1 as int) as block, cast(r1 as int) as r1, cast(r2 as int) as r2, skipped from m
"""
)
def sheet_gap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as blocks of two or three rows, one or two empty rows apart; some begin with the header again."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc").orderBy("k")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("k"))
    high = F.lit(2) + F.col("k") % 2
    before = F.sum(high + F.when(F.col("k") % 3 == 0, 2).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    s = o.withColumn("r1", (F.coalesce(before, F.lit(0)) + 1).cast("int")).withColumn("high", high.cast("int")).withColumn("n", F.row_number().over(order))
    blocks = s.select("doc", F.lit(0).alias("sheet"), "r1", F.lit(1).alias("c1"), (F.col("r1") + F.col("high") - 1).alias("r2"), F.lit(3).alias("c2"))
    kind = F.when(F.col("k") % 5 == 0, "number").otherwise("text")
    cells = s.select("doc", F.lit(0).alias("sheet"), "k", "r1", "n", F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("i"), kind.alias("kind"))
    cells = cells.withColumn("c", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    # A block that repeats the header begins with a row that every first block has, and may be of another kind.
    heading = (F.col("i") == 0) & ((F.col("n") == 1) | (F.col("k") % 4 == 0))
    text = F.when(heading, F.concat(F.lit("h"), F.col("c").cast("string"))).otherwise(F.concat_ws("-", "k", "i", "c"))
    first = cells.select("doc", "sheet", (F.col("r1") + F.col("i")).alias("r"), "c", text.alias("text"), "kind")
    merged = M.gap_merged(blocks, first)
    return merged.select("doc", "block", "r1", "r2", F.array_join("skipped", ",").alias("skipped"))


TALL = f"select doc, page, id, x0 % 60 as x0, cast(row_number() over (partition by doc, page order by id) * 30 + id % 13 as double) as y0, x0 % 60 + 100 + id % 50 as x1, cast(row_number() over (partition by doc, page order by id) * 30 + id % 13 + 22 as double) as y1, n_rows, n_cols from ({BOXES})"


@query(
    f"""
with recursive t as (
  {TALL}
), o as (
  select *, row_number() over (partition by doc, page order by y0, x0, id) as n from t
), f as (
  select doc, page, n, id, id as head, x0, x1, y1, n_cols, n_rows <= 2 as open from o where n = 1
  union all
  select o.doc, o.page, o.n, o.id, case when j then f.head else o.id end, case when j then least(f.x0, o.x0) else o.x0 end, case when j then greatest(f.x1, o.x1) else o.x1 end,
    o.y1, case when j then greatest(f.n_cols, o.n_cols) else o.n_cols end, case when j then true else o.n_rows <= 2 end
  from f join o on o.doc = f.doc and o.page = f.page and o.n = f.n + 1,
  lateral (select f.open and o.y0 - f.y1 between -5 and 10 and greatest(0, least(f.x1, o.x1) - greatest(f.x0, o.x0)) >= greatest(f.x1 - f.x0, o.x1 - o.x0) * 0.7::double
    and f.n_cols <= o.n_cols + 1 as j) as x
)
select f.doc, f.page, f.id, f.head as "table", cast(max(o.n_cols) over (partition by f.doc, f.page, f.head) - o.n_cols as bigint) as missing
from f join o on o.doc = f.doc and o.page = f.page and o.n = f.n
"""
)
def header_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates stacked down the page; those of one or two rows take in what follows closely."""
    from pyspark.sql import Window

    b = boxes(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("doc", "page").orderBy("id")))
    left, top = F.col("x0") % 60, F.col("n") * 30 + F.col("id") % 13
    stacked = b.select("doc", "page", "id", left.alias("x0"), top.cast("double").alias("y0"), (left + 100 + F.col("id") % 50).alias("x1"), (top + 22).cast("double").alias("y1"), "n_rows", "n_cols")
    return M.header_merged(stacked)


MERGES = """
with c as (
  select l_suppkey as doc, 0 as id, dense_rank() over (partition by l_suppkey order by l_orderkey) as r, l_orderkey, l_linenumber, l_partkey,
    row_number() over (partition by l_suppkey, l_orderkey order by l_linenumber, l_partkey, l_quantity, l_extendedprice) as i,
    1 + l_partkey % 2 as width, case l_partkey % 3 when 0 then 'restart' when 1 then 'continue' else 'none' end as merge, l_returnflag || l_linenumber as text
  from lineitem
)"""


@query(
    MERGES
    + """, p as (
  select *, cast(coalesce(sum(width) over (partition by doc, id, r order by i rows between unbounded preceding and 1 preceding), 0) as bigint) as c from c
), e as (
  select p.*, k.k as col from p, unnest(range(0, 2)) as k(k) where k.k < width
), x as (
  select *, c + col as place from e
), o as (
  select *, last_value(case when merge <> 'continue' then {'r': r, 'c': c, 'w': width, 'm': merge} end ignore nulls) over (partition by doc, id, place order by r rows unbounded preceding) as owner from x
), own as (
  select * from o where col = 0
), down as (
  select *, row_number() over (partition by doc, id, c, owner.r order by r) as n from own
  where merge = 'continue' and owner is not null and owner.m = 'restart' and owner.c = c and owner.w = width
), spans as (
  select doc, id, owner.r as r, owner.c as c, count(*) + 1 as s from down where r = owner.r + n group by all
)
select a.doc, a.id, cast(a.r as int) as r, cast(a.c as int) as c, cast(coalesce(s.s, 1) as int) as row_span, cast(a.width as int) as col_span, a.text
from own a left join spans s on s.doc = a.doc and s.id = a.id and s.r = a.r and s.c = a.c where a.merge <> 'continue' or a.owner is null
"""
)
def cells_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of a supplier as rows of cells, of which a third continue what is above."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem")
    r = F.dense_rank().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey"))
    i = F.row_number().over(Window.partitionBy("l_suppkey", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))
    merge = F.when(F.col("l_partkey") % 3 == 0, "restart").when(F.col("l_partkey") % 3 == 1, "continue").otherwise("none")
    text = F.concat("l_returnflag", F.col("l_linenumber").cast("string"))
    return M.vertical_merges(rows.select(F.col("l_suppkey").alias("doc"), F.lit(0).alias("id"), r.alias("r"), i.alias("i"), (1 + F.col("l_partkey") % 2).cast("int").alias("width"), merge.alias("merge"), text.alias("text")))


SPANNED = "select distinct on (doc, r, c) o_custkey as doc, cast(o_orderkey % 12 as int) as r, cast(o_orderkey // 12 % 8 as int) as c, cast(o_orderkey % 3 + 1 as int) as rs, cast(o_orderkey % 2 + 1 as int) as cs, o_orderkey as k from orders order by doc, r, c, k"


@query(f"with s as ({SPANNED}) select doc, 0 as id, r, c, rs as row_span, cs as col_span, k from s where not exists (select 1 from s o where o.doc = s.doc and s.r between o.r and o.r + o.rs - 1 and s.c between o.c and o.c + o.cs - 1 and (o.r <> s.r or o.c <> s.c))")
def cells_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as cells with spans; those under another's span go."""
    k = F.col("o_orderkey")
    cells = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.lit(0).alias("id"), (k % 12).cast("int").alias("r"), (F.floor(k / 12) % 8).cast("int").alias("c"), (k % 3 + 1).cast("int").alias("row_span"), (k % 2 + 1).cast("int").alias("col_span"), k.alias("k"))
    one = cells.groupBy("doc", "id", "r", "c").agg(F.min(F.struct("k", "row_span", "col_span")).alias("x")).select("doc", "id", "r", "c", "x.row_span", "x.col_span", "x.k")
    return M.uncovered(one)


@query(
    """
with recursive o as (
  select o_custkey as doc, dense_rank() over (partition by o_custkey order by o_orderkey) as r, * from orders join lineitem on l_orderkey = o_orderkey
), l as (
  select doc, r, row_number() over (partition by doc, r order by l_linenumber, l_partkey, l_quantity, l_extendedprice) as i,
    cast(1 + l_partkey % 3 as int) as rs, cast(1 + l_suppkey % 2 as int) as cs, l_returnflag || ' & ' || l_partkey as text
  from o
), n as (
  select *, row_number() over (partition by doc order by r, i) as n from l
), p as (
  select doc, n, r, i, rs, cs, text, cast(1 as bigint) as c, list_transform(range(1, cs + 1), lambda k: r + rs - 1) as taken from n where n = 1
  union all
  select n.doc, n.n, n.r, n.i, n.rs, n.cs, n.text, x.c,
    list_transform(range(1, greatest(cast(len(p.taken) as bigint), x.c + n.cs - 1) + 1), lambda k: case when k between x.c and x.c + n.cs - 1 then greatest(coalesce(p.taken[k], 0), n.r + n.rs - 1) else coalesce(p.taken[k], 0) end)
  from p join n on n.doc = p.doc and n.n = p.n + 1,
  lateral (select min(k) as c from (select unnest(range(1, cast(len(p.taken) as bigint) + 2)) as k)
    where k > case when n.r = p.r then p.c + p.cs - 1 else 0 end and coalesce(p.taken[k], 0) < n.r) as x
)
select doc as doc_id, 0 as id, cast(r as int) as r, cast(i as int) as i, rs as row_span, cs as col_span, i = 1 as header, text, cast(c as int) as c from p
"""
)
def cells_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML tables of a customer's orders, each a row of its line items, read back into cells with their columns."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))
    rows = rows.withColumn("i", i)
    name = F.when(F.col("i") == 1, "th").otherwise("td")
    span = lambda what, n: F.concat(F.lit(f' {what}="'), n.cast("string"), F.lit('"'))
    cell = F.concat(F.lit("<"), name, span("rowspan", 1 + F.col("l_partkey") % 3), span("colspan", 1 + F.col("l_suppkey") % 2), F.lit("> <b>"), "l_returnflag", F.lit("</b> &\n"), F.col("l_partkey").cast("string"), F.lit("</"), name, F.lit(">"))
    lines = rows.groupBy(F.col("o_custkey").alias("doc_id"), "o_orderkey").agg(F.array_sort(F.collect_list(F.struct("i", cell.alias("h")))).alias("x"))
    lines = lines.select("doc_id", "o_orderkey", F.concat(F.lit("<tr>"), F.array_join(F.transform("x", lambda x: x["h"]), ""), F.lit("</tr>")).alias("h"))
    docs = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "h"))).alias("y"))
    html = F.concat(F.lit("<p>Orders</p><TABLE border=1>"), F.array_join(F.transform("y", lambda y: y["h"]), "\n"), F.lit("</TABLE>"))
    return M.placed_cells(M.table_cells(docs.select("doc_id", html.alias("html"))))


ITEMS = "select cast(p_partkey // 50 as bigint) as doc, cast(p_size % 5 as int) as page, 0 as id, p_partkey // 3 as drawing, case p_partkey % 8 when 7 then 'c' when 2 then 're' else 'l' end as kind, p_partkey % 6 = 0 as filled, cast(p_partkey % 5 * 100 as double) as x0, cast(p_size % 8 * 100 as double) as y0, cast(p_partkey % 5 * 100 + case when p_partkey % 8 in (1, 3, 2, 7) then 100 else p_size % 4 end as double) as x1, cast(p_size % 8 * 100 + case when p_partkey % 8 in (1, 3) then p_size % 3 else 100 end as double) as y1 from part"


def _framed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = "p_partkey % 8"
    columns = {"x0": "p_partkey % 5 * 100", "y0": "p_size % 8 * 100", "x1": f"p_partkey % 5 * 100 + if({k} in (1, 3, 2, 7), 100, p_size % 4)", "y1": f"p_size % 8 * 100 + if({k} in (1, 3), p_size % 3, 100)"}
    items = table(spark, sf_dir, "part").selectExpr("cast(floor(p_partkey / 50) as bigint) as doc", "cast(p_size % 5 as int) as page", "0 as id", "cast(floor(p_partkey / 3) as bigint) as drawing", f"case {k} when 7 then 'c' when 2 then 're' else 'l' end as kind", "p_partkey % 6 = 0 as filled", *[f"cast({e} as double) as {c}" for c, e in columns.items()])
    tables = items.select("doc", "page", "id").distinct().withColumns({c: F.lit(v) for c, v in zip(("x0", "y0", "x1", "y1"), (0.0, 0.0, 400.0, 700.0))})
    return tables, items


STROKES = f"""
with i as (
  {ITEMS}
), t as (
  select distinct doc, page, id, 0.0::double as a0, 0.0::double as b0, 400.0::double as a1, 700.0::double as b1 from i
), s as (
  select doc, page, id, x0, y0, x1, y1 from i where kind = 'l'
  union all select doc, page, id, x0, y0, x1, y0 from i where kind = 're' union all select doc, page, id, x0, y1, x1, y1 from i where kind = 're'
  union all select doc, page, id, x0, y0, x0, y1 from i where kind = 're' union all select doc, page, id, x1, y0, x1, y1 from i where kind = 're'
), w as (
  select doc, page, id, case when y1 - y0 <= 2 then 'h' when x1 - x0 <= 2 then 'v' end as way, case when y1 - y0 <= 2 then y0 else x0 end as pos,
    case when y1 - y0 <= 2 then x0 else y0 end as b, case when y1 - y0 <= 2 then x1 else y1 end as e from s
)"""


@query(
    STROKES
    + """, sides as (
  select doc, page, id, 'top' as side, 'h' as way, b0 as place, a0 as low, a1 as high from t union all select doc, page, id, 'bottom', 'h', b1, a0, a1 from t
  union all select doc, page, id, 'left', 'v', a0, b0, b1 from t union all select doc, page, id, 'right', 'v', a1, b0, b1 from t
), d as (
  select doc, page, id, side, low, high, greatest(b, low) as b, least(e, high) as e from sides join w using (doc, page, id, way) where abs(pos - place) <= 5
), m as (
  select *, max(e) over (partition by doc, page, id, side order by b, e rows between unbounded preceding and 1 preceding) as reach from d where b < e
), k as (
  select *, sum(case when reach is null or b >= reach then 1 else 0 end) over (partition by doc, page, id, side order by b, e rows unbounded preceding) as k from m
), c as (
  select doc, page, id, side, min(b) as b, max(e) as e from k group by doc, page, id, side, k
), g as (
  select s.doc, s.page, s.id, s.side, coalesce(lag(c.e) over (partition by s.doc, s.page, s.id, s.side order by c.b), s.low) as start, coalesce(c.b, s.high) as "end"
  from sides s left join c using (doc, page, id, side)
  union all
  select s.doc, s.page, s.id, s.side, max(c.e), s.high from sides s join c using (doc, page, id, side) group by s.doc, s.page, s.id, s.side, s.high
)
select doc, page, side, start, "end" from g where start < "end"
"""
)
def frame_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is open of the frames of one table a page, whose strokes come from parts."""
    from .operators import frames as D

    tables, items = _framed(spark, sf_dir)
    return D.side_gaps(tables, D.strokes_of(items)).select("doc", "page", "side", "start", "end")


@query(
    STROKES
    + """, n as (
  select w.*, case when way = 'h' then b >= a0 and e <= a1 else b >= b0 and e <= b1 end as inside, a0, b0, a1, b1 from w join t using (doc, page, id)
), sides as (
  select doc, page, id, cast(max(cast(way = 'h' and inside and abs(pos - b0) <= 5 as int)) + max(cast(way = 'h' and inside and abs(pos - b0) > 5 and abs(pos - b1) <= 5 as int))
      + max(cast(way = 'v' and inside and abs(pos - a0) <= 5 as int)) + max(cast(way = 'v' and inside and abs(pos - a0) > 5 and abs(pos - a1) <= 5 as int)) as double) / 4 as border,
    count(way) / cast(count(*) as double) as straight
  from n group by doc, page, id
), f as (
  select doc, page, id, way, pos, pos - lag(pos) over (partition by doc, page, id, way order by pos) as step from w where way is not null
), k as (
  select *, sum(case when step > 3 then 1 else 0 end) over (partition by doc, page, id, way order by pos) as k from f
), q as (
  select doc, page, id, way, k, count(*) as m, min(case when step > 0 then step end) as low, max(case when step > 0 then step end) as high from k group by doc, page, id, way, k
), r as (
  select doc, page, id, way, sum(m) as m, case when sum(m) < 2 then 1.0::double else sum(case when m > 1 then m else 0 end) / cast(sum(m) as double) end as share, min(low) as low, max(high) as high
  from q group by doc, page, id, way
), p as (
  select doc, page, id, max(share) filter (way = 'h') as hs, max(share) filter (way = 'v') as vs, max(m) filter (way = 'h') as hm, max(m) filter (way = 'v') as vm,
    max(low) filter (way = 'h') as hl, max(low) filter (way = 'v') as vl, max(high) filter (way = 'h') as hh, max(high) filter (way = 'v') as vh
  from r group by doc, page, id
), z as (
  select doc, page, id, drawing, count(*) as k, count(*) filter (kind = 'c') as curves, count(*) filter (kind = 'l' and x1 - x0 > 2 and y1 - y0 > 2) as slanted, max(cast(filled as int)) as filled
  from i group by doc, page, id, drawing
), y as (
  select doc, page, id, cast(sum(k) as double) as k, sum(curves) as curves, sum(slanted) as slanted, sum(filled) as filled, cast(count(*) as double) as drawings from z group by doc, page, id
)
select doc, page, round(coalesce(border, 0), 6) as border, round(coalesce(straight * 0.6::double + (coalesce(hs, 1) + coalesce(vs, 1)) / 2 * 0.4::double, 0), 6) as grid,
  cast(round(case when coalesce(hm, 0) < 2 or coalesce(vm, 0) < 2 then 0.5 else 1 - case when coalesce(least(hl, vl) < 10, false) then 0.2 else 0 end
    - case when coalesce(greatest(hh / vl, vh / hl) > 20, false) then 0.2 else 0 end end, 6) as double) as cells,
  round(greatest(0, 1 - least(0.3::double, curves / k * 3) - least(0.3::double, slanted / k * 3) - least(0.2::double, filled / drawings * 0.4::double)), 6) as simplicity
from t left join sides using (doc, page, id) left join p using (doc, page, id) left join y using (doc, page, id)
"""
)
def table_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four parts of the grade of one table a page."""
    from .operators import frames as D

    return D.table_parts(*_framed(spark, sf_dir)).drop("id")


@query(
    """
with c as (
  select 0 as doc, cast(0 as int) as page, doc_id // 20 as id, doc_id % 20 as r, k as c,
    case k when 0 then case when (doc_id // 20) % 3 = 0 or doc_id % 4 = 0 then coalesce(source, '') else ' ' end
      else regexp_replace(substring(coalesce(text, ''), 1, cast(20 + (doc_id // 20) % 7 * 30 as bigint)), '^[ \\n\\t\\r]+|[ \\n\\t\\r]+$', '', 'g') end as text
  from documents, range(2) as x(k)
), x as (
  select *, length(trim(text)) as n, len(regexp_split_to_array(trim(text), '[ \\n\\t\\r]+')) as words, regexp_matches(text, '[.。?!,、]') as marks from c
), p as (
  select *, (n >= 100 and words >= 8 and marks) or (n >= 150 and marks) or (n >= 80 and words >= 10) as par from x
), rr as (
  select id, r, count(*) filter (n > 0) as f, count(*) filter (n >= 2) as m, count(*) filter (par) as par, max(n) filter (c = 0) as n0, max(n) filter (c = 1) as n1, sum(n) as letters from p group by id, r
), t as (
  select id, count(*) as n_rows, sum(f) as f, sum(m) as m, sum(par) as par, count(*) filter (f = 0) as bare, count(*) filter (n0 = 0) as blank, count(*) filter (n1 > 80) as long, sum(letters) as letters from rr group by id
), s as (
  select *, case when n_rows < 2 or (blank >= n_rows * 0.6 and long >= n_rows * 0.3) or par > 0.6 * greatest(1, f) then 0.0 else
    greatest(0, least(1, case when id % 2 = 0 then 1.1 else 1.0 end - case when f / (2 * n_rows) < 0.05 then 0.3 when f / (2 * n_rows) < 0.15 then 0.15 else 0 end - case when bare >= n_rows * 0.7 then 0.15 else 0 end
      - case when m < 2 then 0.15 else 0 end - case when n_rows - bare < 2 then 0.15 else 0 end - case when par > 0.1 * greatest(1, f) then 0.15 else 0 end
      - case when letters * 50 < 100 * (id % 9 * 100) * 0.005 or id % 9 = 0 then 0.1 else 0 end - case when id % 9 * 100 > 560 and n_rows > 15 then 0.15 else 0 end)) end as conf from t
)
select 0 as doc, cast(0 as int) as page, id, n_rows, cast(2 as bigint) as n_cols, round(f / (2 * n_rows), 6) as fill, round(cast(conf as double), 6) as confidence, round(cast(conf as double), 6) >= 0.35 as kept from s
"""
)
def candidate_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty documents' beginnings as a table of two columns, some of which are paragraphs or have no first column."""
    from .operators.geometry import candidate_scores

    group = F.floor(F.col("doc_id") / 20)
    docs = table(spark, sf_dir, "documents").select(F.lit(0).alias("doc"), F.lit(0).alias("page"), group.alias("id"), (F.col("doc_id") % 20).alias("r"), F.col("doc_id"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    first = F.when((F.col("id") % 3 == 0) | (F.col("doc_id") % 4 == 0), F.col("source")).otherwise(F.lit(" "))
    cells = docs.select("doc", "page", "id", "r", F.posexplode(F.array(first, F.expr("substring(text, 1, cast(20 + id % 7 * 30 as int))"))).alias("c", "text"))
    boxes_ = docs.select("doc", "page", "id").distinct().selectExpr("*", "0D as x0", "0D as y0", "100D as x1", "cast(id % 9 * 100 as double) as y1", "800D as height", "id % 2 = 0 as told")
    return candidate_scores(cells, boxes_)


@query()
def chunk_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents by SQL's chunk(); a test holds them against `chunks`."""
    from .functions.table_functions import register

    register(spark)
    return spark.sql("select d.doc_id, c.* from {docs} d, lateral chunk(d.text, 1000, 200) c", docs=table(spark, sf_dir, "documents"))


@query()
def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' sources as code of two types; tests put texts together again."""
    from .operators.chunking import chunk_code

    ext = F.when(F.col("page_id") % 2 == 0, "html").otherwise("js")
    return chunk_code(table(spark, sf_dir, "pages").select("page_id", ext.alias("ext"), F.col("html").alias("text")))


def _scalars() -> None:
    from .catalogue import scalar
    from .functions import text as T

    odd, plain = "".join(T.COMPATIBILITY), "".join(T.COMPATIBILITY.values())
    broken = lambda: F.translate("text", "()[]/+~\"ea", "".join(odd[i] for i in (0, 1, 2, 3, 7, 9, 10, 11, 6, 15)))
    sql = f"translate(translate(text, '()[]/+~\"ea', '{''.join(odd[i] for i in (0, 1, 2, 3, 7, 9, 10, 11, 6, 15))}'), '{odd}', '{plain}')"
    fields = lambda: {"segment": F.col("c_mktsegment"), "last_saved_time": F.when(F.col("c_custkey") % 2 == 0, F.timestamp_seconds(F.col("c_custkey") * 1000003)), "company": F.lit(None), "author": F.col("c_name"), "title": F.when(F.col("c_custkey") % 3 == 0, "")}
    at = "case when c_custkey % 2 = 0 then '  수정일: ' || strftime(to_timestamp(c_custkey * 1000003) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') end"
    scalar("metadata_labelled", "customer", "c_custkey", lambda: T.labelled_metadata(fields()), "block", f"'<Document-Metadata>' || chr(10) || concat_ws(chr(10), '  작성자: ' || c_name, {at}, '  Segment: ' || c_mktsegment) || chr(10) || '</Document-Metadata>'")
    scalar("compatibility_mapped", "documents", "doc_id", lambda: T.compatible(broken()), "mapped", sql)


_scalars()
