"""Registered queries of tags, pages, grids and rendering, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import BOXES, boxes, query, scalar, table
from .functions import marks as K
from .operators import grids as D
from .operators import positions as P

TURN = "case turn % 3 when 0 then '[Page Number: ' || turn || ' (OCR)]' when 1 then '[Slide Number: ' || turn || ']' else '[Sheet: s' || turn || ']' end || chr(10) || text"


def _tagged() -> F.Column:
    number = F.col("turn").cast("string")
    tag = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("[Page Number: "), number, F.lit(" (OCR)]"))).when(F.col("turn") % 3 == 1, K.tag("slide", F.col("turn"))).otherwise(K.tag("sheet", F.concat(F.lit("s"), number)))
    return F.concat(tag, F.lit("\n"), "text")


def _scalar_of_turns(name: str, column, out: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "conversations").select("conv_id", "turn", column().alias(out))

    scalar(name, "conversations", "conv_id", column, out, sql)
    from .catalogue import ORACLE_SQL, QUERIES

    QUERIES[name] = run
    ORACLE_SQL[name] = f"select conv_id, turn, {sql} as {out} from conversations"


_scalar_of_turns("tags_found", lambda: F.array_join(F.concat(K.found_tags(_tagged(), "page"), K.found_tags(_tagged(), "slide"), K.found_tags(_tagged(), "sheet")), ","), "found", "case turn % 3 when 2 then 's' else '' end || turn")
_scalar_of_turns("tags_removed", lambda: K.without_tags(_tagged(), "page"), "bare", f"case turn % 3 when 0 then text else {TURN} end")
_scalar_of_turns("tags_present", lambda: K.has_tag(_tagged(), "slide"), "present", "turn % 3 = 1")
_scalar_of_turns("charts_removed", lambda: K.without_tags(F.concat(F.lit("a\n[chart]"), "text", F.lit("[/chart]\nb"), "role"), "chart"), "bare", "'a' || chr(10) || 'b' || role")
_scalar_of_turns("fields_shown", lambda: K.without_fields(F.concat(F.lit("x\x13PAGE \x13IF\x15\x14"), "role", F.lit("\x15y\x13DATE\x15\x14z\x13REF \x14a\x13IF \x14"), F.col("turn").cast("string"), F.lit("\x13\x15\x15b\x15"))), "shown", "'x' || role || 'yza' || turn || 'b'")
_scalar_of_turns("markdown_tables", lambda: K.is_markdown_table(F.concat(F.lit("| a |\n"), F.when(F.col("turn") % 2 == 0, F.lit("| --- |\n")).otherwise(F.lit("---\n")), "role")), "is_table", "turn % 2 = 0")
_scalar_of_turns("chunk_positions", lambda: K.chunk_position(F.when(F.col("turn") % 3 == 0, F.substring("text", 11, 40)).when(F.col("turn") % 3 == 1, F.concat(F.substring(F.split("text", "\n")[0], 1, 200), F.lit("\n#"))).otherwise(F.lit("#nowhere#")), F.concat(F.lit(">"), "text")), "at", "cast(case turn % 3 when 0 then position(substring(text, 11, 40) in '>' || text) - 1 when 1 then case when position(substring(string_split(text, chr(10))[1], 1, 200) || chr(10) || '#' in '>' || text) > 0 then 1 when length(trim(substring(string_split(text, chr(10))[1], 1, 200))) >= 10 then position(trim(substring(string_split(text, chr(10))[1], 1, 200)) in '>' || text) - 1 when length(substring(string_split(text, chr(10))[1], 1, 200)) >= 8 then coalesce(nullif(position(substring(substring(string_split(text, chr(10))[1], 1, 200) || chr(10) || '#', 1, 50) in '>' || text), 0), 0) - 1 else -1 end else -1 end as int)")
LETTERS = "case when p_partkey < 1 then '' else case when p_partkey > 702 then chr(cast(97 + ((p_partkey - 703) // 676) % 26 as int)) else '' end || case when p_partkey > 26 then chr(cast(97 + ((p_partkey - 27) // 26) % 26 as int)) else '' end || chr(cast(97 + (p_partkey - 1) % 26 as int)) end"
scalar("list_numbers", "part", "p_partkey", lambda: F.concat(K.numbered(F.col("p_partkey"), "alphaLcPeriod"), F.lit(" "), K.numbered(F.col("p_size"), "arabicParenBoth")), "number", f"{LETTERS} || '. (' || p_size || ')'")
scalar("pdf_dates", "orders", "o_orderkey", lambda: K.pdf_date(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("134501+09'00'"))).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.lit("D:2020"))).cast("string"), "at", "case o_orderkey % 3 when 0 then strftime(o_orderdate, '%Y-%m-%d') || ' 13:45:01' when 1 then strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' end")


@query("with t as (select *, case conv_id % 4 when 0 then '[Page Number: ' || (turn + 1) || ']' || chr(10) || text when 2 then '[Sheet: s' || (turn % 2) || ']' || chr(10) || text else text end as part, row_number() over (partition by conv_id order by turn) as i from conversations), s as (select *, coalesce(sum(length(part) + 1) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as b, sum(length(part) + 1) over (partition by conv_id) - 1 as n, lead(turn) over (partition by conv_id order by turn) as later from t), w as (select conv_id, string_agg(text, chr(10) order by turn) as whole from conversations where conv_id % 4 in (1, 3) group by 1), l as (select conv_id, unnest(string_split(whole, chr(10))) as line, generate_subscripts(string_split(whole, chr(10)), 1) - 1 as j from w where conv_id % 4 = 3), g as (select conv_id, j // 3 as k, sum(length(line) + 1) as n from l group by 1, 2), h as (select *, coalesce(sum(n) over (partition by conv_id order by k rows between unbounded preceding and 1 preceding), 0) as b from g) select conv_id as doc_id, cast(turn + 1 as int) as page, cast(b as bigint) as start, cast(case when later is null then n else b + length(part) + 1 end as bigint) as \"end\" from s where conv_id % 4 = 0 union all select conv_id, cast(case when turn % 2 = (select min(turn) from s as f where f.conv_id = s.conv_id) % 2 then 1 else 2 end as int), cast(b as bigint), cast(case when later is null then n else b + length(part) + 1 end as bigint) from s where conv_id % 4 = 2 union all select conv_id, cast(k + 1 as int), cast(k * 400 as bigint), cast(least(length(whole), (k + 1) * 400) as bigint) from w, unnest(range(0, cast(greatest(0, (length(whole) - 1) // 400) as bigint) + 1)) as r(k) where conv_id % 4 = 1 union all select conv_id, cast(k + 1 as int), cast(b as bigint), cast(b + n - 1 as bigint) from h")
def page_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files of four types, each with its own rule for pages."""
    kind = F.col("conv_id") % 4
    part = F.when(kind == 0, F.concat(K.tag("page", F.col("turn") + 1), F.lit("\n"), "text")).when(kind == 2, F.concat(K.tag("sheet", F.concat(F.lit("s"), (F.col("turn") % 2).cast("string"))), F.lit("\n"), "text")).otherwise(F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", part.alias("t"))))
    docs = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("text"))
    ext = F.element_at(F.array(*[F.lit(x) for x in ("pdf", "docx", "xlsx", "txt")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return P.page_map(docs.withColumn("ext", ext), chars=400, lines=3)


@query("select doc_id, text from documents where length(text) > 0")
def reconstructed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts put together from their overlapping windows are the texts."""
    from .operators.chunking import fixed_windows

    return P.reconstructed(fixed_windows(table(spark, sf_dir, "documents")), 200)


LINES = "select cast(p_partkey // 50 as bigint) as doc, cast(p_size % 5 as int) as page, case when p_partkey % 2 = 0 then 'h' else 'v' end as way, cast(p_partkey * 7 % 60 as double) as pos, cast(p_partkey * 13 % 90 as double) as start, cast(p_partkey * 13 % 90 + p_size as double) as \"end\", p_size / 20.0::double as thickness, p_partkey as id from part"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda e: f"cast({e} as double)"
    return table(spark, sf_dir, "part").selectExpr("cast(floor(p_partkey / 50) as bigint) as doc", "cast(p_size % 5 as int) as page", "if(p_partkey % 2 = 0, 'h', 'v') as way", f"{number('p_partkey * 7 % 60')} as at", f"{number('p_partkey * 13 % 90')} as start", f"{number('p_partkey * 13 % 90 + p_size')} as end", "p_size / 20D as thickness", "p_partkey as id")


@query(f"with l as ({LINES}), n as (select *, pos - lag(pos) over (partition by doc, page, way order by pos, start) as gap, lag(\"end\") over (partition by doc, page, way order by pos, start) as e, lag(start) over (partition by doc, page, way order by pos, start) as s from l) select id, case when thickness <= 0.5 then 'thin' when thickness >= 2 then 'thick' else 'normal' end as weight, coalesce(gap <= 5 and e >= start and s <= \"end\", false) as double from n")
def line_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.double_lines(D.line_classes(_lines(spark, sf_dir))).select("id", "weight", "double")


@query(f"with l as ({LINES}), f as (select *, coalesce(cast(pos - lag(pos) over (partition by doc, page, way order by pos) > 3 as int), 0) as far from l), k as (select *, sum(far) over (partition by doc, page, way order by pos) as c from f), r as (select *, max(\"end\") over (partition by doc, page, way, c order by start, \"end\" rows between unbounded preceding and 1 preceding) as reach from k), p as (select *, sum(case when reach is null or start > reach then 1 else 0 end) over (partition by doc, page, way, c order by start, \"end\") as part from r) select doc, page, way, avg(pos) as \"at\", min(start) as start, max(\"end\") as \"end\", max(thickness) as thickness, count(*) as members from p group by doc, page, way, c, part")
def lines_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.merged_lines(_lines(spark, sf_dir))


@query(f"with l as ({LINES}), f as (select *, coalesce(cast(pos - lag(pos) over (partition by doc, page, way order by pos) > 5 as int), 0) as far from l), k as (select *, sum(far) over (partition by doc, page, way order by pos) as c from f), p as (select doc, page, way, c, avg(pos) as pos from k group by all), g as (select doc, page, string_agg(case when way = 'h' then round(pos, 4)::varchar end, ' ' order by pos) as h, string_agg(case when way = 'v' then round(pos, 4)::varchar end, ' ' order by pos) as v, count(*) filter (where way = 'h') as nh, count(*) filter (where way = 'v') as nv from p group by doc, page) select doc, page, h as rows, v as columns from g where nh >= 2 and nv >= 2")
def grid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.round(x, 4).cast("string")), " ").alias(c)
    return D.grid_positions(_lines(spark, sf_dir)).select("doc", "page", shown("rows"), shown("columns"))


@query(f"with b as ({BOXES}), e as (" + " union all ".join(f"select doc, page, id % 2 as t, id as cell, '{a}' as axis, {e} as edge, {a}{e} as pos from b" for a in "xy" for e in (0, 1)) + "), f as (select *, coalesce(cast(pos - lag(pos) over (partition by doc, page, t, axis order by pos) > 5 as int), 0) as far from e), k as (select *, cast(sum(far) over (partition by doc, page, t, axis order by pos) as int) as c from f), m as (select doc, page, t, cell, max(case when axis = 'y' and edge = 0 then c end) as r, max(case when axis = 'x' and edge = 0 then c end) as c, max(case when axis = 'y' and edge = 1 then c end) as r1, max(case when axis = 'x' and edge = 1 then c end) as c1 from k group by all) select doc, page, t as id, cell, r, c, greatest(1, r1 - r) as row_span, greatest(1, c1 - c) as col_span from m")
def cell_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return D.cell_spans(b.select("doc", "page", (F.col("id") % 2).alias("id"), F.col("id").alias("cell"), "x0", "y0", "x1", "y1"))


FRAME = "select cast(p_partkey // 8 as bigint) as doc, 0 as page, case p_partkey % 4 when 3 then 580.0 else 10.0 end::double as x0, case p_partkey % 4 when 1 then 770.0 + p_size % 3 * 10 else 10.0 end::double as y0, case p_partkey % 4 when 2 then 12.0 else 590.0 end::double as x1, case p_partkey % 4 when 0 then 12.0 when 1 then 775.0 + p_size % 3 * 10 else 790.0 - p_size % 2 * 300 end::double as y1 from part"


@query(f"with d as ({FRAME}), s as (select doc, page, max(cast(y1 - y0 <= 10 and x1 - x0 > 510 and y0 < 60 as int)) as t, max(cast(y1 - y0 <= 10 and x1 - x0 > 510 and y0 >= 60 and y1 > 740 as int)) as b, max(cast(x1 - x0 <= 10 and y1 - y0 > 680 and x0 < 60 as int)) as l, max(cast(x1 - x0 <= 10 and y1 - y0 > 680 and x0 >= 60 and x1 > 540 as int)) as r from d group by all) select doc, page, t + b + l + r = 4 as has_border from s")
def borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "p_partkey % 4"
    columns = {"x0": f"if({k} = 3, 580D, 10D)", "y0": f"if({k} = 1, 770D + p_size % 3 * 10, 10D)", "x1": f"if({k} = 2, 12D, 590D)", "y1": f"case {k} when 0 then 12D when 1 then 775D + p_size % 3 * 10 else 790D - p_size % 2 * 300 end"}
    drawings = table(spark, sf_dir, "part").selectExpr("cast(floor(p_partkey / 8) as bigint) as doc", "0 as page", *[f"cast({e} as double) as {c}" for c, e in columns.items()])
    pages = drawings.select("doc", "page").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(800.0)})
    return D.page_borders(drawings, pages)


@query(f"with b as ({BOXES}), p as (select distinct doc, page from b), c as (select doc, page, gx, gy from p, range(3) as x(gx), range(4) as y(gy)), d as (select doc, page, gx, gy, count(*) as n from b, range(6) as x(gx), range(8) as y(gy) where id % 2 = 0 and x0 < gx * 200 + 200 and x1 > gx * 200 and y0 < gy * 200 + 200 and y1 > gy * 200 group by all), t as (select doc, page, gx, gy, avg(id % 10 / 10.0::double) as q from b, range(6) as x(gx), range(8) as y(gy) where id % 2 = 1 and x0 < gx * 200 + 200 and x1 > gx * 200 and y0 < gy * 200 + 200 and y1 > gy * 200 group by all), s as (select c.doc, c.page, cast(c.gx as int) as gx, cast(c.gy as int) as gy, coalesce(n, 0) as n_drawings, round(coalesce(q, 1.0::double), 6) as text_quality, round(least(1.0::double, coalesce(n, 0) * 1000 / 40000.0::double / 3 + (1 - coalesce(q, 1.0::double)) * 0.5), 6) as score from c left join d using (doc, page, gx, gy) left join t using (doc, page, gx, gy)), l as (select *, case when score >= 0.7 then 'COMPLEX' when score >= 0.4 then 'MODERATE' else 'SIMPLE' end as level from s) select *, case when level = 'COMPLEX' then 'BLOCK_IMAGE_OCR' when text_quality < 0.7 then 'HYBRID' else 'TEXT' end as strategy from l")
def page_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    pages = b.select("doc", "page").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(800.0)})
    return D.region_grid(pages, b.where("id % 2 = 0"), b.where("id % 2 = 1").withColumn("quality", F.col("id") % 10 / 10))


GRADES = "select p_partkey as id, (p_size % 5) / 4.0::double as border, (p_partkey % 7) / 6.0::double as grid, (p_partkey % 3) / 2.0::double as cells, 1.0::double as simplicity from part"


@query(f"with t as ({GRADES}), s as (select id, round(border * 0.3::double + grid * 0.3::double + cells * 0.2::double + simplicity * 0.2::double, 6) as score from t) select id, score, case when score >= 0.95 then 'EXCELLENT' when score >= 0.85 then 'GOOD' when score >= 0.65 then 'MODERATE' when score >= 0.4 then 'POOR' else 'UNPROCESSABLE' end as grade, case when score >= 0.65 then 'table' else 'image' end as \"by\" from s")
def table_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey as id", "(p_size % 5) / 4D as border", "(p_partkey % 7) / 6D as grid", "(p_partkey % 3) / 2D as cells", "1D as simplicity")
    return D.table_grades(parts).select("id", "score", "grade", "by")


@query("with c as (select cast(l_suppkey as bigint) as doc, 0 as page, l_orderkey as x, cast(l_linenumber * 5 + l_orderkey % 2 as double) as y, l_returnflag || l_linenumber as ch from lineitem), f as (select *, coalesce(cast(y - lag(y) over (partition by doc, page order by y) > 3 as int), 0) as far from c), k as (select *, cast(sum(far) over (partition by doc, page order by y) as int) as line from f) select doc, page, line, string_agg(ch, '' order by x, y, ch) as text from k group by all")
def lines_from_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("cast(l_suppkey as bigint) as doc", "0 as page", "l_orderkey as x", "cast(l_linenumber * 5 + l_orderkey % 2 as double) as y", "concat(l_returnflag, l_linenumber) as ch")
    return D.lines_of_characters(rows)


@query("with t as (select o_custkey as doc, o_orderkey as seq, row_number() over (partition by o_custkey order by o_orderkey) // 2 as page, case when o_orderkey % 3 = 0 then 10.0 else 400.0 end as y0, case when o_orderkey % 2 = 0 then 700.0 else 300.0 end as y1 from orders), c as (select *, coalesce(page > lag(page) over w and lag(y1) over w > 560 and y0 < 240, false) as goes from t window w as (partition by doc order by seq)), l as (select doc, seq, goes, l_linenumber * 10000000 + l_partkey * 10 + ascii(l_returnflag) % 10 as r, case when l_linenumber % 2 = 0 then '' else ' ' || l_returnflag || ' ' end as f, case when l_linenumber % 3 = 0 then null else l_linestatus end as s, l_partkey as part from c join lineitem on l_orderkey = seq), k as (select *, last_value(nullif(trim(f), '') ignore nulls) over (partition by doc order by seq, r rows between unbounded preceding and current row) as cat from l) select doc, seq, r, part, case when goes and trim(f) = '' and coalesce(trim(s), '') <> '' then coalesce(cat, f) else f end as first, s as second from k")
def tables_continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    number = F.floor(F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) / 2)
    key = F.col("o_orderkey")
    tables = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), key.alias("seq"), number.alias("page"), F.when(key % 3 == 0, 10.0).otherwise(400.0).alias("y0"), F.when(key % 2 == 0, 700.0).otherwise(300.0).alias("y1"), F.lit(800.0).alias("height"), F.lit(2).alias("n_cols"))
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as seq", "l_linenumber * 10000000 + l_partkey * 10 + ascii(l_returnflag) % 10 as r", "l_partkey as part", "if(l_linenumber % 2 = 0, '', concat(' ', l_returnflag, ' ')) as first", "if(l_linenumber % 3 = 0, null, l_linestatus) as second")
    return D.continued_tables(tables, rows.join(tables.select("doc", "seq"), "seq")).select("doc", "seq", "r", "part", "first", "second")


@query("select p_size as doc, p_partkey // 40 as id, string_agg(trim(p_name), chr(10) order by p_partkey) filter (where p_partkey % 5 <> 0) as text from part group by 1, 2 having max(case when p_size % 4 = 0 and p_partkey % 3 = 0 then 1 else 0 end) = 0 and count(*) filter (where p_partkey % 5 <> 0) > 0")
def tables_of_one_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "part").selectExpr("p_size as doc", "cast(floor(p_partkey / 40) as bigint) as id", "p_partkey as r", "if(p_size % 4 = 0 and p_partkey % 3 = 0, 1, 0) as c", "if(p_partkey % 5 = 0, '  ', concat(p_name, ' ')) as text")
    return D.single_columns(cells).where("text != ''")


@query("with c as (select n_regionkey as doc, 0 as id, n_nationkey as r, k as c, case when k = 0 and n_nationkey % 2 = 0 then 2 else 1 end as cs, n_nationkey < 5 as header, case k when 0 then n_name || case when n_nationkey % 3 = 0 then ' <b>|' || chr(10) || '&' else '' end else n_nationkey::varchar end as t from nation, range(2) as x(k)), r as (select doc, id, r, string_agg('<' || case when header then 'th' else 'td' end || case when cs > 1 then ' colspan=''2''' else '' end || '>' || replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</' || case when header then 'th' else 'td' end || '>', '' order by c) as h, '| ' || string_agg(replace(regexp_replace(t, '\\s*\\n\\s*', ' ', 'g'), '|', '\\|'), ' | ' order by c) || ' |' as m, string_agg(t, chr(9) order by c) as p from c group by all), n as (select *, row_number() over (partition by doc, id order by r) as i from r) select doc, id, '<table border=''1''>' || string_agg('<tr>' || h || '</tr>', '' order by r) || '</table>' as html, string_agg(m || case when i = 1 then chr(10) || '| --- | --- |' else '' end, chr(10) order by r) as markdown, string_agg(p, chr(10) order by r) as plain from n group by doc, id")
def tables_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.concat("n_name", F.when(F.col("n_nationkey") % 3 == 0, F.lit(" <b>|\n&")).otherwise(""))
    cells = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc"), F.lit(0).alias("id"), F.col("n_nationkey").alias("r"), (F.col("n_nationkey") < 5).alias("header"), F.lit(1).alias("row_span"), F.col("n_nationkey"), F.posexplode(F.array(odd, F.col("n_nationkey").cast("string"))).alias("c", "text"))
    return D.rendered_tables(cells.withColumn("col_span", F.when((F.col("c") == 0) & (F.col("n_nationkey") % 2 == 0), 2).otherwise(1)))


def _unions(rounds: int) -> str:
    """Rounds of unions of what hangs together, as so many recursive tables."""
    out = ["with recursive u0 as (select distinct p_partkey // 50 as doc, p_size % 3 as sheet, p_partkey * 7 % 60 as r1, p_partkey * p_size % 40 as c1, p_partkey * 7 % 60 + 4 as r2, p_partkey * p_size % 40 + 3 as c2 from part)"]
    meets = "a.doc = b.doc and a.sheet = b.sheet and a.r1 <= b.r2 and b.r1 <= a.r2 and a.c1 <= b.c2 and b.c1 <= a.c2"
    for i in range(1, rounds + 1):
        out.append(f"n{i} as (select *, row_number() over (order by doc, sheet, r1, c1, r2, c2) as id from u{i - 1})")
        out.append(f"p{i} as (select a.id as a, b.id as b from n{i} a join n{i} b on {meets})")
        out.append(f"w{i} as (select a as id, b as other from p{i} union select w.id, p.b from w{i} w join p{i} p on p.a = w.other)")
        out.append(f"m{i} as (select id, min(other) as root from w{i} group by id)")
        out.append(f"u{i} as (select doc, sheet, min(r1) as r1, min(c1) as c1, max(r2) as r2, max(c2) as c2 from n{i} join m{i} using (id) group by doc, sheet, root)")
    last = f"u{rounds}"
    return ", ".join(out) + f" select cast(doc as bigint) as doc, cast(sheet as int) as sheet, cast(row_number() over (partition by doc, sheet order by r1, c1, r2, c2) - 1 as int) as block, cast(r1 as int) as r1, cast(c1 as int) as c1, cast(r2 as int) as r2, cast(c2 as int) as c2 from {last}"


@query(_unions(8))
def boxes_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of sheets without overlaps; tests hold it against repeated unions too."""
    rows = table(spark, sf_dir, "part").selectExpr("cast(floor(p_partkey / 50) as bigint) as doc", "p_size % 3 as sheet", "cast(p_partkey * 7 % 60 as int) as r1", "cast(p_partkey * p_size % 40 as int) as c1")
    return D.merged_boxes(rows.selectExpr("*", "r1 + 4 as r2", "c1 + 3 as c2"))


@query("with w as (select doc_id, cast(i as int) as chunk_index, substring(text, cast(i * 800 + 1 as bigint), 1000) as t, count(*) over (partition by doc_id) as n from documents, unnest(range(0, cast(greatest(0, ceil((length(text) - 1000) / 800.0)) as bigint) + 1)) as r(i) where length(text) > 0) select doc_id, chunk_index, case when chunk_index = 0 then 'total_chunks: ' || n || chr(10) || 'source_file: ' || doc_id || chr(10) || chr(10) else '' end || '## Chunk ' || (chunk_index + 1) || '/' || n || chr(10) || chr(10) || t || chr(10) || chr(10) || '---' || chr(10) as value from w")
def chunks_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.chunking import fixed_windows
    from .sources.sinks import markdown_chunks

    return markdown_chunks(fixed_windows(table(spark, sf_dir, "documents")))
