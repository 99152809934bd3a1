"""Registered queries of the document operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.formats import format_cell
from .operators import chunking as C
from .operators import geometry as G
from .operators import layout as L
from .operators import tables as B
from .operators import tags as M

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
S = "[ \\t\\n\\r\\f]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def scalar(name: str, source: str, key: str, column: Callable[[], Column], out: str, sql: str) -> None:
    """A query that applies one column function to a whole table."""
    QUERIES[name] = lambda spark, sf_dir: table(spark, sf_dir, source).select(key, column().alias(out))
    ORACLE_SQL[name] = f"select {key}, {sql} as {out} from {source}"


scalar("clean_text", "documents", "doc_id", lambda: T.clean_text(F.col("text")), "cleaned", f"regexp_replace(regexp_replace(text, '\\n{S}*\\n{S}*\\n+', chr(10) || chr(10), 'g'), '^{S}+|{S}+$', '', 'g')")
scalar("clean_code_text", "documents", "doc_id", lambda: T.clean_code(F.col("text")), "cleaned", f"replace(regexp_replace(text, '{S}+$', ''), chr(9), '    ')")
scalar("sanitize_text", "documents", "doc_id", lambda: T.sanitize(F.col("text")), "sanitized", r"regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{E000}-\x{F8FF}\x{FFFE}\x{FFFF}]', '', 'g')")
scalar("text_sufficient", "documents", "doc_id", lambda: T.is_sufficient(F.col("text")), "sufficient", r"length(text) >= 500 and length(regexp_replace(text, '[^\p{L}\p{N}_]', '', 'g')) >= 0.6 * length(text)")
scalar("estimate_chunks", "documents", "doc_id", lambda: C.estimated_chunks(F.col("text")), "chunks", "cast(case when length(text) = 0 then 0 when length(text) <= 1000 then 1 else greatest(1, floor((length(text) - 200) / 800.0) + 1) end as int)")
scalar("page_map_chars", "documents", "doc_id", lambda: (F.floor((F.length("text") - 1) / 1500) + 1).cast("int"), "last_page", "cast(floor((length(text) - 1) / 1500.0) + 1 as int)")
scalar("column_letters", "part", "p_partkey", lambda: T.column_letter(F.col("p_partkey")), "letter", "(case when p_partkey < 1 then '' else case when p_partkey > 702 then chr(cast(65 + ((p_partkey - 703) // 676) % 26 as int)) else '' end || case when p_partkey > 26 then chr(cast(65 + ((p_partkey - 27) // 26) % 26 as int)) else '' end || chr(cast(65 + (p_partkey - 1) % 26 as int)) end)")
scalar("is_numeric_cell", "part", "p_partkey", lambda: T.is_numeric(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.lit("$"), F.format_number("p_retailprice", 2)))), "numeric", r"p_partkey % 3 <> 0 or regexp_matches(trim(p_name), '^[-+]?[$₩]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]+)?%?$')")
scalar("file_sizes", "documents", "doc_id", lambda: T.file_size(F.col("n_chars") * 37), "size", "case when n_chars * 37 < 1024 then (n_chars * 37)::bigint || ' B' when n_chars * 37 < 1048576 then printf('%.1f KB', round(n_chars * 37 / 1024.0, 1)) else printf('%.1f MB', round(n_chars * 37 / 1048576.0, 1)) end")
scalar("category_dispatch", "pages", "page_id", lambda: T.category(T.extension(F.regexp_replace("url", "[?#].*", ""))), "category", "case when lower(regexp_extract(regexp_replace(url, '[?#].*', ''), '\\.([A-Za-z0-9]+)$', 1)) = 'html' then 'code' when lower(regexp_extract(regexp_replace(url, '[?#].*', ''), '\\.([A-Za-z0-9]+)$', 1)) in ('htm', 'xhtml') then 'web' else 'unknown' end")
scalar("html_title", "pages", "page_id", lambda: F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1), "title", "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
scalar("html_to_text", "pages", "page_id", lambda: T.html_to_text(F.col("html")), "plain", "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript|iframe)[^>]*>.*?</(script|style|noscript|iframe)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '" + S + "+', ' ', 'g'))")
scalar("html_table_rows", "supplier", "s_suppkey", lambda: F.concat(F.lit("<tr><td>"), T.escaped(F.col("s_name")), F.lit("</td></tr>")), "row_html", "'<tr><td>' || replace(replace(replace(s_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td></tr>'")
scalar("metadata_blocks", "customer", "c_custkey", lambda: T.metadata_block({"name": F.col("c_name"), "segment": F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), "nation": F.col("c_nationkey")}), "block", "'<Document-Metadata>' || chr(10) || concat_ws(chr(10), '  name: ' || c_name, case when c_custkey % 2 = 0 then '  segment: ' || c_mktsegment end, '  nation: ' || c_nationkey) || chr(10) || '</Document-Metadata>'")


@query("select doc_id, cast(i as int) as chunk_index, substring(text, cast(i * 800 + 1 as bigint), 1000) as text, cast(i * 800 as int) as start from documents, unnest(range(0, cast(greatest(0, ceil((length(text) - 1000) / 800.0)) as bigint) + 1)) as r(i) where length(text) > 0")
def chunk_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fixed_windows(table(spark, sf_dir, "documents"))


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) as line from documents) select doc_id, cast(line as int) as line, cast(coalesce(sum(length(s) + 1) over (partition by doc_id order by line rows between unbounded preceding and 1 preceding), 0) as int) as start, cast(length(s) as int) as length from l")
def line_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.line_table(table(spark, sf_dir, "documents"))


@query("with r as (select l_orderkey as doc, cast(l_partkey % 400 as int) as s, cast(l_partkey % 400 + l_quantity as int) as e from lineitem), m as (select *, max(e) over (partition by doc order by s, e rows between unbounded preceding and 1 preceding) as b from r), g as (select *, sum(case when b is null or s >= b then 1 else 0 end) over (partition by doc order by s, e rows unbounded preceding) as i from m) select doc, min(s) as s, max(e) as e from g group by doc, i")
def protected_regions_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc", "cast(l_partkey % 400 as int) as s", "cast(l_partkey % 400 + l_quantity as int) as e")
    return L.merged_intervals(rows, ["doc"], "s", "e")


@query("with r as (select c_nationkey as doc, c_acctbal as x, c_custkey as id from customer), f as (select *, coalesce(cast(x - lag(x) over (partition by doc order by x) > 50 as int), 0) as far from r) select doc, id, cast(sum(far) over (partition by doc order by x) as int) as cluster from f")
def column_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_nationkey as doc", "c_acctbal as x", "c_custkey as id")
    return L.islands(rows, ["doc"], "x", 50).select("doc", "id", "cluster")


@query("with r as (select o_custkey as t, o_orderkey as r, case when o_orderkey % 3 = 0 then o_orderpriority end as v from orders) select t, r, last_value(v ignore nulls) over (partition by t order by r rows unbounded preceding) as v from r")
def fill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey as t", "o_orderkey as r", "case when o_orderkey % 3 = 0 then o_orderpriority end as v")
    return L.fill_down(rows, ["t"], ["r"], "v")


@query("with m as (select conv_id, turn, coalesce(sum(length(text) + 1) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as pos from conversations), t as (select conv_id, sum(length(text) + 1) as n from conversations group by 1), s as (select conv_id, i * 500 as pos from t, unnest(range(0, cast(ceil(n / 500.0) as bigint))) as r(i)) select s.conv_id, cast(s.pos as bigint) as pos, (select max(turn) from m where m.conv_id = s.conv_id and m.pos <= s.pos) as turn from s")
def chunk_page_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") + 1).cast("bigint").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    marks = turns.withColumn("pos", F.coalesce(before, F.lit(0).cast("bigint")))
    totals = turns.groupBy("conv_id").agg(F.sum("n").alias("n"))
    starts = totals.select("conv_id", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / 500) - 1)).alias("i")).selectExpr("conv_id", "cast(i * 500 as bigint) as pos")
    return L.as_of(starts, marks, "conv_id", "pos", "turn").select("conv_id", "pos", "turn")


@query("select n_regionkey, '| ' || string_agg(n_name, ' | ' order by n_nationkey) || ' |' as row_md from nation group by n_regionkey")
def md_table_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    joined = F.array_join(F.transform(cells, lambda c: F.replace(c["n_name"], F.lit("|"), F.lit("\\|"))), " | ")
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("| "), joined, F.lit(" |")).alias("row_md"))


@query("with recursive r as (select l_suppkey as t, l_orderkey as o, l_linenumber as n, length(l_shipmode_row) as len, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as i from (select *, l_orderkey || '|' || l_partkey || '|' || l_returnflag as l_shipmode_row from lineitem)), p as (select t, o, n, i, len + 1 as used, 0 as chunk from r where i = 1 union all select r.t, r.o, r.n, r.i, case when p.used + r.len + 1 > 120 then r.len + 1 else p.used + r.len + 1 end, case when p.used + r.len + 1 > 120 then p.chunk + 1 else p.chunk end from p join r on r.t = p.t and r.i = p.i + 1) select t, o, n, cast(chunk as int) as chunk from p")
def table_row_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as t", "l_orderkey as o", "l_linenumber as n", "concat_ws('|', l_orderkey, l_partkey, l_returnflag) as row")
    return C.pack_rows(rows, ["t"], ["o", "n"], "row", 120)


@query("with i as (select p_partkey as image, p_size % 5 as page, cast(p_partkey % 40 as double) as x0, cast(p_size as double) as y0 from part), c as (select s_suppkey as cell, s_nationkey % 5 as page, cast(s_suppkey % 40 as double) as x0, cast(s_nationkey * 2 as double) as y0 from supplier), r as (select i.page, image, cell, greatest(0, least(i.x0 + 6, c.x0 + 9) - greatest(i.x0, c.x0)) * greatest(0, least(i.y0 + 4, c.y0 + 7) - greatest(i.y0, c.y0)) / 24 as ratio from i join c on i.page = c.page), b as (select *, row_number() over (partition by page, image order by ratio desc, cell) as n from r) select page, image, cell, ratio from b where n = 1 and ratio >= 0.6")
def bbox_overlap_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "part").selectExpr("p_partkey as image", "p_size % 5 as page", "cast(p_partkey % 40 as double) as x0", "cast(p_size as double) as y0")
    images = images.selectExpr("*", "x0 + 6 as x1", "y0 + 4 as y1")
    cells = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as cell", "s_nationkey % 5 as page", "cast(s_suppkey % 40 as double) as x0", "cast(s_nationkey * 2 as double) as y0")
    return L.best_cells(images, cells.selectExpr("*", "x0 + 9 as x1", "y0 + 7 as y1"))


@query("select sha256(text) as content, min(doc_id) as doc_id, count(*) as copies from documents where text is not null group by 1")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("content")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query()
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive chunks of 1000 characters with an overlap of 200, with positions."""
    return C.chunk_documents(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


@query()
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of conversations, every turn a tagged page."""
    turns = table(spark, sf_dir, "conversations")
    page = F.concat(T.page_tag(F.col("turn") + 1), F.lit("\n"), "text")
    texts = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", page.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return C.chunk_documents(texts, size=500, overlap=50)


@query("select lang, count(*) as docs, cast(sum(length(text)) as bigint) as chars, max(length(text)) as longest from documents group by lang")
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).cast("bigint").alias("longest"))


RX = r"[\s0-9A-Za-z\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}.,;:!?()\[\]{}<>\"''/\\@#$%^&*+=_~`|-]"
scalar("roman_numerals", "part", "p_partkey", lambda: T.roman(F.col("p_size")), "roman", "list_value('', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC')[cast(p_size // 10 as int) + 1] || list_value('', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX')[cast(p_size % 10 as int) + 1]")
scalar("page_map_lines", "documents", "doc_id", lambda: F.floor((F.size(F.split("text", "\n", -1)) - 1) / 1000).cast("int") + 1, "last_page", "cast((len(string_split(text, chr(10))) - 1) // 1000 + 1 as int)")
scalar("cell_format_number", "lineitem", "l_orderkey", lambda: format_cell(F.floor("l_extendedprice"), F.lit("#,##0")), "shown", "format('{:,}', cast(floor(l_extendedprice) as bigint))")
scalar("cell_format_rounded", "lineitem", "l_orderkey", lambda: format_cell(F.col("l_extendedprice"), F.lit("#,##0")), "shown", "format('{:,}', cast(round(l_extendedprice) as bigint))")
scalar("cell_format_percent", "lineitem", "l_orderkey", lambda: format_cell(F.col("l_quantity") / 16, F.lit("0.0%")), "shown", "(cast(round(l_quantity * 62.5::double) as bigint) // 10) || '.' || (cast(round(l_quantity * 62.5::double) as bigint) % 10) || '%'")
scalar("cell_format_date", "orders", "o_orderkey", lambda: format_cell(F.datediff("o_orderdate", F.lit("1899-12-30").cast("date")), F.lit("yyyy-mm-dd")), "shown", "strftime(o_orderdate, '%Y-%m-%d')")
SCORED = f"with c as (select doc_id, length(text) as n, length(text) - length(regexp_replace(text, '[\\x{{E000}}-\\x{{F8FF}}\\x{{F0000}}-\\x{{FFFFD}}\\x{{100000}}-\\x{{10FFFD}}]', '', 'g')) as p, length(text) - length(replace(text, chr(65533), '')) as q, length(text) - length(regexp_replace(text, '[\\x{{3200}}-\\x{{33FF}}\\x{{3700}}-\\x{{37FF}}]', '', 'g')) as k, length(text) - length(regexp_replace(text, '{RX}', '', 'g')) as v, len(string_split(text, chr(10))) as l, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) as f, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' and length(trim(x)) <= 3)) as h from documents), g as (select *, l >= 5 and f > 0 and h * 2 >= f as fragmented from c)"


@query(SCORED + " select doc_id, case when n < 10 then 1.0 else round(greatest(0.0, least(1.0, (1 - (p * 0.8::double + q * 0.9::double + k * 1.5::double) / n - case when fragmented then 0.5::double else 0 end) * (0.5 + v / n * 0.5::double))), 6) end::double as score, fragmented from g")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.quality(text).alias("score"), T.is_fragmented(text).alias("fragmented"))


@query("select conv_id, cast(turn + 1 as int) as page, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as section from conversations where regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as paged texts, split back into their pages."""
    return M.page_sections(_paged(spark, sf_dir), "conv_id")


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(T.page_tag(F.col("turn") + 1), F.lit("\n"), "text")
    ordered = F.array_sort(F.collect_list(F.struct("turn", page.alias("t"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("text"))


@query("with t as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) as i from conversations) select conv_id, string_agg('[Page Number: ' || (turn + 1) || ']' || chr(10) || chr(10) || text, chr(10) || '#' || chr(10) order by turn) as chunks from t where regexp_replace(text, '\\s+', ' ', 'g') not in ('', ' ') group by conv_id")
def clean_chunks_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers that stand alone are carried into the chunk after them."""
    turns = table(spark, sf_dir, "conversations").where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    pair = F.array(T.page_tag(F.col("turn") + 1), F.lit(" \n"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", pair.alias("p"))))
    texts = turns.groupBy("conv_id").agg(F.flatten(F.transform(ordered, lambda x: x["p"])).alias("c"))
    return texts.select("conv_id", F.array_join(M.joined_markers(F.col("c")), "\n#\n").alias("chunks"))


@query("with recursive t as (select conv_id, text, row_number() over (partition by conv_id order by turn) as i, count(*) over (partition by conv_id) as n from conversations), m as (select conv_id, i, n, [text] as o from t where i = 1 union all select m.conv_id, t.i, m.n, case when length(m.o[len(m.o)]) < 60 then list_append(m.o[1:len(m.o) - 1], m.o[len(m.o)] || chr(10) || chr(10) || t.text) else list_append(m.o, t.text) end from m join t on t.conv_id = m.conv_id and t.i = m.i + 1) select conv_id, array_to_string(case when len(o) > 1 and length(o[len(o)]) < 60 then list_append(o[1:len(o) - 2], o[len(o) - 1] || chr(10) || chr(10) || o[len(o)]) else o end, chr(10) || '#' || chr(10)) as chunks from m where i = n")
def merge_small_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    texts = turns.groupBy("conv_id").agg(F.transform(ordered, lambda x: x["text"]).alias("c"))
    return texts.select("conv_id", F.array_join(M.merged_small(F.col("c"), 600), "\n#\n").alias("chunks"))


@query("select o_orderkey, (o_orderkey % 4 <> 0) and (o_orderkey % 3 = 0 or o_orderkey % 2 = 0) as header from orders")
def csv_header_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows from each order; a number in the first row, or none in the second beside a repeated cell, makes it no header."""
    key = F.col("o_orderkey")
    first = F.array(F.lit("name"), F.when(key % 4 == 0, F.lit("1,200")).when(key % 2 == 0, F.lit("value")).otherwise(F.lit("name")))
    second = F.array(F.lit("x"), F.when(key % 3 == 0, F.lit("50%")).otherwise(F.lit("y")))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.has_header(F.array(first, second)).alias("header"))


BOXES = "select cast(p_partkey // 50 as bigint) as doc, cast(p_size % 5 as int) as page, cast(p_partkey as bigint) as id, cast(p_partkey * 7 % 400 as double) as x0, cast(p_partkey * 13 % 700 as double) as y0, cast(p_partkey * 7 % 400 + 100 + p_size as double) as x1, cast(p_partkey * 13 % 700 + 20 + p_size as double) as y1, cast(p_size % 3 + 1 as int) as n_rows, cast(p_size % 4 + 2 as int) as n_cols, p_name as text from part"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes made from part numbers, 50 parts a document."""
    whole = "cast({} as double)"
    columns = {"x0": "p_partkey * 7 % 400", "y0": "p_partkey * 13 % 700", "x1": "p_partkey * 7 % 400 + 100 + p_size", "y1": "p_partkey * 13 % 700 + 20 + p_size"}
    return table(spark, sf_dir, "part").selectExpr("cast(floor(p_partkey / 50) as bigint) as doc", "cast(p_size % 5 as int) as page", "cast(p_partkey as bigint) as id", *[f"{whole.format(e)} as {c}" for c, e in columns.items()], "cast(p_size % 3 + 1 as int) as n_rows", "cast(p_size % 4 + 2 as int) as n_cols", "p_name as text")


@query(f"with b as ({BOXES}), o as (select *, lag(y1) over w as uy1, lag(x0) over w as ux0, lag(x1) over w as ux1, lag(n_cols) over w as uc, lag(n_rows) over w as ur from b window w as (partition by doc, page order by y0, x0, id)), j as (select *, coalesce(y0 - uy1 between 0 and 30 and least(x1, ux1) - greatest(x0, ux0) >= least(x1 - x0, ux1 - ux0) * 0.8 and (n_cols = uc or (ur = 1 and uc < n_cols)), false) as joins from o) select doc, page, id, cast(sum(case when joins then 0 else 1 end) over (partition by doc, page order by y0, x0, id) - 1 as int) as part from j")
def adjacent_table_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.adjacent_tables(boxes(spark, sf_dir)).select("doc", "page", "id", "part")


@query(f"with b as ({BOXES}), l as (select * from b where id % 3 <> 0), t as (select * from b where id % 3 = 0) select doc, page, id from l where not exists (select 1 from t where t.doc = l.doc and t.page = l.page and greatest(0, least(l.x1, t.x1) - greatest(l.x0, t.x0)) * greatest(0, least(l.y1, t.y1) - greatest(l.y0, t.y0)) >= (l.x1 - l.x0) * (l.y1 - l.y0) * 0.5)")
def text_minus_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return G.lines_outside_tables(b.where("id % 3 != 0"), b.where("id % 3 = 0")).select("doc", "page", "id")


@query(f"with b as ({BOXES}) select doc, page, case when max(case when y1 <= 80 then y1 end) - min(case when y1 <= 80 then y0 end) <= 60 then max(case when y1 <= 80 then y1 end) end as header_end, case when max(case when y0 >= 720 then y1 end) - min(case when y0 >= 720 then y0 end) <= 60 then min(case when y0 >= 720 then y0 end) end as footer_start from b group by doc, page")
def header_footer_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return G.bands(b, b.select("doc", "page").distinct().withColumn("height", F.lit(800.0)))


@query(f"with b as (select doc, page, cast(id % 3 * 150 + id % 7 as double) as x0 from ({BOXES}) where length(text || text || text) > 20), f as (select *, coalesce(cast(x0 - lag(x0) over (partition by doc, page order by x0) > 30 as int), 0) as far from b), g as (select *, sum(far) over (partition by doc, page order by x0) as k from f), c as (select doc, page, k, avg(x0) as l, count(*) as members from g group by all having count(*) >= 3) select doc, page, cast(row_number() over w as int) as \"column\", l as \"left\", members, case when lead(l) over w - l >= 20 then (l + lead(l) over w) / 2 end as boundary from c window w as (partition by doc, page order by l)")
def layout_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = (F.col("id") % 3 * 150 + F.col("id") % 7).cast("double")
    return G.layout_columns(boxes(spark, sf_dir).withColumns({"x0": starts, "text": F.repeat("text", F.lit(3))}))


@query(f"with b as ({BOXES}) select doc, page, string_agg(case when id % 4 = 0 then chr(10) || text || chr(10) else text end, chr(10) order by y0, x0, id) as text from b where trim(text) <> '' group by doc, page")
def element_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("id") % 4 == 0, "table").otherwise("text")
    return G.merged_elements(boxes(spark, sf_dir).withColumns({"seq": F.col("id"), "type": kind, "content": F.col("text")}))


@query(f"with b as ({BOXES}), n as (select * from b where id % 2 = 0), t as (select * from b where id % 2 = 1) select t.doc, t.page, t.id, string_agg('* ' || n.text, chr(10) order by n.y0, n.x0, '* ' || n.text) as notes from n join t on n.doc = t.doc and n.page = t.page and n.y0 - t.y1 between -3 and 30 and n.x0 < t.x1 and t.x0 < n.x1 group by all")
def annotation_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return G.notes_of_tables(b.where("id % 2 = 0").withColumn("text", F.concat(F.lit("* "), "text")), b.where("id % 2 = 1"))


@query(f"""
with recursive b as (
  {BOXES}
), s as (
  select *, (x1 - x0) * (y1 - y0) as area, row_number() over (partition by doc, page order by id % 10 / 10 - 0.15::double * (id % 3) desc, id) as n from b
), t as (
  select doc, page, n, true as taken, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'area': area}}] as kept from s where n = 1
  union all
  select s.doc, s.page, s.n, free, case when free then list_append(t.kept, {{'x0': s.x0, 'y0': s.y0, 'x1': s.x1, 'y1': s.y1, 'area': s.area}}) else t.kept end
  from t join s on s.doc = t.doc and s.page = t.page and s.n = t.n + 1,
  lateral (select len(list_filter(t.kept, lambda k: greatest(0, least(s.x1, k.x1) - greatest(s.x0, k.x0)) * greatest(0, least(s.y1, k.y1) - greatest(s.y0, k.y0)) >= 0.3::double * least(s.area, k.area))) = 0 as free) as x
)
select s.doc, s.page, s.id, s.x0, s.y0, s.x1, s.y1, cast(s.id % 10 / 10 as double) as confidence, cast(s.id % 3 as int) as priority
from s join t on t.doc = s.doc and t.page = s.page and t.n = s.n where t.taken
""")
def table_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates left after overlap suppression; tests hold it against a plain loop."""
    scored = boxes(spark, sf_dir).withColumns({"confidence": (F.col("id") % 10 / 10).cast("double"), "priority": (F.col("id") % 3).cast("int")})
    return G.best_candidates(scored.select("doc", "page", "id", "x0", "y0", "x1", "y1", "confidence", "priority"))


@query("with c as (select distinct cast(l_suppkey % 5 as int) as doc, cast(l_linenumber % 3 as int) as sheet, cast(l_orderkey % 400 as int) as r, cast(l_partkey % 30 as int) as c from lineitem), i as (select *, c - row_number() over (partition by doc, sheet, r order by c) as k from c) select doc, sheet, r, min(c) as c1, max(c) as c2 from i group by doc, sheet, r, k")
def sheet_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cell_runs(_cells(spark, sf_dir))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("cast(l_suppkey % 5 as int) as doc", "cast(l_linenumber % 3 as int) as sheet", "cast(l_orderkey % 400 as int) as r", "cast(l_partkey % 30 as int) as c")


@query("""
with recursive c as (
  select distinct cast(l_suppkey % 5 as int) as doc, cast(l_linenumber % 3 as int) as sheet, cast(l_orderkey % 400 as int) as r, cast(l_partkey % 30 as int) as c from lineitem
), i as (
  select *, c - row_number() over (partition by doc, sheet, r order by c) as k from c
), g as (
  select doc, sheet, r, min(c) as c1, max(c) as c2, row_number() over (order by doc, sheet, r, min(c)) as id from i group by doc, sheet, r, k
), p as (
  select a.id as a, b.id as b from g a join g b on a.doc = b.doc and a.sheet = b.sheet and abs(a.r - b.r) = 1 and a.c1 <= b.c2 and b.c1 <= a.c2
), w as (
  select id, id as other from g
  union
  select w.id, p.b from w join p on p.a = w.other
), m as (
  select id, min(other) as root from w group by id
), f as (
  select doc, sheet, root, min(r) as r1, min(c1) as c1, max(r) as r2, max(c2) as c2, count(*) as runs from g join m using (id) group by doc, sheet, root
)
select doc, sheet, cast(row_number() over (partition by doc, sheet order by r1, c1, r2, c2, root) - 1 as int) as block, r1, c1, r2, c2, runs from f
""")
def sheet_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of touching cells of each sheet; tests hold it against a flood fill too."""
    return G.components(_cells(spark, sf_dir))


@query("""
with c as (
  select l_suppkey as doc, 0 as page, l_orderkey as id, l_linenumber as r, k as c,
    case k when 0 then case when l_linenumber % 2 = 0 then '' else 'mode' end when 1 then l_returnflag
      else case when l_orderkey % 3 = 0 then null else l_linestatus || l_returnflag end end as text
  from lineitem, range(3) as x(k)
), rr as (
  select doc, page, id, r, count(*) as n, count(*) filter (coalesce(trim(text), '') <> '') as f, max(c) as c, count(*) filter (length(coalesce(trim(text), '')) >= 2) as m
  from c group by doc, page, id, r
), t as (
  select doc, page, id, count(*) as n_rows, cast(max(c) + 1 as bigint) as n_cols, sum(n) as n, sum(f) as f, count(*) filter (f = 0) as bare, sum(m) as m from rr group by doc, page, id
), s as (
  select *, case when n_rows < 2 then 0.0 else least(1.0, round(1.1 - case when f / n < 0.05 then 0.3 when f / n < 0.15 then 0.15 else 0 end - case when bare >= n_rows * 0.7 then 0.15 else 0 end
    - case when m < 2 then 0.15 else 0 end - case when n_rows - bare < 2 then 0.15 else 0 end, 6)) end::double as confidence from t
)
select doc, page, id, n_rows, n_cols, round(f / n, 6) as fill, confidence, confidence >= 0.35 as kept from s
""")
def candidate_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as doc", "0 as page", "l_orderkey as id", "l_linenumber as r", "array(if(l_linenumber % 2 = 0, '', 'mode'), l_returnflag, if(l_orderkey % 3 = 0, null, concat(l_linestatus, l_returnflag))) as a")
    return G.candidate_scores(rows.select("doc", "page", "id", "r", F.posexplode("a").alias("c", "text")))


STEP = "case when {x} >= {c} then {cv} when {x} >= {b} then {bv} when {x} >= {a} then {av} else 0.0 end"
COUNTED = "select p_partkey as page, p_partkey * 31 % 3000 as d, p_partkey * 31 % 3000 // 4 as c, p_partkey * 31 % 3000 // 9 as f, p_size % 30 as i, p_size % 9 as k, (p_partkey % 11) / 10.0::double as q, (p_partkey % 7) / 6.0::double as s from part"


@query(f"with p as ({COUNTED}), t as (select *, least(1.0::double, {STEP.format(x='d * 1000 / 480000.0::double', a=0.5, av=0.4, b=2, bv=0.7, c=5, cv=1.0)} + case when d > 0 then c / d::double else 0 end * 0.2::double + case when d > 0 then f / d::double else 0 end * 0.1::double) as drawn, {STEP.format(x='i * 10000 / 480000.0::double', a=0.1, av=0.3, b=0.3, bv=0.6, c=0.5, cv=1.0)} as im, case when k >= 7 then 0.95 else {STEP.format(x='k', a=2, av=0.3, b=3, bv=0.5, c=5, cv=0.75)} end as co from p), r as (select *, drawn * 0.3::double + im * 0.2::double + (1 - q) * 0.25::double + co * 0.25::double as raw from t), z as (select *, round(case when co >= 0.95 then greatest(raw, 0.9::double) else raw end, 6) as score from r), l as (select *, case when score >= 0.9 then 'EXTREME' when score >= 0.65 then 'COMPLEX' when score >= 0.35 then 'MODERATE' else 'SIMPLE' end as level from z) select page, score, level, case when q < 0.4 or (level = 'EXTREME' and q < 0.6) or (s > 0.5 and q < 0.7) then 'FULL_PAGE_OCR' when level in ('COMPLEX', 'MODERATE') then 'HYBRID' else 'TEXT' end as strategy from l")
def page_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, level and strategy of pages made from parts."""
    part = table(spark, sf_dir, "part")
    counts = part.selectExpr("p_partkey as page", "600.0D as width", "800.0D as height", "p_partkey * 31 % 3000 as n_drawings", "p_partkey * 31 % 3000 div 4 as n_curves", "p_partkey * 31 % 3000 div 9 as n_fills", "p_size % 30 as n_images", "p_size % 9 as n_columns", "(p_partkey % 11) / 10D as text_quality", "(p_partkey % 7) / 6D as complex_share")
    return G.complexity(counts).select("page", "score", "level", "strategy")


@query("select page_id, 'See ' || case when page_id % 7 = 3 then '[Image: p' || (page_id % 7) || '.png]' else 'text of p' || (page_id % 7) || '.png|' end || '<td>' || case when page_id % 7 = 3 then '[Image: p' || (page_id % 7) || '.png]' else 'text of p' || (page_id % 7) || '.png' end || '</td>' as text from pages")
def ocr_tag_substitute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image tags replaced by what a stand-in engine finds; it fails on one image, whose tags stay."""
    tag = F.concat(F.lit("[Image: p"), (F.col("page_id") % 7).cast("string"), F.lit(".png]"))
    docs = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("See "), tag, F.lit("<td>"), tag, F.lit("</td>")).alias("text"))
    return M.substituted_tags(docs, lambda path: F.when(path != "p3.png", F.concat(F.lit("text of "), path, F.lit("|"))), "page_id")


@query()
def chunk_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as paged documents, cut by pages; tests/test_tables.py holds the rules."""
    return B.chunk_by_kind(_paged(spark, sf_dir), F.lit("pdf"), size=1000, overlap=200)


@query()
def chunk_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each size as a Markdown sheet, cut between rows."""
    line = F.concat_ws(" | ", F.lit(""), "p_partkey", "p_name", "p_retailprice", F.lit(""))
    ordered = F.array_sort(F.collect_list(F.struct("p_partkey", F.trim(line).alias("t"))))
    rows = table(spark, sf_dir, "part").groupBy("p_size").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("rows"))
    head = F.concat(F.lit("[Sheet: "), F.col("p_size").cast("string"), F.lit("]\n| key | name | price |\n| --- | --- | --- |\n"), "rows")
    return B.chunk_by_kind(rows.select("p_size", head.alias("text")), F.lit("xlsx"), size=500, overlap=0)


from . import catalogue_blocks, catalogue_layout  # noqa: E402, F401  they register their queries here
