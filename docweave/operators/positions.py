"""Pages of texts by file type, and texts put together again from overlapping chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.marks import Tags

#: File types whose pages are told by markers, those without any that get estimated pages, and workbooks.
PAGED, ESTIMATED, WORKBOOKS = ("pdf", "ppt", "pptx", "doc", "docx"), ("doc", "docx"), ("xlsx", "xlsm", "xltx", "xltm", "xls")


def page_map(docs: DataFrame, chars: int = 1500, lines: int = 1000, tags: Tags = Tags()) -> DataFrame:
    """(doc_id, page, start, end) of docs (doc_id, ext, text), positions being code points, the end not included.

    Types with pages: from each page marker, or if there is none slide marker, to the next; documents of a word
    processor without markers have pages of `chars`. Workbooks: from each sheet marker to the next, a name counting by
    its first appearance. A number too long for an integer is page 0. Other types: `lines` lines a page. A text without such marks is one page; null texts have none.
    doc_id must be unique: sheets are numbered within it.
    """
    ext = F.lower(F.coalesce("ext", F.lit("")))
    page, slide, sheet = (tags.pattern(k) for k in ("page", "slide", "sheet"))
    mark = F.when(ext.isin(*WORKBOOKS) & F.col("text").rlike(sheet), "sheet").when(ext.isin(*PAGED) & F.col("text").rlike(page), "page").when(ext.isin(*PAGED) & F.col("text").rlike(slide), "slide")
    rule = mark.when(ext.isin(*ESTIMATED), "chars").when(~ext.isin(*PAGED, *WORKBOOKS), "lines").otherwise("one")
    known = docs.where("text is not null").select("doc_id", "text", rule.alias("rule"))

    def marked(kind: str, pattern: str) -> DataFrame:
        parts = known.where(F.col("rule") == kind).select("doc_id", F.posexplode(F.split("text", f"(?={pattern})")).alias("i", "part"))
        before = F.sum(F.length("part")).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
        parts = parts.withColumn("start", F.coalesce(before, F.lit(0))).where(F.col("part").rlike(f"^{pattern}"))
        return parts.select("doc_id", F.regexp_extract("part", f"^{pattern}", 1).alias("name"), "start", (F.col("start") + F.length("part")).alias("end"))

    numbered = [marked(k, p).withColumn("page", F.coalesce(F.col("name").try_cast("int"), F.lit(0))).drop("name") for k, p in (("page", page), ("slide", slide))]
    sheets = marked("sheet", sheet).withColumn("name", F.trim("name"))
    first = sheets.withColumn("first", F.min("start").over(Window.partitionBy("doc_id", "name")))
    sheets = first.withColumn("page", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first"))).drop("name", "first")
    length = F.length("text")
    of_chars = known.where("rule = 'chars'").select("doc_id", length.alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((length - 1) / chars).cast("int")))).alias("i"))
    of_chars = of_chars.select("doc_id", (F.col("i") + 1).alias("page"), (F.col("i") * chars).alias("start"), F.least(F.col("n"), (F.col("i") + 1) * chars).alias("end"))
    each = known.where("rule = 'lines'").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    of_lines = each.groupBy("doc_id", F.floor(F.col("i") / lines).cast("int").alias("i")).agg(F.sum(F.length("line") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_lines = of_lines.withColumn("start", before).select("doc_id", (F.col("i") + 1).alias("page"), "start", (F.col("start") + F.col("n") - 1).alias("end"))
    whole = known.where("rule = 'one'").select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("start"), length.alias("end"))
    out = None
    for part in (*numbered, sheets, of_chars, of_lines, whole):
        part = part.select("doc_id", F.col("page").cast("int").alias("page"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
        out = part if out is None else out.union(part)
    return out


def reconstructed(chunks: DataFrame, overlap: int) -> DataFrame:
    """(doc_id, text) of chunks (doc_id, chunk_index, text): each chunk without the longest start, of at most `overlap`
    characters, that ends the chunk before. Null chunks are empty."""
    text = F.coalesce("text", F.lit(""))
    before = F.lag(text).over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    pairs = chunks.select("doc_id", "chunk_index", text.alias("text"), F.coalesce(before, F.lit("")).alias("before"))
    most = F.least(F.length("text"), F.length("before"), F.lit(overlap))
    same = F.filter(F.sequence(F.lit(0), most), lambda k: F.right(F.col("before"), k) == F.left(F.col("text"), k))
    fresh = pairs.select("doc_id", "chunk_index", F.substring("text", F.array_max(same) + 1, F.length("text")).alias("t"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "t")))
    return fresh.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "").alias("text"))
