"""Page sections, marker-only chunks, small chunks and image tags: folds over arrays and joins on distinct tags."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.marks import Tags


def _marker(tags: Tags) -> str:
    return f"(?:{tags.pattern('page')}|{tags.pattern('slide')})"


#: A page or slide tag as it usually is.
MARKER = _marker(Tags())


def _starts(tags: Tags) -> str:
    """What a text begins with that opens a page, slide or sheet."""
    return rf"^\s*(?:{'|'.join(re.escape(getattr(tags, k)[0].rstrip()) for k in ('page', 'slide', 'sheet'))})"


def _image(tags: Tags) -> str:
    """An image tag in capitals or not, its path (in braces or not) being group 1."""
    before, after = tags.image
    open_ = re.sub(r"([A-Za-z]+)", r"(?i:\1)\\s*", re.escape(before))
    stop = re.escape(after[:1] or "\n")
    return rf"{open_}\s*\{{?([^{stop}\}}]+)\}}?{re.escape(after)}"


def page_sections(docs: DataFrame, key: str = "doc_id", text: str = "text", tags: Tags = Tags()) -> DataFrame:
    """(key, page, section): text from each page or slide marker to the next; text before the first is page 0, sections without text go."""
    marker = _marker(tags)
    each = docs.select(key, F.explode(F.split(text, f"(?={marker})")).alias("s"))
    digits = F.regexp_extract("s", f"^{marker}", 1)
    number = F.coalesce(F.when(digits != "", digits).otherwise(F.regexp_extract("s", f"^{marker}", 2)).try_cast("int"), F.lit(0))
    return each.select(key, number.alias("page"), F.trim(F.regexp_replace(F.regexp_replace("s", marker, ""), r"^\s+|\s+$", "")).alias("section")).where("section != ''")


def joined_markers(chunks: Column, tags: Tags = Tags()) -> Column:
    """Chunks without the blank ones; a chunk that is only a marker goes to the front of the next, or to the end of the last."""
    begin = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))

    def step(s: Column, x: Column) -> Column:
        glue = lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit("\n\n"), b))
        only = x.rlike(rf"^\s*{_marker(tags)}\s*$")
        blank = F.trim(F.regexp_replace(x, r"\s+", " ")) == ""
        out = F.when(blank | only, s["out"]).otherwise(F.concat(s["out"], F.array(glue(s["held"], x))))
        held = F.when(blank, s["held"]).when(only, glue(s["held"], F.regexp_replace(x, r"^\s+|\s+$", ""))).otherwise(F.lit(""))
        return F.struct(out.alias("out"), held.alias("held"))

    def finish(s: Column) -> Column:
        n = F.size(s["out"])
        last = F.concat(F.slice(s["out"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.get(s["out"], n - 1), F.lit("\n\n"), s["held"])))
        return F.when(s["held"] == "", s["out"]).when(n == 0, F.array(s["held"])).otherwise(last)

    return F.aggregate(chunks, begin, step, finish)


def merged_small(chunks: Column, size: int = 1000, share: float = 0.1, tags: Tags = Tags()) -> Column:
    """Chunks under `share` of `size` take in the next ones that don't begin with a marker; what is still small goes to the chunk before."""
    least = int(share * size)
    begin = F.array().cast("array<string>")

    def step(out: Column, x: Column) -> Column:
        n = F.size(out)
        last = F.get(out, n - 1)
        joined = F.concat(F.slice(out, 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(last, F.lit("\n\n"), x)))
        return F.when((n > 0) & (F.length(last) < least) & ~x.rlike(_starts(tags)), joined).otherwise(F.concat(out, F.array(x)))

    def back(out: Column, x: Column) -> Column:
        n = F.size(out)
        joined = F.concat(F.slice(out, 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.get(out, n - 1), F.lit("\n\n"), x)))
        return F.when((n > 0) & (F.length(x) < least), joined).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.aggregate(chunks, begin, step), begin, back)


def cell_safe(text: Column) -> Column:
    """Recognised text for a table cell: fences, tags, table lines and bars go, white space is squeezed, the rest is escaped."""
    for pattern in (r"```[A-Za-z]*", r"<[^>]*>", r"\|?(?:\s*:?-{3,}:?\s*\|)+", r"\|"):
        text = F.regexp_replace(text, pattern, " ")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def substituted_tags(docs: DataFrame, recognise: Callable[[Column], Column], key: str = "doc_id", text: str = "text", tags: Tags = Tags()) -> DataFrame:
    """(key, text) with each image tag replaced by `recognise` of its path, flat inside table cells.

    Each distinct path is recognised once for the whole corpus. A path whose result is null keeps its tag. Rows stay apart by
    key and a hash of their text; repeated rows count each, a null key is kept, a null text stays null.
    """
    row, image = [key, "_row", "_text"], _image(tags)
    named = docs.select(F.col(key), F.xxhash64(text).alias("_row"), F.md5(text).alias("_text"), F.col(text).alias("_whole"))
    rows = named.groupBy(*row).agg(F.first("_whole").alias("_whole"), F.count("*").alias("_times"))
    parts = rows.where("_whole is not null").select(*row, "_times", F.posexplode(F.split("_whole", rf"(?={image})|(?<={re.escape(tags.image[1])})")).alias("at", "part"))
    depth = F.regexp_count("part", F.lit(r"(?i)<t[dh][\s>]")) - F.regexp_count("part", F.lit(r"(?i)</t[dh]>"))
    open_cells = F.sum(depth).over(Window.partitionBy(*row).orderBy("at"))
    parts = parts.withColumn("path", F.regexp_extract("part", f"^{image}$", 1)).withColumn("inside", open_cells > 0)
    known = parts.where("path != ''").select("path").distinct().withColumn("found", recognise(F.col("path")))
    both = parts.join(known, "path", "left")
    shown = F.when(F.col("found").isNull(), F.col("part")).when(F.col("inside"), cell_safe(F.col("found"))).otherwise(F.col("found"))
    ordered = F.array_sort(F.collect_list(F.struct("at", shown.alias("t"))))
    filled = both.groupBy(*row, "_times").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "").alias(text))
    out = filled.unionByName(rows.where("_whole is null").select(*row, "_times", F.lit(None).cast("string").alias(text)))
    return out.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(key, text)
