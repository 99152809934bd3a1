"""Tags in texts: made, found, asked for and removed, with prefixes and suffixes that a Tags object sets."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tags:
    """What stands before and after a page, slide or sheet name, an image path and a chart."""

    page: tuple[str, str] = ("[Page Number: ", "]")
    slide: tuple[str, str] = ("[Slide Number: ", "]")
    sheet: tuple[str, str] = ("[Sheet: ", "]")
    image: tuple[str, str] = ("[Image:", "]")
    chart: tuple[str, str] = ("[chart]", "[/chart]")

    def pattern(self, kind: str) -> str:
        """A regular expression for the tag, its value being group 1; page and slide numbers may be followed by a remark."""
        before, after = map(_literal, getattr(self, kind))
        stop = re.escape(getattr(self, kind)[1][:1])
        inner = rf"\s*(\d+)[^{stop}]*" if kind in ("page", "slide") else rf"\s*([^{stop}]+)"
        return f"{before.rstrip(' ')}{inner}{after}" if kind != "chart" else f"(?s){before}(.*?){after}"


def _literal(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", text)


def tag(kind: str, value: Column, tags: Tags = Tags()) -> Column:
    """The tag of a value; null for a null value."""
    before, after = getattr(tags, kind)
    return F.concat(F.lit(before), value.cast("string"), F.lit(after))


def found_tags(text: Column, kind: str, tags: Tags = Tags()) -> Column:
    """The values of all tags of a kind, in order."""
    return F.regexp_extract_all(text, F.lit(tags.pattern(kind)), F.lit(1))


def has_tag(text: Column, kind: str, tags: Tags = Tags()) -> Column:
    return text.rlike(tags.pattern(kind))


def without_tags(text: Column, kind: str, tags: Tags = Tags()) -> Column:
    """The text without the tags of a kind, each with one line end after it."""
    return F.regexp_replace(text, tags.pattern(kind) + r"\n?", "")


def without_fields(text: Column) -> Column:
    """Field codes of a document (U+0013 instruction U+0014 shown U+0015) replaced by what they show, inner ones first.

    A field without U+0014 shows nothing; as many passes as the deepest field needs. Marks that close or open nothing go.
    """
    shown, bare = "\x13[^\x13\x14\x15]*\x14([^\x13\x15]*)\x15", "\x13[^\x13\x14\x15]*\x15"
    marks = F.regexp_extract_all(text, F.lit("[\x13\x15]"), F.lit(0))
    none = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))

    def deeper(s: Column, mark: Column) -> Column:
        now = F.greatest(F.lit(0), s["open"] + F.when(mark == "\x13", 1).otherwise(-1))
        return F.struct(now.alias("open"), F.greatest(s["most"], now).alias("most"))

    depth = F.aggregate(marks, none, deeper, lambda s: s["most"])
    opened = F.aggregate(F.sequence(F.lit(0), depth), text, lambda t, _: F.regexp_replace(F.regexp_replace(t, shown, "$1"), bare, ""))
    return F.translate(opened, "\x13\x14\x15", "")


def is_markdown_table(text: Column) -> Column:
    """At least two lines, of which one begins with a bar and one is a separator with a bar."""
    lines = F.split(F.trim(text), "\n", -1)
    bar = F.exists(lines, lambda x: F.startswith(F.trim(x), F.lit("|")))
    rule = F.exists(lines, lambda x: F.contains(x, F.lit("---")) & F.contains(x, F.lit("|")))
    return (F.size(lines) >= 2) & bar & rule


def numbered(n: Column, scheme: str) -> Column:
    """A list number under an OOXML scheme: arabic, alphaLc, alphaUc, romanLc or romanUc, then Plain, Period, ParenR or ParenBoth."""
    from .text import column_letter, roman

    kind, shape = re.fullmatch(r"(arabic|alphaLc|alphaUc|romanLc|romanUc)(Plain|Period|ParenR|ParenBoth)", scheme).groups()
    shown = n.cast("string") if kind == "arabic" else column_letter(n) if kind[:5] == "alpha" else roman(n)
    shown = F.lower(shown) if kind.endswith("Lc") else shown
    before, after = {"Plain": ("", ""), "Period": ("", "."), "ParenR": ("", ")"), "ParenBoth": ("(", ")")}[shape]
    return F.concat(F.lit(before), shown, F.lit(after))


def pdf_date(text: Column) -> Column:
    """The time of a date such as D:20240131120000; of 8 to 13 digits the day alone, null for anything else."""
    digits = F.regexp_replace(text, "^D:", "")
    whole = F.try_to_timestamp(F.substring(digits, 1, 14), F.lit("yyyyMMddHHmmss"))
    day = F.try_to_timestamp(F.substring(digits, 1, 8), F.lit("yyyyMMdd"))
    return F.when(F.length(digits) >= 14, whole).when(F.length(digits) >= 8, day)


def chunk_position(chunk: Column, text: Column) -> Column:
    """Where a chunk begins in a text, from 0: by the whole chunk, else by its first line of 10 or more characters, else by its
    first 50; -1 if none is there."""
    bare = F.regexp_replace(chunk, r"^\s+|\s+$", "")
    line = F.trim(F.split(bare, "\n", 2)[0])
    by_line = F.when(F.length(line) >= 10, F.position(line, text) - 1)
    head = F.when(F.length(bare) >= 10, F.position(F.substring(bare, 1, 50), text) - 1)
    at = F.position(chunk, text) - 1
    return F.when(at >= 0, at).when(by_line >= 0, by_line).when(head >= 0, head).otherwise(F.lit(-1))
