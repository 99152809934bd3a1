"""Files to rows: whole files, decoded text, delimited files, pages."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CATEGORIES, category, clean_code, clean_text, extension
from .office import hancom_text, html_workbook, rich_text, slide_text, workbook_text

#: Encodings in the order in which they are tried.
ENCODINGS = ("utf-8", "cp949", "euc-kr", "latin-1")
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, ext, category) of all files; content is only read where it is used."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = extension(F.col("path"))
    return found.select("path", "length", "content", ext.alias("ext"), category(ext).alias("category"))


def decoded(data: bytes) -> tuple[str, str]:
    for mark, name in MARKS:
        if data.startswith(mark):
            return data.decode(name, "replace").lstrip("﻿"), name
    for name in ENCODINGS:
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1"), "latin-1"


def delimited(text: str, ext: str) -> str:
    """Delimited rows as a Markdown table; blank header cells become column letters, blank rows go."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n")
    head = lines.split("\n")[:20]
    marks = "\t" if ext == "tsv" else max(",\t;|", key=lambda d: (min((x.count(d) for x in head if x), default=0), sum(x.count(d) for x in head)))
    rows = [r for r in csv.reader(io.StringIO(lines), delimiter=marks, skipinitialspace=True) if any(c.strip() for c in r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    cell = lambda c: " ".join(c.split()).replace("|", "\\|")
    padded = [[cell(c) for c in r] + [""] * (width - len(r)) for r in rows]
    padded[0] = [c or _letter(i) for i, c in enumerate(padded[0], 1)]
    out = [f"| {' | '.join(r)} |" for r in padded]
    return "\n".join([out[0], "|" + " --- |" * width, *out[1:]])


def _letter(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def word_text(data: bytes) -> str:
    """Paragraphs and tables of a .docx body in order, with a page tag where a page begins."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    body = next(e for e in root.iter() if _local(e.tag) == "body")
    out, page = ["[Page Number: 1]"], 1

    def words(e) -> str:
        text = {"t": lambda x: x.text or "", "tab": lambda x: "\t", "br": lambda x: "\n"}
        return "".join(text[_local(x.tag)](x) for x in e.iter() if _local(x.tag) in text)

    for e in body:
        kind = _local(e.tag)
        breaks = sum(1 for x in e.iter() if _local(x.tag) == "lastRenderedPageBreak" or _local(x.tag) == "br" and any(v == "page" for v in x.attrib.values()))
        if breaks:
            page += breaks
            out.append(f"[Page Number: {page}]")
        if kind == "tbl":
            rows = [[words(c) for c in r if _local(c.tag) == "tc"] for r in e if _local(r.tag) == "tr"]
            out.append("<table border='1'>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>")
        elif words(e).strip():
            out.append(words(e))
    return "\n".join(out)


def sheet_text(data: bytes) -> str:
    """Sheets of an .xlsx file in order, each a tag and a Markdown table of its cells."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in s.iter() if _local(t.tag) == "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(s.tag) == "si"]
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    titles = [e.attrib.get("name", "") for e in book.iter() if _local(e.tag) == "sheet"]
    out = []
    for i, title in enumerate(titles, 1):
        if f"xl/worksheets/sheet{i}.xml" not in names:
            continue
        rows: list[list[str]] = []
        for r in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter():
            if _local(r.tag) != "row":
                continue
            row: dict[int, str] = {}
            for c in r:
                at = 0
                for ch in c.attrib.get("r", "").rstrip("0123456789"):
                    at = 26 * at + ord(ch) - 64
                value = "".join(x.text or "" for x in c.iter() if _local(x.tag) in ("v", "t"))
                row[at or len(row) + 1] = shared[int(value)] if c.attrib.get("t") == "s" and value else value
            rows.append([row.get(k, "") for k in range(1, max(row, default=0) + 1)])
        text = io.StringIO()
        csv.writer(text).writerows(rows)
        out.append(f"[Sheet: {title}]\n" + delimited(text.getvalue(), "csv"))
    return "\n\n".join(out)


SCHEMA = "path string, ext string, category string, text string, encoding string, error string"
#: First bytes of image formats.
IMAGES = (b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n", b"GIF87a", b"GIF89a", b"BM", b"RIFF")
WORKBOOKS = ("xlsx", "xlsm", "xltx", "xltm")


def office_text(path: str, ext: str, data: bytes, layout: bool, hidden: bool) -> str | None:
    """Text of a file that is no plain text; None if its bytes are plain text. ValueError: there is no reader for it."""
    start = data[:1024].lstrip().lower()
    if ext in WORKBOOKS or ext == "xls":
        if start.startswith((b"<html", b"<!doctype html", b"<table", b"<meta")):
            return html_workbook(decoded(data)[0], path.rsplit("/", 1)[-1].rsplit(".", 1)[0])
        if ext != "xls" or data[:2] == b"PK":
            return workbook_text(data, hidden) if layout else sheet_text(data)
    if ext in ("docx", "doc") and data[:2] == b"PK" or ext == "docx":
        return word_text(data)
    if ext in ("rtf", "doc") and start.startswith(b"{\\rtf") or ext == "rtf":
        return rich_text(data)
    if ext in ("pptx", "ppt"):
        return slide_text(data)
    if ext == "hwpx":
        return hancom_text(data)
    if ext in CATEGORIES["image"].split():
        if not data.startswith(IMAGES):
            raise ValueError("bytes of no known image format")
        return f"[Image: {path}]"
    if ext in CATEGORIES["document"].split() or ext == "xls" or category_of(ext) == "unknown":
        raise ValueError(f"no reader for .{ext}")
    return None


def category_of(ext: str) -> str:
    return next((k for k, v in CATEGORIES.items() if ext in v.split()), "unknown")


def _extract(layout: bool, hidden: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, ext, kind, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                text = encoding = error = None
                try:
                    text = office_text(path, ext, data or b"", layout, hidden)
                    if text is None:
                        text, encoding = decoded(data or b"")
                        text = delimited(text, ext) if ext in ("csv", "tsv") else text
                except (KeyError, ValueError, IndexError, zipfile.BadZipFile, ElementTree.ParseError, StopIteration, csv.Error) as e:
                    text, error = None, f"{type(e).__name__}: {e}"
                out.append((path, ext, kind, text, encoding, error))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return each


def read_documents(spark: SparkSession, path: str, mode: str = "PERMISSIVE", layout: bool = False, hidden: bool = True) -> DataFrame:
    """(path, ext, category, text, encoding, error) of all files below path.

    A file of no bytes gives no row. A file that can't be read has a null text and an error; DROPMALFORMED leaves it out, FAILFAST raises. With `layout`, sheets
    are laid out as blocks with displayed values, merged headers and captions, else each is one table of stored values;
    `hidden` false leaves out what is hidden there.
    """
    found = files(spark, path).select("path", "ext", "category", "content").mapInArrow(_extract(layout, hidden), SCHEMA)
    source = F.col("text")
    found = found.withColumn("text", F.when(F.col("category").isin("code", "script"), clean_code(source)).when(F.col("category") == "data", source).otherwise(clean_text(source)))
    if mode == "DROPMALFORMED":
        return found.where("error is null")
    if mode == "FAILFAST":
        return found.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat("path", F.lit(": "), "error"))))
    return found
