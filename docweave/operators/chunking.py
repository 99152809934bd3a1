"""Text to chunks with positions: a recursive splitter that never cuts protected regions."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.marks import Tags

SEPARATORS = ("\n\n", "\n", " ", "")
TABLE_TAG = re.compile(r"(?i)<table[^>]*>|</table>")
CHUNKS = "chunk_index int, text string, page_number int, line_start int, line_end int, global_start int, global_end int"

CODE = "chunk_index int, text string, line_start int, line_end int, global_start int, global_end int"
#: What begins a new part of a program, by language, and the languages of file types.
PARTS = {
    "python": "class def",
    "js": "function const let var class if for while switch case default",
    "ts": "enum interface namespace type class function const let var if for while switch case default",
    "java": "class public protected private static if for while switch case",
    "cpp": "class void int float double if for while switch case",
    "csharp": "interface enum implements delegate event class abstract public protected private static return if continue for foreach while switch break case else try throw finally catch",
    "go": "func var const type if for switch case",
    "rust": "fn const let if while for loop match",
    "php": "function class if foreach while do switch case",
    "ruby": "def class if unless while for do begin rescue",
    "swift": "func class struct enum if for while do switch case",
    "kotlin": "class public protected private internal companion fun val var if for while when case else",
    "scala": "class object def val var if for while match case",
}
MARKUP = "body div p br li h1 h2 h3 h4 h5 h6 span table tr td th ul ol header footer nav head style script meta title"
LANGUAGES = {"py": "python", "js": "js", "jsx": "js", "tsx": "js", "ts": "ts", "java": "java", "cpp": "cpp", "c": "cpp", "cs": "csharp", "go": "go", "rs": "rust", "php": "php", "rb": "ruby", "swift": "swift", "kt": "kotlin", "scala": "scala"}


def code_separators(ext: str | None) -> tuple[str, ...]:
    """The separators of a file type from the widest to the narrowest; those of plain text for other types."""
    ext = (ext or "").lower().lstrip(".")
    if ext == "html":
        return (*(f"<{name}" for name in MARKUP.split()), "")
    parts = PARTS.get(LANGUAGES.get(ext, ""), "").split()
    inner = ("\n\tdef ",) if ext == "py" else ()
    return (*(f"\n{p} " for p in parts), *inner, *SEPARATORS)


@functools.cache
def protected(tags: Tags = Tags()) -> re.Pattern:
    """What a chunk never cuts: tables, charts, text boxes, tags and the metadata block."""
    def mark(kind: str, inner: str) -> str:
        before, after = getattr(tags, kind)
        return re.escape(before) + inner.format(stop=re.escape(after[:1] or "\n")) + re.escape(after)

    marks = [mark("chart", ".*?"), mark("image", "[^{stop}]*"), mark("page", r"\d+[^{stop}]*"), mark("slide", r"\d+[^{stop}]*"), mark("sheet", "[^{stop}]*")]
    parts = [r"<table[^>]*>.*?</table>", *marks, r"\[textbox\].*?\[/textbox\]", "<Document-Metadata>.*?</Document-Metadata>", r"(?m:(?:^\|.*\|[ ]*(?:\n|\Z)){2,})"]
    return re.compile("(?is)" + "|".join(parts))


@functools.cache
def page_marks(tags: Tags = Tags()) -> re.Pattern:
    """Page and slide tags; group 1 or 2 is the number."""
    one = lambda kind: rf"{re.escape(getattr(tags, kind)[0])}(\d+)[^{re.escape(getattr(tags, kind)[1][:1] or chr(10))}]*{re.escape(getattr(tags, kind)[1])}"
    return re.compile(f"{one('page')}|{one('slide')}")


def page_number(mark: re.Match) -> int:
    """The number of a page mark; 0 for one too long for an integer."""
    n = int((mark[1] or mark[2])[:11])
    return n if n < 1 << 31 else 0


def check(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than the chunk size")


def spans(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """Ranges of at most `size` characters that together hold all but white space, by the first separator there is."""

    def pieces(a: int, b: int, seps: tuple[str, ...]) -> Iterator[tuple[int, int]]:
        if b - a <= size:
            yield a, b
            return
        i = next(i for i, s in enumerate(seps) if not s or text.find(s, a + 1, b) >= 0)
        if not seps[i]:
            yield from ((k, min(k + size, b)) for k in range(a, b, size))
            return
        cut = a
        while cut < b:
            end = text.find(seps[i], cut + 1, b)
            end = b if end < 0 else end
            yield from pieces(cut, end, seps[i + 1 :])
            cut = end

    out: list[tuple[int, int]] = []
    window: list[tuple[int, int]] = []
    for a, b in pieces(0, len(text), separators):
        if window and b - window[0][0] > size:
            out.append((window[0][0], window[-1][1]))
            while window and (window[-1][1] - window[0][0] > overlap or b - window[0][0] > size):
                window.pop(0)
        window.append((a, b))
    if window:
        out.append((window[0][0], window[-1][1]))
    return [s for s in (stripped(text, a, b) for a, b in out) if s[0] < s[1]]


def stripped(text: str, a: int, b: int) -> tuple[int, int]:
    part = text[a:b]
    return a + len(part) - len(part.lstrip()), a + len(part.rstrip()) if part.strip() else a


def regions(text: str, tags: Tags = Tags()) -> list[tuple[int, int]]:
    """Ranges of protected regions in order; a table ends where its own closing tag is, whatever tables it holds."""
    out, at = [], 0
    while m := protected(tags).search(text, at):
        at = m.end()
        if m[0][:6].lower() == "<table":
            depth = 0
            for t in TABLE_TAG.finditer(text, m.start()):
                depth += -1 if t[0][1] == "/" else 1
                if not depth:
                    at = t.end()
                    break
        out.append((m.start(), at))
    return out


def protected_spans(text: str, size: int, overlap: int, tags: Tags = Tags()) -> list[tuple[int, int]]:
    """Like spans, but a protected region stays whole, in a chunk of its own if it is larger than `size`."""
    out: list[tuple[int, int]] = []
    at = 0
    units: list[tuple[int, int, bool]] = []
    for a, b in regions(text, tags):
        units += [(at, a, False), (a, b, True)]
        at = b
    units.append((at, len(text), False))
    start = end = None
    for a, b, whole in units:
        if a == b:
            continue
        if start is not None and b - start <= size:
            end = b
            continue
        if start is not None:
            out.append((start, end))
        start = end = None
        if whole or b - a <= size:
            start, end = a, b
        else:
            mine = [(a + x, a + y) for x, y in spans(text[a:b], size, overlap)]
            out += mine[:-1]
            if mine:
                start, end = mine[-1]
    if start is not None:
        out.append((start, end))
    return [s for s in (stripped(text, a, b) for a, b in out) if s[0] < s[1]]


def chunk_rows(text: str | None, size: int, overlap: int, tags: Tags = Tags()) -> list[tuple]:
    if not text or not text.strip():
        return [(0, "", 1, 1, 1, 0, 0)]
    pages = [(m.start(), page_number(m)) for m in page_marks(tags).finditer(text)]
    rows, line, seen = [], 1, 0
    for i, (a, b) in enumerate(protected_spans(text, size, overlap, tags)):
        if a >= seen:
            line += text.count("\n", seen, a)
        else:
            line -= text.count("\n", a, seen)
        seen = a
        number = next((n for at, n in reversed(pages) if at <= a), 1)
        rows.append((i, text[a:b], number, line, line + text.count("\n", a, b), a, b - 1))
    return rows


def code_rows(text: str | None, ext: str | None, size: int, overlap: int) -> list[tuple]:
    """(chunk_index, text, line_start, line_end, global_start, global_end) of a code file's chunks."""
    if not text or not text.strip():
        return [(0, "", 1, 1, 0, 0)]
    rows, line, seen = [], 1, 0
    for i, (a, b) in enumerate(spans(text, size, overlap, code_separators(ext))):
        line += text.count("\n", seen, a) if a >= seen else -text.count("\n", a, seen)
        seen = a
        rows.append((i, text[a:b], line, line + text.count("\n", a, b), a, b - 1))
    return rows


def _chunked(docs: DataFrame, used: list[str], kind: str, rows: Callable[..., list[tuple]]) -> DataFrame:
    """docs without the column used[0], one row for each that `rows` gives for the columns `used`, with the columns of `kind`."""
    others = [c for c in docs.columns if c != used[0]]
    kept = docs.select(*others, used[0])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), kind])
    names, types = zip(*[c.strip().split(" ") for c in kind.split(",")], strict=True)
    arrow = {"int": pa.int32(), "string": pa.string()}
    places = [kept.columns.index(c) for c in used]

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, found = [], []
            for i, values in enumerate(zip(*(batch.column(p).to_pylist() for p in places), strict=True)):
                new = rows(*values)
                of += [i] * len(new)
                found += new
            take = pa.array(of, pa.int64())
            columns = list(zip(*found, strict=True)) if found else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(len(others))), *(pa.array(c, arrow[t]) for c, t in zip(columns, types, strict=True))], names=[*others, *names])

    return kept.mapInArrow(chunk, schema)


def chunk_documents(docs: DataFrame, text: str = "text", size: int = 1000, overlap: int = 200, tags: Tags = Tags()) -> DataFrame:
    """Rows of docs without `text`, one for each chunk, with CHUNKS' columns; positions are code points of the text.

    A document stays in its row, so there is no shuffle. Null and blank texts give one empty chunk.
    """
    check(size, overlap)
    return _chunked(docs, [text], CHUNKS, lambda t: chunk_rows(t, size, overlap, tags))


def chunk_code(docs: DataFrame, text: str = "text", ext: str = "ext", size: int = 1500, overlap: int = 300) -> DataFrame:
    """Rows of docs without `text`, one for each chunk of a code file, cut by the separators of its type, with the columns of CODE.

    A separator stays with what follows it, and together the chunks hold all but white space between them. Types without a
    language, and null ones, are cut like plain text; null and blank texts give one empty chunk.
    """
    check(size, overlap)
    return _chunked(docs, [text, ext], CODE, lambda t, e: code_rows(t, e, size, overlap))


def estimated_chunks(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    n = F.length(text)
    more = F.greatest(F.lit(1), F.floor((n - overlap) / (size - overlap)).cast("int") + 1)
    return F.when(n == 0, 0).when(n <= size, 1).otherwise(more).cast("int")


def fixed_windows(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Windows of `size` characters that overlap by `overlap`: (doc_id, chunk_index, text, start)."""
    check(size, overlap)
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - size) / step).cast("int"))
    each = docs.where("length(text) > 0").select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    return each.select("doc_id", "chunk_index", F.substring("text", F.col("chunk_index") * step + 1, F.lit(size)).alias("text"), (F.col("chunk_index") * step).alias("start"))


def pack_rows(rows: DataFrame, keys: list[str], order: list[str], text: str, budget: int) -> DataFrame:
    """Greedy packing of table rows, in order, into chunks of at most `budget` characters (a longer row stands alone).

    Adds chunk to (keys, order, text); one fold over each table's row lengths, so a table is one group. The fold keeps
    only where chunks begin.
    """
    items = F.array_sort(F.collect_list(F.struct(*order, F.length(text).alias("_n"))))
    tables = rows.groupBy(*keys).agg(items.alias("_items"))
    begin = F.struct(F.lit(0).alias("i"), F.lit(0).alias("used"), F.array(F.lit(0)).alias("breaks"))

    def step(s: Column, x: Column) -> Column:
        need = x["_n"] + 1
        fresh = (s["used"] > 0) & (s["used"] + need > budget)
        breaks = F.when(fresh, F.concat(s["breaks"], F.array(s["i"]))).otherwise(s["breaks"])
        return F.struct((s["i"] + 1).alias("i"), F.when(fresh, need).otherwise(s["used"] + need).alias("used"), breaks.alias("breaks"))

    packed = tables.withColumn("_breaks", F.aggregate("_items", begin, step)["breaks"])
    each = packed.select(*keys, "_items", "_breaks", F.posexplode("_breaks").alias("chunk", "_from"))
    end = F.coalesce(F.get("_breaks", F.col("chunk") + 1), F.size("_items"))
    parts = each.select(*keys, "chunk", F.explode(F.slice("_items", F.col("_from") + 1, end - F.col("_from"))).alias("_x"))
    return parts.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in order], "chunk")
