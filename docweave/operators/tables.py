"""Tables and sheets to chunks: rows are packed whole, and the header and what stands above it repeat in every chunk."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.marks import Tags
from .chunking import check, page_marks, page_number, protected_spans, spans

#: What a Markdown separator line, a table of either kind and the tags around tables look like.
SEPARATOR = re.compile(r"^\|[\s:|-]*-[\s:|-]*\|?\s*$")
TABLE = r"(?is)<table[^>]*>.*?</table>|(?m:(?:^\[Table \d+\][^\n]*\n)?(?:^\|[^\n]*\|[ ]*(?:\n|\Z)){2,})|"
ROW = re.compile(r"(?is)<tr[^>]*>(.*?)</tr>")
METADATA = re.compile(r"(?s)<Document-Metadata>.*?</Document-Metadata>")
SHEETS = ("csv", "tsv", "xlsx", "xlsm", "xltx", "xltm", "xls")
#: Room kept for a line "[Table Chunk i/n]".
LABEL = 30


def packed(sizes: list[int], room: int) -> list[tuple[int, int]]:
    """Ranges of items, taken in order while their sizes fit into `room`; a larger item stands alone."""
    out, start, used = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and used + n > room:
            out.append((start, i))
            start, used = i, 0
        used += n
    return [*out, (start, len(sizes))] if sizes else []


def row_pieces(row: str, budget: int) -> list[str]:
    """A long Markdown row as several, its longest cell cut at spaces and the others repeated; whole if no cell is half of it."""
    cells = re.split(r"(?<!\\)\|", row.strip())[1:-1]
    longest = max(range(len(cells)), key=lambda i: len(cells[i]), default=0)
    if len(row) <= budget or not cells or 2 * len(cells[longest]) < len(row):
        return [row]
    text, room = cells[longest].strip(), max(200, budget - (len(row) - len(cells[longest])) - 2)
    out = []
    while text:
        cut = len(text) if len(text) <= room else text.rfind(" ", room // 2, room + 1)
        cut = cut if cut > 0 else room
        out.append("|".join(["", *cells[:longest], f" {text[:cut].strip()} ", *cells[longest + 1 :], ""]))
        text = text[cut:].strip()
    return out


def markdown_chunks(table: str, size: int, context: str = "") -> list[str]:
    """A Markdown table in chunks of at most `size` (or one row), each with context, preamble and header."""
    lines = table.strip().split("\n")
    above = f"{context}\n" if context else ""
    if len(above) + len(table) <= size:
        return [above + table.strip()]
    at = next((i for i, x in enumerate(lines) if SEPARATOR.match(x)), 0)
    head = above + "\n".join(lines[: at + 1])
    room = max(100, size - len(head) - 1)
    rows = [p for r in lines[at + 1 :] for p in (row_pieces(r, max(room, size // 2)) if len(r) > min(room, 3 * size) else [r])]
    return ["\n".join([head, *rows[a:b]]) for a, b in packed([len(r) + 1 for r in rows], room)] or [head]


def _cells(row: str) -> list[tuple[int, int, str, str]]:
    """(rowspan, colspan, attributes without rowspan, inner HTML with its tag name) of each cell."""
    out = []
    for m in re.finditer(r"(?is)<(t[dh])([^>]*)>(.*?)</\1>", row):
        span = {k.lower(): int(v) for k, v in re.findall(r"(?i)\b(rowspan|colspan)\s*=\s*[\"']?(\d+)", m[2])}
        rest = re.sub(r"(?i)\s*\browspan\s*=\s*[\"']?\d+[\"']?", "", m[2])
        out.append((span.get("rowspan", 1), span.get("colspan", 1), f"{m[1]}{rest}", m[3]))
    return out


def _cell(name: str, body: str, rows: int) -> str:
    tag = name.split()[0]
    return f"<{name}{f' rowspan={chr(39)}{rows}{chr(39)}' if rows > 1 else ''}>{body}</{tag}>"


def _clipped(rows: list[list[tuple[int, int, str, str]]], a: int, b: int) -> list[str]:
    """Rows a to b as HTML: spans end with the chunk, and cells that reach in from above are issued again."""
    grid: dict[int, tuple[int, int, str, str]] = {}
    out = []
    for r in range(b):
        line, c = [], 0
        mine = iter(rows[r])
        while True:
            if c in grid and grid[c][0] > r:
                end, wide, name, body = grid[c]
                if r == a:
                    line.append(_cell(name, body, min(end, b) - r))
                c += wide
                continue
            grid.pop(c, None)
            cell = next(mine, None)
            if cell is None:
                break
            high, wide, name, body = cell
            grid[c] = (r + high, wide, name, body)
            line.append(_cell(name, body, min(r + high, b) - r))
            c += wide
        if any(k > c and v[0] > r for k, v in grid.items()) and r == a:
            line += [_cell(n, x, min(e, b) - r) for k, (e, _, n, x) in sorted(grid.items()) if k > c and e > r]
        if r >= a:
            out.append(f"<tr>{''.join(line)}</tr>")
    return out


def html_chunks(table: str, size: int, context: str = "", force: bool = False) -> list[str]:
    """An HTML table in chunks with context, header rows and a line "[Table Chunk i/n]".

    Rows tied by a rowspan stay together; with `force`, such a block of over 1.5 times the room is cut between rows, and its
    cells are issued again with the rows that are left.
    """
    above = f"{context}\n" if context else ""
    if len(above) + len(table) <= size:
        return [above + table]
    opening = re.match(r"(?i)<table[^>]*>", table)[0]
    rows = [_cells(m[1]) for m in ROW.finditer(table)]
    n_head = next((i for i, r in enumerate(rows) if not r or any(not n.lower().startswith("th") for *_, n, _ in r)), len(rows))
    head = "".join(_clipped(rows, 0, n_head))
    body = rows[n_head:]
    length = [sum(len(_cell(n, x, s)) for s, _, n, x in r) + 9 for r in body]
    room = max(100, size - len(above) - len(opening) - len(head) - 8 - LABEL)
    blocks, start, reach = [], 0, 0
    for i, r in enumerate(body):
        if i >= reach and i > start:
            blocks.append((start, i))
            start = i
        reach = max(reach, *(i + s for s, *_ in r), i + 1) if r else max(reach, i + 1)
    blocks += [(start, len(body))] if body else []
    sizes = [sum(length[a:b]) for a, b in blocks]
    if force:
        cut = []
        for (a, b), n in zip(blocks, sizes, strict=True):
            if n <= 1.5 * room:
                cut.append((a, b, n))
                continue
            again = sum(len(_cell(name, x, b - a)) for r in body[a:b] for s, _, name, x in r if s > 1)
            cut += [(a + x, a + y, sum(length[a + x : a + y]) + again) for x, y in packed(length[a:b], max(100, room - again))]
        blocks, sizes = [x[:2] for x in cut], [x[2] for x in cut]
    groups = [(blocks[a][0], blocks[b - 1][1]) for a, b in packed(sizes, room)]
    label = lambda i: f"[Table Chunk {i}/{len(groups)}]\n" if len(groups) > 1 else ""
    return [f"{above}{label(i)}{opening}{head}{''.join(_clipped(body, a, b))}</table>" for i, (a, b) in enumerate(groups, 1)] or [above + table]


def table_chunks(table: str, size: int, context: str = "") -> list[str]:
    if table.lstrip().lower().startswith("[chart]"):
        return [f"{context}\n{table}" if context else table]
    return html_chunks(table, size, context, force=True) if table.lstrip().lower().startswith("<table") else markdown_chunks(table, size, context)


@functools.cache
def tables_and_charts(tags: Tags = Tags()) -> re.Pattern:
    return re.compile(TABLE + ".*?".join(map(re.escape, tags.chart)))


@functools.cache
def sheet_marks(tags: Tags = Tags()) -> re.Pattern:
    before, after = tags.sheet
    return re.compile(rf"{re.escape(before.rstrip(' '))}\s*[^{re.escape(after[:1] or chr(10))}]+{re.escape(after)}")


def segments(text: str, tags: Tags = Tags()) -> Iterator[tuple[bool, str]]:
    """(is a table or chart, text) in order, without blank ones."""
    at = 0
    for m in tables_and_charts(tags).finditer(text):
        yield from ((False, t) for t in [text[at : m.start()].strip()] if t)
        yield True, m[0].strip()
        at = m.end()
    yield from ((False, t) for t in [text[at:].strip()] if t)


def sheet_chunks(text: str, size: int, tags: Tags = Tags()) -> list[tuple[str, int]]:
    """(chunk, sheet number) of sheets: metadata and sheet tag stand above every chunk, small segments share one, nothing overlaps."""
    meta = METADATA.search(text)
    body = text.replace(meta[0], "", 1) if meta else text
    mark = sheet_marks(tags)
    parts = [p.strip() for p in re.split(f"(?={mark.pattern})", body) if p.strip()]
    out: list[tuple[str, int]] = []
    known: dict[str, int] = {}
    for part in parts:
        tag = mark.match(part)
        name = tag[0] if tag else ""
        number = known.setdefault(name, len(known) + 1) if name else 1
        context = "\n".join(x for x in (meta[0] if meta else "", name) if x)
        room, held = size - len(context) - 1, ""
        room = room if room > 0 else size
        flush = lambda t: out.append((f"{context}\n{t}" if context else t, number)) if t else None  # noqa: B023, E731
        for whole, piece in segments(part[len(name) :], tags):
            if len(held) + len(piece) + 2 <= room:
                held = f"{held}\n\n{piece}" if held else piece
                continue
            flush(held)
            held = ""
            if len(piece) <= room:
                held = piece
            elif whole:
                out += [(c, number) for c in table_chunks(piece, size, context)]
            else:
                for a, b in spans(piece, room, 0):
                    flush(piece[a:b])
        flush(held)
    return out


def page_chunks(text: str, size: int, overlap: int, tags: Tags = Tags()) -> list[tuple[str, int]]:
    """(chunk, first page): whole pages share a chunk up to `size`, the last may reach 1.5 times that; over 2.25 times is split again.

    A chunk that a long page closes hands its last `overlap` characters on to the next.
    """
    mark = page_marks(tags)
    marks = [m.start() for m in mark.finditer(text)]
    edges = [0, *[m for m in marks if m], len(text)]
    pages = [text[a:b].strip() for a, b in zip(edges, edges[1:], strict=False)]
    pages = [p for p in pages if mark.sub("", p).strip()]
    number = lambda p: page_number(m) if (m := mark.match(p)) else 0
    found: list[tuple[str, int]] = []
    held, first, tail = "", 0, ""
    for page in pages:
        if held and len(held) + 4 + len(page) > int(1.5 * size):
            found.append((held, first))
            held = ""
        if not held:
            held, first, tail = (f"{tail}\n\n{page}" if tail else page), number(page), ""
            continue
        held, closes = f"{held}\n\n{page}", len(held) + 4 + len(page) > size
        if closes:
            found.append((held, first))
            held, tail = "", page[-overlap:] if overlap else ""
    found += [(held, first)] if held else []
    out = []
    for chunk, page in found:
        if len(chunk) <= 2.25 * size:
            out.append((chunk, page))
            continue
        now = page
        for a, b in protected_spans(chunk, size, overlap, tags):
            inner = [m for m in mark.finditer(chunk, 0, b) if m.start() <= a]
            now = page_number(inner[-1]) if inner else page
            out.append((chunk[a:b], now))
    return out


def document_chunks(text: str | None, ext: str | None, size: int, overlap: int, tags: Tags = Tags()) -> list[tuple[int, str, int]]:
    """(chunk_index, text, page_number) by the kind of the document; a metadata block stands above each chunk. Null and blank: one empty chunk."""
    if not text or not text.strip():
        return [(0, "", 1)]
    if ext in SHEETS:
        return [(i, t, p) for i, (t, p) in enumerate(sheet_chunks(text, size, tags))]
    meta = METADATA.search(text)
    body = text.replace(meta[0], "", 1).strip() if meta else text
    if page_marks(tags).search(body):
        found = page_chunks(body, size, overlap, tags)
    else:
        found = [(body[a:b], 1) for a, b in protected_spans(body, size, overlap, tags)]
    above = f"{meta[0]}\n\n" if meta else ""
    return [(i, above + t, p) for i, (t, p) in enumerate(found)] or [(0, above.strip(), 1)]


def chunk_by_kind(docs: DataFrame, ext: Column, text: str = "text", size: int = 1000, overlap: int = 200, tags: Tags = Tags()) -> DataFrame:
    """Rows of docs without `text`, one for each chunk, with chunk_index, text and page_number, split as the file type `ext` asks.

    Tables are cut between rows, pages are kept whole where they fit. A document stays in its row: no shuffle.
    """
    check(size, overlap)
    others = [c for c in docs.columns if c not in (text, "chunk_index", "page_number")]
    kept = docs.select(*others, F.lower(ext).alias("_ext"), F.col(text).alias("_text"))
    n = len(others)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:n]]

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, found = [], []
            for i, (e, t) in enumerate(zip(batch.column(n), batch.column(n + 1), strict=True)):
                rows = document_chunks(t.as_py(), e.as_py(), size, overlap, tags)
                of += [i] * len(rows)
                found += rows
            take = pa.array(of, pa.int64())
            columns = list(zip(*found, strict=True)) if found else [()] * 3
            types = (pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(n)), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*others, "chunk_index", "text", "page_number"])

    return kept.mapInArrow(chunk, ", ".join([*fields, "chunk_index int", "text string", "page_number int"]))
