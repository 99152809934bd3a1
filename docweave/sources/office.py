"""Texts of packaged and tagged office files: slides, workbooks, Hancom sections, rich text, HTML workbooks. Small parsers that run inside a task."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable
from html.parser import HTMLParser
from xml.etree import ElementTree

from ..functions.formats import BUILT_IN, is_date, shown

Cell = tuple[int, int]


def local(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def below(e, *names: str) -> list:
    return [x for x in e.iter() if local(x) in names]


def attribute(e, name: str, default: str = "") -> str:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), default)


def package(data: bytes) -> dict[str, bytes]:
    """Parts by name, back slashes made forward ones."""
    z = zipfile.ZipFile(io.BytesIO(data))
    return {n.replace("\\", "/").lstrip("/"): z.read(n) for n in z.namelist() if n.endswith((".xml", ".rels"))}


def targets(parts: dict[str, bytes], owner: str) -> dict[str, str]:
    """Relation id to part name of one part."""
    folder, _, name = owner.rpartition("/")
    rels = parts.get(f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
    out = {}
    for e in ElementTree.fromstring(rels) if rels else []:
        path = e.attrib.get("Target", "").replace("\\", "/")
        steps = [] if path.startswith("/") else folder.split("/")
        for s in path.strip("/").split("/"):
            steps = steps[:-1] if s == ".." else [*steps, s]
        out[e.attrib.get("Id", "")] = "/".join(x for x in steps if x)
    return out


def core_metadata(parts: dict[str, bytes]) -> str:
    """The metadata block of a package's core properties; empty if there are none."""
    core = parts.get("docProps/core.xml")
    found = {local(e): (e.text or "").strip() for e in ElementTree.fromstring(core)} if core else {}
    names = {"title": "title", "subject": "subject", "creator": "author", "keywords": "keywords", "description": "comments", "lastModifiedBy": "last modified by", "created": "created", "modified": "modified"}
    lines = [f"  {shown_name}: {found[k]}" for k, shown_name in names.items() if found.get(k)]
    return "\n".join(["<Document-Metadata>", *lines, "</Document-Metadata>"]) + "\n\n" if lines else ""


def escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def html_grid(cells: Iterable[tuple[int, int, int, int, str]], head: bool = True) -> str:
    """Cells (row, column, rows, columns, text) as an HTML table, the first row as its header."""
    rows: dict[int, list[tuple[int, str]]] = {}
    for r, c, high, wide, text in cells:
        tag = "th" if head and r == 0 else "td"
        spans = (f" rowspan='{high}'" if high > 1 else "") + (f" colspan='{wide}'" if wide > 1 else "")
        rows.setdefault(r, []).append((c, f"<{tag}{spans}>{escaped(text)}</{tag}>"))
    return "<table border='1'>" + "".join(f"<tr>{''.join(x for _, x in sorted(rows[r]))}</tr>" for r in sorted(rows)) + "</table>"


def chart_block(root) -> str:
    """A chart part as a [chart] block with a table of its series."""
    kind = next((local(e) for e in root.iter() if local(e).endswith("Chart") and local(e) != "chart"), "chart")
    title = next(("".join(t.text or "" for t in below(e, "t")) for e in below(root, "title")), "")
    points = lambda e: [v.text or "" for p in below(e, "pt") for v in below(p, "v")]
    series, labels = [], []
    for i, s in enumerate(below(root, "ser"), 1):
        part = {local(e): e for e in s}
        name = points(part["tx"]) if "tx" in part else []
        values = points(part["val"] if "val" in part else part["yVal"]) if "val" in part or "yVal" in part else []
        labels = labels or (points(part["cat"]) if "cat" in part else [])
        if values:
            series.append((name[0] if name else f"Series {i}", values))
    height = max((len(v) for _, v in series), default=0)
    number = lambda v: f"{float(v):,.2f}" if re.fullmatch(r"-?\d+\.\d+(?:[eE][+-]?\d+)?", v) else v
    cells = [(0, 0, 1, 1, "Category"), *((0, c, 1, 1, n) for c, (n, _) in enumerate(series, 1))]
    for r in range(height):
        cells += [(r + 1, 0, 1, 1, labels[r] if r < len(labels) else f"Item {r + 1}"), *((r + 1, c, 1, 1, number(v[r]) if r < len(v) else "") for c, (_, v) in enumerate(series, 1))]
    lines = [f"Chart Type: {kind}", *([f"Title: {title}"] if title else []), "", html_grid(cells)]
    return "\n".join(["[chart]", *lines, "[/chart]"])


def slide_text(data: bytes) -> str:
    """Slides in order: shapes by top and left, tables, charts and bullets, then their notes."""
    parts = package(data)
    main = "ppt/presentation.xml"
    rels = targets(parts, main)
    ids = [attribute(e, "id") if not e.attrib.get("id", "").startswith("rId") else e.attrib["id"] for e in below(ElementTree.fromstring(parts[main]), "sldId")]
    order = [rels[v] for e in below(ElementTree.fromstring(parts[main]), "sldId") for v in e.attrib.values() if v in rels] if ids else []
    out = []
    for n, name in enumerate(order, 1):
        root, links = ElementTree.fromstring(parts[name]), targets(parts, name)
        shapes = []
        for shape in below(root, "sp", "graphicFrame", "pic"):
            at = next(iter(below(shape, "off")), None)
            place = (int(at.attrib.get("y", 0)), int(at.attrib.get("x", 0))) if at is not None else (0, 0)
            text = ""
            if table := below(shape, "tbl"):
                cells = [(r, c, int(x.attrib.get("rowSpan", 1)), int(x.attrib.get("gridSpan", 1)), _paragraphs(x)) for r, row in enumerate(below(table[0], "tr")) for c, x in enumerate(below(row, "tc")) if "hMerge" not in x.attrib and "vMerge" not in x.attrib]
                tall, wide = len({x[0] for x in cells}), len({x[1] for x in cells})
                text = "\n".join(x[4] for x in cells) if tall == 1 or wide == 1 else html_grid(cells)
            elif charts := [links[v] for e in below(shape, "chart") for v in e.attrib.values() if v in links]:
                text = chart_block(ElementTree.fromstring(parts[charts[0]]))
            elif local(shape) != "pic":
                text = _paragraphs(shape)
            if text.strip():
                shapes.append((*place, len(shapes), text))
        notes = next((p for p in links.values() if "notesSlide" in p and p in parts), None)
        said = _paragraphs(ElementTree.fromstring(parts[notes])).strip() if notes else ""
        out.append("\n".join([f"[Slide Number: {n}]", *([x[3] for x in sorted(shapes)] or ["[Empty Slide]"]), *([f"[Slide Notes]\n{said}"] if said else [])]))
    return core_metadata(parts) + "\n\n".join(out)


def _paragraphs(e) -> str:
    """Paragraphs by line, two spaces for each level; numbered ones count within their level."""
    out, counts = [], {}
    for p in below(e, "p"):
        text = "".join((x.text or "") if local(x) == "t" else "\n" for x in below(p, "t", "br"))
        if not text.strip():
            continue
        level = next((int(x.attrib.get("lvl", 0)) for x in below(p, "pPr")), 0)
        counts = {k: v for k, v in counts.items() if k <= level}
        mark = ""
        if below(p, "buAutoNum"):
            counts[level] = counts.get(level, 0) + 1
            mark = f"{counts[level]}. "
        elif glyph := below(p, "buChar"):
            mark = f"{glyph[0].attrib.get('char', '•')} "
        else:
            counts.pop(level, None)
        out.append("  " * level + mark + text)
    return "\n".join(out)


def hancom_text(data: bytes) -> str:
    """Sections of a .hwpx package in order: headers, paragraphs and tables, footers."""
    parts = package(data)
    names = sorted((n for n in parts if re.fullmatch(r"Contents/section\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    if not names:
        raise KeyError("Contents/section0.xml")
    out = []
    for name in names:
        sides: dict[str, list[str]] = {"header": [], "body": [], "footer": []}

        def walk(e, to: list[str], sides=sides) -> None:
            words = []
            for x in e:
                kind = local(x)
                if kind == "t":
                    words.append("".join(x.itertext()))
                elif kind == "tbl":
                    words.append("\n" + _hancom_table(x) + "\n")
                elif kind in ("header", "footer"):
                    found = "".join("".join(t.itertext()) for t in below(x, "t"))
                    sides[kind].append(f"[{kind.title()}] {found}")
                elif kind in ("footNote", "endNote"):
                    words.append(f"[{'Footnote' if kind == 'footNote' else 'Endnote'}] " + "".join("".join(t.itertext()) for t in below(x, "t")))
                else:
                    inner: list[str] = []
                    walk(x, inner)
                    words += inner
            if words:
                to.append("".join(words))

        for p in ElementTree.fromstring(parts[name]):
            walk(p, sides["body"])
        out += [*sides["header"], *(x.strip("\n") for x in sides["body"]), *sides["footer"]]
    return "\n".join(x for x in out if x.strip())


def _hancom_table(e) -> str:
    cells = []
    for tc in below(e, "tc"):
        at, span = next(iter(below(tc, "cellAddr"))), next(iter(below(tc, "cellSpan")), None)
        high, wide = (int(span.attrib.get("rowSpan", 1)), int(span.attrib.get("colSpan", 1))) if span is not None else (1, 1)
        cells.append((int(at.attrib["rowAddr"]), int(at.attrib["colAddr"]), high, wide, " ".join("".join(t.itertext()) for t in below(tc, "t"))))
    return cells[0][4] if len(cells) == 1 else html_grid(cells)


#: Destinations of rich text that hold no body text.
SILENT = "fonttbl colortbl stylesheet info pict object themedata colorschememapping latentstyles datastore listtable listoverridetable rsidtbl generator xmlnstbl fldinst filetbl revtbl header footer headerl headerr footerl footerr nonshppict shppict".split()


def rich_text(data: bytes) -> str:
    """Body of a .rtf file: paragraphs, and rows of cells as HTML tables."""
    raw = data.decode("latin-1")
    if not raw.lstrip().startswith("{\\rtf"):
        raise ValueError("no rich text")
    page = re.search(r"\\ansicpg(\d+)", raw)
    coding = {"949": "cp949", "932": "cp932", "936": "gbk", "65001": "utf-8"}.get(page[1], f"cp{page[1]}") if page else "cp1252"
    out: list[str] = []
    rows: list[list[str]] = []
    cells: list[str] = []
    words: list[str] = []
    held = bytearray()
    stack: list[tuple[bool, int]] = []
    silent, skip, left = False, 1, 0
    table = False

    def flush() -> None:
        if held:
            words.append(held.decode(coding, "replace"))
            held.clear()

    def close() -> None:
        if rows:
            out.append(html_grid([(r, c, 1, 1, t.strip()) for r, row in enumerate(rows) for c, t in enumerate(row)]))
            rows.clear()

    for m in re.finditer(r"\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n])", raw):
        if m[5] == "{":
            stack.append((silent, skip))
        elif m[5] == "}":
            flush()
            silent, skip = stack.pop() if stack else (silent, skip)
        elif m[4] == "*" or m[2] in SILENT:
            silent = True
        elif silent:
            continue
        elif m[1] or m[6]:
            if left:
                left -= 1
            elif m[1]:
                held.append(int(m[1], 16))
            else:
                flush()
                words.append(m[6])
        elif m[2] == "u":
            flush()
            words.append(chr(int(m[3]) % 65536))
            left = skip
        elif m[2] == "uc":
            skip = int(m[3] or 1)
        elif m[2] in ("tab", "line", "emdash", "endash", "bullet"):
            flush()
            words.append({"tab": "\t", "line": "\n", "emdash": "—", "endash": "–", "bullet": "•"}[m[2]])
        elif m[2] == "trowd":
            table = True
        elif m[2] == "cell":
            flush()
            cells.append("".join(words))
            words = []
        elif m[2] == "row":
            rows.append(cells)
            cells, table = [], False
        elif m[2] in ("par", "page", "sect"):
            flush()
            if table:
                words.append("\n")
                continue
            if "".join(words).strip():
                close()
                out.append("".join(words))
            words = []
        elif m[4] and m[4] in "\\{}~_-":
            flush()
            words.append({"~": " ", "_": "-", "-": ""}.get(m[4], m[4]))
    flush()
    close()
    if "".join(words).strip():
        out.append("".join(words))
    return "[Page Number: 1]\n" + "\n".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def blocks(grid: dict[Cell, str]) -> list[tuple[int, int, int, int]]:
    """Boxes (r1, c1, r2, c2) of touching cells, by top and left; those that overlap are one, and so are neighbours of equal rows with one
    empty column between, or of like columns with one empty row between."""
    left, boxes = set(grid), []
    while left:
        todo, seen = [left.pop()], []
        while todo:
            r, c = todo.pop()
            seen.append((r, c))
            for near in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if near in left:
                    left.discard(near)
                    todo.append(near)
        boxes.append((min(r for r, _ in seen), min(c for _, c in seen), max(r for r, _ in seen), max(c for _, c in seen)))

    def together(a, b) -> bool:
        if a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]:
            return True
        beside = (a[0], a[2]) == (b[0], b[2]) and (b[1] - a[3] == 2 or a[1] - b[3] == 2)
        return beside or (b[0] - a[2] == 2 and a[1] <= b[1] and b[3] <= a[3] and a[2] > a[0] and a[3] > a[1] and b[3] - b[1] == a[3] - a[1])

    if len(boxes) > 2000:
        return sorted(boxes)
    boxes.sort()
    i = 0
    while i < len(boxes):
        j = next((j for j in range(len(boxes)) if j != i and (together(boxes[i], boxes[j]) or together(boxes[j], boxes[i]))), None)
        if j is None:
            i += 1
            continue
        a, b = boxes[i], boxes[j]
        joined = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
        boxes = sorted([*(x for k, x in enumerate(boxes) if k not in (i, j)), joined])
        i = 0
    return boxes


def render(grid: dict[Cell, str], merges: list[tuple[int, int, int, int]]) -> str:
    """Blocks of a sheet: single rows or columns as text, two columns apart as `label: value`, others as Markdown tables whose captions are numbered."""
    full, down, wide = dict(grid), dict(grid), {}
    for r1, c1, r2, c2 in merges:
        if (text := grid.get((r1, c1))) and (r2 - r1 + 1) * (c2 - c1 + 1) <= 200_000:
            for r in range(r1, r2 + 1):
                down.setdefault((r, c1), text)
                for c in range(c1, c2 + 1):
                    full.setdefault((r, c), text)
            wide[r1, c1] = c2
    found = blocks(full)
    tables = sum(b[0] < b[2] and b[1] < b[3] for b in found)
    out, number = [], 0
    clean = lambda t: " ".join(t.split()).replace("|", "\\|")
    for r1, c1, r2, c2 in found:
        lines_of = lambda cells: [[cells.get((r, c), "") for c in range(c1, c2 + 1)] for r in range(r1, r2 + 1) if any((r, c) in full for c in range(c1, c2 + 1))]  # noqa: B023, E731
        rows, body = lines_of(full), lines_of(down)
        captions = []
        while len(captions) < 2 and len(rows) > 1 and len(set(x for x in rows[0] if x)) == 1 and (c1 == c2 or (r1 + len(captions), c1) in wide or rows[0].count("") == len(rows[0]) - 1) and c1 < c2:
            captions.append(next(x for x in rows.pop(0) if x))
        body = body[len(captions) :]
        used = [i for i in range(c2 - c1 + 1) if any(r[i] for r in body)]
        if len(rows) == 1 or len(used) == 1:
            out.append("\n".join([*captions, *(" · ".join(clean(x) for x in r if x) for r in body)]))
            continue
        if len(used) == 2 and used[1] - used[0] >= 2:
            out.append("\n".join([*captions, *(": ".join(clean(r[i]) for i in used if r[i]) for r in body)]))
            continue
        deep = 1
        head_rows = max((m[2] - r1 - len(captions) + 1 for m in merges if m[0] == r1 + len(captions) and c1 <= m[1] <= c2), default=1)
        across = any(m[0] == r1 + len(captions) and m[3] > m[1] and c1 <= m[1] <= c2 for m in merges)
        deep = max(1, min(4, len(rows) - 1, max(head_rows, 2 if across else 1)))
        head = [" ".join(dict.fromkeys(clean(r[i]) for r in rows[:deep] if r[i])) for i in used]
        number += 1
        if captions or tables > 1:
            captions = [f"[Table {number}] {' · '.join(captions)}".rstrip()]
        lines = [f"| {' | '.join(h or _letter(i) for i, h in enumerate(head, c1))} |", "|" + " --- |" * len(used)]
        lines += [f"| {' | '.join(clean(r[i]) for i in used)} |" for r in body[deep:]]
        out.append("\n".join([*captions, *lines]))
    return "\n\n".join(x for x in out if x)


def _letter(n: int) -> str:
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _place(ref: str) -> Cell:
    c = 0
    for ch in ref.rstrip("0123456789"):
        c = 26 * c + ord(ch) - 64
    return int(ref[len(ref.rstrip("0123456789")) :] or 0), c


def workbook_text(data: bytes, hidden: bool = True) -> str:
    """Sheets in order, values as displayed; a formula without a stored value stays as `=...`; hidden sheets, rows and columns can be left out."""
    parts = package(data)
    book = ElementTree.fromstring(parts["xl/workbook.xml"])
    rels = targets(parts, "xl/workbook.xml")
    strings = [_string(s) for s in ElementTree.fromstring(parts["xl/sharedStrings.xml"]) if local(s) == "si"] if "xl/sharedStrings.xml" in parts else []
    old = any(e.attrib.get("date1904") in ("1", "true") for e in below(book, "workbookPr"))
    codes: list[str | None] = []
    if "xl/styles.xml" in parts:
        styles = ElementTree.fromstring(parts["xl/styles.xml"])
        own = {int(e.attrib["numFmtId"]): e.attrib.get("formatCode") for e in below(styles, "numFmt")}
        codes = [own.get(n, BUILT_IN.get(n)) for x in below(styles, "cellXfs") for e in x if local(e) == "xf" for n in [int(e.attrib.get("numFmtId", 0))]]
    out = []
    for i, e in enumerate(below(book, "sheet"), 1):
        name = next((rels[v] for v in e.attrib.values() if v in rels), f"xl/worksheets/sheet{i}.xml")
        if name not in parts or not hidden and e.attrib.get("state", "visible") != "visible":
            continue
        root = ElementTree.fromstring(parts[name])
        gone = set() if hidden else {c for x in below(root, "col") if x.attrib.get("hidden") in ("1", "true") for c in range(int(x.attrib["min"]), int(x.attrib["max"]) + 1)}
        grid: dict[Cell, str] = {}
        r = 0
        for row in below(root, "row"):
            r, c = int(row.attrib.get("r", r + 1)), 0
            for x in row:
                c = _place(x.attrib["r"])[1] if "r" in x.attrib else c + 1
                text = _value(x, strings, codes, old)
                if text.strip() and c not in gone and (hidden or row.attrib.get("hidden") not in ("1", "true")):
                    grid[r, c] = text
        merges = [(*_place(a), *_place(b)) for m in below(root, "mergeCell") for a, _, b in [m.attrib["ref"].partition(":")] if b]
        charts = [chart_block(ElementTree.fromstring(parts[p])) for d in targets(parts, name).values() for p in targets(parts, d).values() if "/charts/chart" in p and p in parts]
        out.append("\n".join([f"[Sheet: {e.attrib.get('name', '')}]", render(grid, merges), *charts]))
    return core_metadata(parts) + "\n\n".join(out)


def _string(e) -> str:
    return "".join(t.text or "" for x in e for t in ([x] if local(x) == "t" else below(x, "t") if local(x) == "r" else []))


def _value(x, strings: list[str], codes: list[str | None], old: bool) -> str:
    kind, part = x.attrib.get("t", "n"), {local(e): e for e in x}
    raw = part["v"].text or "" if "v" in part else ""
    if kind == "inlineStr":
        return _string(part["is"]) if "is" in part else ""
    if not raw:
        return f"={part['f'].text}" if "f" in part and part["f"].text else ""
    if kind == "s":
        return strings[int(raw)]
    if kind == "b":
        return "TRUE" if raw == "1" else "FALSE"
    if kind != "n":
        return raw
    style = int(x.attrib.get("s", 0))
    try:
        return shown(float(raw), codes[style] if style < len(codes) else None, old)
    except ValueError:
        return raw


class _Tables(HTMLParser):
    """Tables of an HTML page as rows of (text, rows, columns)."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[list]]] = []
        self.inside = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            span = {k: min(1000, int(v)) for k, v in attrs if k in ("rowspan", "colspan") and (v or "").isdigit()}
            self.tables[-1][-1].append(["", span.get("rowspan", 1), span.get("colspan", 1)])
            self.inside = True
        elif tag == "br" and self.inside:
            self.handle_data("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th"):
            self.inside = False

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.tables[-1][-1][-1][0] += data


def html_workbook(text: str, name: str) -> str:
    """An HTML page that is saved as a workbook: one sheet, a table of one row joined to the one after it."""
    found = _Tables()
    found.feed(text)
    tables = [[r for r in t if r] for t in found.tables]
    tables = [t for t in tables if t]
    out = []
    while tables:
        rows = tables.pop(0)
        if len(rows) == 1 and tables and sum(c[2] for c in rows[0]) == sum(c[2] for c in tables[0][0]):
            rows = rows + tables.pop(0)
        grid: dict[Cell, str] = {}
        merges, taken = [], set()
        for r, row in enumerate(rows, 1):
            c = 1
            for words, high, wide in row:
                while (r, c) in taken:
                    c += 1
                taken |= {(y, x) for y in range(r, r + high) for x in range(c, c + wide)}
                if words.strip():
                    grid[r, c] = words.strip()
                if high * wide > 1:
                    merges.append((r, c, r + high - 1, c + wide - 1))
                c += wide
        out.append(render(grid, merges))
    return f"[Sheet: {name}]\n" + "\n\n".join(out)


__all__ = ["chart_block", "hancom_text", "html_workbook", "is_date", "rich_text", "slide_text", "workbook_text"]
