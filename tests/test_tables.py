"""Properties of chunked tables over generated ones: nothing is lost or doubled, headers repeat, sizes hold."""

import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.operators import tables as B

cell = st.text(alphabet="abkz 09.", min_size=1, max_size=14).map(str.strip).filter(bool)
grid = st.integers(1, 5).flatmap(lambda w: st.lists(st.lists(cell, min_size=w, max_size=w), min_size=1, max_size=40))


def as_markdown(rows):
    bars = lambda r: f"| {' | '.join(r)} |"
    return "\n".join([bars([f"h{i}" for i in range(len(rows[0]))]), "|" + " --- |" * len(rows[0]), *map(bars, rows)])


@settings(max_examples=120, deadline=None)
@given(grid, st.integers(120, 700), st.sampled_from(["", "[Sheet: q]"]))
def test_markdown_keeps_rows_and_headers(rows, size, context):
    table = as_markdown(rows)
    head, body = table.split("\n")[:2], table.split("\n")[2:]
    found = []
    for chunk in B.markdown_chunks(table, size, context):
        lines = chunk.split("\n")
        if context:
            assert lines.pop(0) == context
        assert lines[:2] == head
        found += lines[2:]
        assert len(chunk) <= max(size, len(context) + 1 + sum(map(len, head)) + 2 + max(100, max(map(len, body))))
    assert found == body


@settings(max_examples=80, deadline=None)
@given(st.lists(cell, min_size=2, max_size=4), st.integers(300, 2000), st.integers(210, 400))
def test_a_cut_row_repeats_its_short_cells(cells, n, budget):
    long = " ".join(f"w{i}" for i in range(n))
    pieces = B.row_pieces("| " + " | ".join([*cells, long]) + " |", budget)
    assert len(pieces) > 1
    for p in pieces:
        assert [x.strip() for x in p.strip("|").split("|")][:-1] == cells
    assert " ".join(p.strip("|").split("|")[-1].strip() for p in pieces) == long


@settings(max_examples=80, deadline=None)
@given(grid, st.integers(200, 900), st.booleans())
def test_html_keeps_cells_in_order(rows, size, force):
    row = lambda name, cells: "<tr>" + "".join(f"<{name}>{c}</{name}>" for c in cells) + "</tr>"
    head = row("th", ["x"] * len(rows[0]))
    table = f"<table class='t'>{head}{''.join(row('td', r) for r in rows)}</table>"
    chunks = B.html_chunks(table, size, force=force)
    assert all(head in c and c.endswith("</table>") for c in chunks)
    assert [re.findall(r"<td>(.*?)</td>", c) for c in chunks if c] and [x for c in chunks for x in re.findall(r"<td>(.*?)</td>", c)] == [x for r in rows for x in r]
    labels = [re.search(r"\[Table Chunk (\d+)/(\d+)\]", c) for c in chunks]
    assert len(chunks) == 1 or [(int(m[1]), int(m[2])) for m in labels] == [(i, len(chunks)) for i in range(1, len(chunks) + 1)]


def expanded(table):
    """Each row's cells with the ones that reach down from above."""
    held, out = {}, []
    for r in re.findall(r"<tr>(.*?)</tr>", table):
        cells, c = [], 0
        mine = iter(re.findall(r"<td(?: rowspan='(\d+)')?>(.*?)</td>", r))
        while True:
            if held.get(c, (0,))[0]:
                held[c] = (held[c][0] - 1, held[c][1])
            elif (x := next(mine, None)) is not None:
                held[c] = (int(x[0] or 1) - 1, x[1])
            else:
                break
            cells.append(held[c][1])
            c += 1
        out.append(cells)
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=6), st.integers(260, 600), st.booleans())
def test_spans_reach_every_row_of_their_chunk(groups, size, force):
    rows, want = "", []
    for g, n in enumerate(groups):
        for i in range(n):
            span = f"<td rowspan='{n}'>group{g}</td>" if n > 1 and not i else "<td>group%d</td>" % g if n == 1 else ""
            rows += f"<tr>{span}<td>item {g}.{i}</td></tr>"
            want.append([f"group{g}", f"item {g}.{i}"])
    chunks = B.html_chunks(f"<table>{rows}</table>", size, force=force)
    assert [r for c in chunks for r in expanded(c)] == want
    if not force:
        assert all(sum(f"item {g}.0<" in c for c in chunks) == 1 for g in range(len(groups)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["north", "south", "west"]), st.integers(1, 40)), min_size=1, max_size=5))
def test_workbook_chunks_stand_under_their_sheet(sheets):
    meta = "<Document-Metadata>\n  title: t\n</Document-Metadata>"
    text = meta + "".join(f"\n\n[Sheet: {name}]\n" + as_markdown([[f"s{k}r{i}", str(i)] for i in range(n)]) for k, (name, n) in enumerate(sheets))
    found, order = [], list(dict.fromkeys(name for name, _ in sheets))
    for _, chunk, number in B.document_chunks(text, "xlsx", 400, 0):
        name = re.search(r"\[Sheet: (\w+)\]", chunk)[1]
        assert chunk.startswith(f"{meta}\n[Sheet: {name}]\n") and number == order.index(name) + 1
        found += re.findall(r"s\d+r\d+", chunk)
    assert found == [f"s{k}r{i}" for k, (_, n) in enumerate(sheets) for i in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=9), st.integers(150, 400))
def test_pages_stay_whole_where_they_fit(words, size):
    pages = [" ".join(f"p{n}w{i}" for i in range(w)) for n, w in enumerate(words, 1)]
    text = "\n".join(f"[Page Number: {n}]\n{p}" for n, p in enumerate(pages, 1))
    chunks = B.document_chunks(text, "pdf", size, 0)
    assert {w for _, t, _ in chunks for w in re.findall(r"p\d+w\d+", t)} == {w for p in pages for w in p.split()}
    assert all(len(t) <= 2.25 * size for _, t, _ in chunks)
    for _, t, first in chunks:
        if m := re.match(r"\[Page Number: (\d+)\]", t):
            assert first == int(m[1])
    for n, p in enumerate(pages, 1):
        if len(p) <= size // 2:
            assert any(p in t for _, t, _ in chunks), n


@pytest.mark.parametrize("text", [None, "", "\t\n "])
def test_texts_without_words_are_one_empty_chunk(text):
    assert B.document_chunks(text, "xlsx", 90, 9) == [(0, "", 1)]


def test_frame_keeps_other_columns(spark):
    text = "[Sheet: one]\n" + as_markdown([[html.escape(f"k{i}"), "v"] for i in range(150)])
    docs = spark.createDataFrame([(4, "XLSX", text, "a"), (5, None, None, "b")], "doc_id long, kind string, text string, chunk_index string")
    rows = B.chunk_by_kind(docs, F.col("kind"), size=300, overlap=0).collect()
    mine = [r for r in rows if r.doc_id == 4]
    assert [r.chunk_index for r in mine] == list(range(len(mine))) and len(mine) > 3 and [(r.text, r.page_number) for r in rows if r.doc_id == 5] == [("", 1)]
    assert B.chunk_by_kind(docs.where("false"), F.col("kind")).count() == 0
