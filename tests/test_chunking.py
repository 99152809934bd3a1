import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.operators import chunking as C
from docweave.plans.extract import extract_chunks
from docweave.sources.readers import decoded, delimited, read_documents
from docweave.sources.sinks import save_markdown
from docweave.streaming.ingest import ingest


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(1, 40), st.integers(0, 39))
def test_spans_hold_everything(text, size, overlap):
    overlap %= size
    found = C.spans(text, size, overlap)
    assert all(0 < b - a <= size for a, b in found)
    covered = {i for a, b in found for i in range(a, b)}
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)


def test_regions_stay_whole():
    tables = "<table><tr><td>" + "x" * 80 + "</td></tr></table>"
    text = "words " * 30 + tables + " tail " * 20 + "[Image: a.png] end"
    parts = [text[a:b] for a, b in C.protected_spans(text, 60, 10)]
    assert any(tables in p for p in parts) and any("[Image: a.png]" in p for p in parts)


def test_nested_tables_are_one_region():
    inner = "<table><tr><td>inner</td></tr></table>"
    text = f"a <table><tr><td>{inner}</td><td>after</td></tr></table> b <TABLE>never closed </table> c <table> open"
    assert [text[a:b] for a, b in C.regions(text)] == [f"<table><tr><td>{inner}</td><td>after</td></tr></table>", "<TABLE>never closed </table>"]


def test_rows_positions_and_pages():
    text = "[Page Number: 1]\n" + "one two\n" * 20 + "[Page Number: 2]\n" + "three\n" * 30
    for i, part, page, first, last, a, b in C.chunk_rows(text, 100, 10):
        assert part == text[a : b + 1] and first == text.count("\n", 0, a) + 1 and last == text.count("\n", 0, b + 1) + 1
        assert page == (2 if a >= text.index("[Page Number: 2]") else 1)
    assert C.chunk_rows(None, 100, 10) == C.chunk_rows(" \n", 100, 10) == [(0, "", 1, 1, 1, 0, 0)]
    with pytest.raises(ValueError):
        C.check(10, 10)


def test_delimited_and_decoding():
    assert delimited("a;b\n1;x|y\n\n;\n", "csv").split("\n") == ["| a | b |", "| --- | --- |", "| 1 | x\\|y |"]
    assert delimited("a\t\n1\t2", "tsv").split("\n")[0] == "| a | B |"
    assert decoded("한글".encode("cp949")) == ("한글", "cp949") and decoded(b"\xef\xbb\xbfx") == ("x", "utf-8-sig")
    assert decoded("é".encode("utf-16-le").join([b"\xff\xfe", b""]))[1] == "utf-16-le"


def docx(*paragraphs):
    out = io.BytesIO()
    body = "".join(f"<w:p><w:r>{'<w:br w:type=\"page\"/>' if p == 'next' else ''}<w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def xlsx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="A"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>n</v></c></row><row><c r="A2"><v>1</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_files_to_chunks(spark, tmp_path):
    for name, data in {"a.txt": b"x\n\n\n\ny", "b.csv": b"p,q\n1,2", "c.docx": docx("one", "next", "two"), "d.xlsx": xlsx(), "e.pdf": b"%PDF", "f.docx": b"no zip", "g.py": b"a\tb  "}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].text == "x\n\ny" and rows["g.py"].text == "a    b"
    assert "[Page Number: 2]" in rows["c.docx"].text and rows["d.xlsx"].text.startswith("[Sheet: A]\n| name | B | n |")
    assert rows["e.pdf"].error and rows["f.docx"].error and rows["e.pdf"].text is None
    found = extract_chunks(spark, str(tmp_path))
    assert found.select("path").distinct().count() == 5
    save_markdown(found, str(tmp_path / "out"), "path")
    assert spark.read.text(str(tmp_path / "out")).count() > 5


def test_streaming_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * 300 * i) for i in range(4)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    ingest(spark, str(tmp_path / "in"), "doc_id long, text string", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, C.chunk_documents(docs).collect()))
