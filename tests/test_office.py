import io
import zipfile

from docweave.plans.extract import extract_table_chunks, extract_text
from docweave.sources import office as O


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def workbook(*sheets, styles="", hidden=()):
    names = "".join(f'<sheet name="S{i}" state="{"hidden" if i in hidden else "visible"}"/>' for i in range(1, len(sheets) + 1))
    return packed(**{"xl/workbook.xml": f"<workbook><sheets>{names}</sheets></workbook>", "xl/styles.xml": f"<styleSheet>{styles}</styleSheet>", **{f"xl/worksheets/sheet{i}.xml": s for i, s in enumerate(sheets, 1)}})


def sheet(rows, merges=(), hidden_rows=()):
    cell = lambda v, s: f'<c t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) and not v.startswith("=") else f"<c><f>{v[1:]}</f></c>" if isinstance(v, str) else f'<c s="{s}"><v>{v}</v></c>' if v is not None else "<c/>"
    body = "".join(f'<row r="{i}"{" hidden=\"1\"" if i in hidden_rows else ""}>' + "".join(cell(*(v if isinstance(v, tuple) else (v, 0))) for v in r) + "</row>" for i, r in enumerate(rows, 1))
    return f"<worksheet><sheetData>{body}</sheetData><mergeCells>{''.join(f'<mergeCell ref=\"{m}\"/>' for m in merges)}</mergeCells></worksheet>"


STYLES = '<numFmts><numFmt numFmtId="170" formatCode="#,##0&quot;won&quot;"/></numFmts><cellXfs><xf/><xf numFmtId="170"/><xf numFmtId="10"/></cellXfs>'


def test_values_as_displayed():
    text = O.workbook_text(workbook(sheet([["item", "value"], ["a", (1234567, 1)], ["b", (0.153, 2)], ["c", "=B2*C2"]]), styles=STYLES))
    assert text.startswith("[Sheet: S1]\n| item | value |") and "| a | 1,234,567won |" in text and "| b | 15.30% |" in text and "| c | =B2*C2 |" in text


def test_merged_header_gap_groups_form_and_captions():
    rows = [["place", "who", "Jan", None, "Feb", None], [None, None, "goal", "done", "goal", "done"]] + [[f"p{i}", "x", 1, 2, 3, 4] for i in range(3)]
    text = O.workbook_text(workbook(sheet(rows, ("A1:A2", "B1:B2", "C1:D1", "E1:F1"))))
    assert "| place | who | Jan goal | Jan done | Feb goal | Feb done |" in text and "| p2 | x | 1 | 2 | 3 | 4 |" in text
    gap = O.workbook_text(workbook(sheet([["a", "b", None, "c", "d"]] + [["1", "2", None, "3", "4"]] * 3)))
    assert gap.count("\n| --- ") == 1 and "| a | b | c | d |" in gap
    groups = O.workbook_text(workbook(sheet([["dept", "name", "rank"], ["s", "n", "r"], ["s", "m", "r"], [], ["t", "n", "r"], ["t", "m", "r"]])))
    assert groups.count("dept") == 1 and groups.count("\n| --- ") == 1
    form = O.workbook_text(workbook(sheet([["Request", None, None], ["who", None, "Kim"], ["when", None, "today"]], ("A1:C1", "A2:B2", "A3:B3"))))
    assert "Request" in form and "Kim" in form
    two = O.workbook_text(workbook(sheet([["Sales", None, None], ["a", "b", "c"], ["1", "2", "3"], [], [], ["Costs", None, None], ["d", "e", "f"], ["1", "2", "3"]], ("A1:C1", "A6:C6"))))
    assert "[Table 1] Sales\n| a | b | c |" in two and "[Table 2] Costs\n| d | e | f |" in two


def test_hidden():
    book = workbook(sheet([["a", "b"], ["1", "2"], ["secret", "x"]], hidden_rows=(3,)), sheet([["z"]]), hidden=(2,))
    assert "secret" in O.workbook_text(book) and "[Sheet: S2]" in O.workbook_text(book)
    assert "secret" not in O.workbook_text(book, hidden=False) and "S2" not in O.workbook_text(book, hidden=False)


def test_html_workbook():
    page = "<html><table><tr><th rowspan=2>k</th><th colspan=2>v</th></tr><tr><th>x</th><th>y</th></tr><tr><td>1</td><td>2</td><td>3</td></tr></table></html>"
    assert O.html_workbook(page, "f").startswith("[Sheet: f]\n| k | v x | v y |\n| --- | --- | --- |\n| 1 | 2 | 3 |")
    joined = O.html_workbook("<table><tr><td>a</td><td>b</td></tr></table><table><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>", "f")
    assert joined.count("\n| --- ") == 1 and "| 3 | 4 |" in joined


CHART = '<c:chartSpace xmlns:c="c" xmlns:a="a"><c:chart><c:title><a:t>Sales</a:t></c:title><c:plotArea><c:barChart><c:ser><c:tx><c:strRef><c:pt idx="0"><c:v>A</c:v></c:pt></c:strRef></c:tx><c:cat><c:pt idx="0"><c:v>Q1</c:v></c:pt></c:cat><c:val><c:pt idx="0"><c:v>1234.5</c:v></c:pt></c:val></c:ser></c:barChart></c:plotArea></c:chart></c:chartSpace>'


def slides():
    shape = lambda y, t, more="": f'<p:sp><a:off x="0" y="{y}"/><a:p><a:pPr lvl="0">{more}</a:pPr><a:t>{t}</a:t></a:p></p:sp>'
    frame = '<p:graphicFrame><a:off x="0" y="9"/><c:chart r:id="rId7"/></p:graphicFrame>'
    one = f'<p:sld xmlns:p="p" xmlns:a="a" xmlns:c="c" xmlns:r="r">{shape(5, "second", "<a:buAutoNum/>")}{shape(1, "first")}{frame}</p:sld>'
    rel = lambda *x: "<R>" + "".join(f'<r Id="{i}" Target="{t}"/>' for i, t in x) + "</R>"
    return packed(**{"ppt/presentation.xml": '<p xmlns:r="r"><sldId id="256" r:id="rId2"/><sldId id="257" r:id="rId1"/></p>', "ppt/_rels/presentation.xml.rels": rel(("rId1", "slides/slide1.xml"), ("rId2", "slides/slide2.xml")), "ppt/slides/slide1.xml": "<sld/>", "ppt/slides/slide2.xml": one, "ppt/slides/_rels/slide2.xml.rels": rel(("rId7", "../charts/chart1.xml")), "ppt/charts/chart1.xml": CHART, "docProps/core.xml": "<core><title>Deck</title></core>"})


def test_slides():
    text = O.slide_text(slides())
    assert text.startswith("<Document-Metadata>\n  title: Deck\n</Document-Metadata>")
    assert "[Slide Number: 1]\nfirst\n1. second\n[chart]\nChart Type: barChart\nTitle: Sales" in text and "1,234.50" in text and text.endswith("[Slide Number: 2]\n[Empty Slide]")


RTF = rb"{\rtf1\ansi\ansicpg949{\fonttbl{\f0 Arial;}}\pard one\tab two {\b bold}\par \u-21364?\'b0\'a1\par\trowd a\cell b\cell\row\trowd 1\cell 2\cell\row\pard end\par}"


def test_rich_text():
    text = O.rich_text(RTF)
    assert text.startswith("[Page Number: 1]\none\ttwo bold\n") and "가" in text and "Arial" not in text
    assert "<tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr>" in text and text.endswith("end")


def hwpx():
    cell = lambda r, c, t, s=1: f'<tc><cellAddr rowAddr="{r}" colAddr="{c}"/><cellSpan rowSpan="1" colSpan="{s}"/><p><run><t>{t}</t></run></p></tc>'
    return packed(**{"Contents/section0.xml": f"<sec><p><run><t>hello</t></run></p><p><run><tbl><tr>{cell(0, 0, 'h', 2)}</tr><tr>{cell(1, 0, 'a')}{cell(1, 1, 'b')}</tr></tbl></run></p></sec>", "Contents/section10.xml": "<sec><p><run><t>last</t></run></p></sec>", "Contents/section2.xml": "<sec><p><run><t>mid</t></run></p></sec>"})


def test_hancom():
    text = O.hancom_text(hwpx())
    assert text.split("\n")[0] == "hello" and "<th colspan='2'>h</th>" in text and text.endswith("mid\nlast")


def test_files_end_to_end(spark, tmp_path):
    big = workbook(sheet([["k", "v", "w"]] + [[f"k{i}", f"v{i}", "x" * 20] for i in range(100)]))
    data = {"a.xlsx": big, "b.pptx": slides(), "c.rtf": RTF, "d.hwpx": hwpx(), "e.png": b"\x89PNG\r\n\x1a\n..", "f.png": b"text", "g.xls": b"<html><table><tr><td>1</td></tr></table>", "h.hwp": b"\xd0\xcf", "i.rtf": b"plain", "j.pptx": b"PK", "k.xlsx": b"", "l.xlsx": b"\0"}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in extract_text(spark, str(tmp_path)).collect()}
    assert {n for n, r in rows.items() if r.error} == {"f.png", "h.hwp", "i.rtf", "j.pptx", "l.xlsx"}
    assert set(rows) == set(data) - {"k.xlsx"}
    assert rows["e.png"].text.startswith("[Image: ")
    chunks = extract_table_chunks(spark, str(tmp_path), size=500, overlap=50).where("path like '%a.xlsx'").collect()
    assert len(chunks) > 5 and all("| k | v | w |" in c.text and len(c.text) <= 500 for c in chunks)
