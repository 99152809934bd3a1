"""Chunks, tables and tags follow the prefixes and suffixes of a Tags object as they do the usual ones."""

from pyspark.sql import functions as F

from docweave.functions.marks import Tags
from docweave.operators import chunking as C
from docweave.operators import tables as B
from docweave.operators import tags as M

OWN = Tags(page=("<<p ", ">>"), slide=("{slide ", "}"), sheet=("(tab ", ")"), image=("<img:", ">"), chart=("<chart>", "</chart>"))


def own(text):
    """A text with the usual tags turned into one with OWN's."""
    if text is None:
        return None
    for kind in ("page", "slide", "sheet", "image"):
        (a, b), (x, y) = getattr(Tags(), kind), getattr(OWN, kind)
        at = 0
        while (at := text.find(a, at)) >= 0:
            end = text.index(b, at)
            text = text[:at] + x + text[at + len(a) : end] + y + text[end + len(b) :]
    return text.replace("[chart]", "<chart>").replace("[/chart]", "</chart>")


def texts():
    pages = "".join(f"[Page Number: {n}]\nText of page {n}. " + "word " * (n * 17 % 60) + "[Image:pic.png] [chart]a b c d e f g[/chart]\n" for n in range(1, 9))
    sheets = "".join(f"[Sheet: tab {n}]\n| a | b |\n| --- | --- |\n" + "".join(f"| {i} | x |\n" for i in range(40)) + "\n" for n in range(3))
    return [(1, "pdf", pages), (2, "xlsx", sheets), (3, "pptx", pages.replace("Page", "Slide")), (4, "pdf", "[Page Number: 99999999999]\nfar away " * 60), (5, "txt", None), (6, "txt", "plain words " * 90)]


def test_chunks_by_own_tags(spark):
    usual = spark.createDataFrame(texts(), "doc_id int, ext string, text string")
    mine = spark.createDataFrame([(i, e, own(t)) for i, e, t in texts()], usual.schema)
    shape = lambda df: sorted((r.doc_id, r.chunk_index, r.page_number, own(r.text)) for r in df.collect())
    sized = {i: len(own(t)) - len(t) for i, _, t in texts() if t}
    assert all(n < 0 for i, n in sized.items() if i < 4)
    for got in (C.chunk_documents(mine, size=200, overlap=20, tags=OWN).drop("ext"), B.chunk_by_kind(mine, F.col("ext"), size=200, overlap=20, tags=OWN)):
        rows = got.collect()
        pages = {(r.doc_id, r.page_number) for r in rows if r.doc_id in (1, 3)}
        assert pages == {(d, p) for d in (1, 3) for p in range(1, 9)}
        assert {r.page_number for r in rows if r.doc_id == 4} == {0}
        assert not any("<chart>" in r.text and "</chart>" not in r.text or r.text.count("<img:") != r.text.count("png>") for r in rows)
    sheets = [r for r in B.chunk_by_kind(mine, F.col("ext"), size=200, overlap=20, tags=OWN).collect() if r.doc_id == 2]
    assert all(r.text.startswith(f"(tab tab {r.page_number - 1})") and "| a | b |" in r.text for r in sheets) and {r.page_number for r in sheets} == {1, 2, 3}
    assert shape(B.chunk_by_kind(usual, F.col("ext"), size=10**6, overlap=20)) == shape(B.chunk_by_kind(mine, F.col("ext"), size=10**6, overlap=20, tags=OWN))


def test_sections_markers_and_images_by_own_tags(spark):
    usual = spark.createDataFrame(texts(), "doc_id int, ext string, text string")
    mine = spark.createDataFrame([(i, e, own(t)) for i, e, t in texts()], usual.schema)
    rows = lambda df: sorted((r.doc_id, r.page, own(r.section)) for r in df.collect())
    assert rows(M.page_sections(usual)) == rows(M.page_sections(mine, tags=OWN)) and M.page_sections(mine, tags=OWN).count() > 70
    lists = [["[Page Number: 1]", "a", " ", "[Slide Number: 2]", "b", "[Page Number: 3 (OCR)]"], ["[Sheet: s] long enough to stay", "x", "y" * 60]]
    df = spark.createDataFrame([(i, x, [own(t) for t in x]) for i, x in enumerate(lists)], "i int, usual array<string>, own array<string>")
    got = df.select(M.joined_markers(F.col("usual")).alias("a"), M.joined_markers(F.col("own"), OWN).alias("b"), M.merged_small(F.col("usual"), 100).alias("c"), M.merged_small(F.col("own"), 100, tags=OWN).alias("d")).collect()
    for r in got:
        assert [own(x) for x in r.a] == r.b and [own(x) for x in r.c] == r.d
    shown = M.substituted_tags(mine.where("doc_id = 1"), lambda p: F.concat(F.lit("!"), p), tags=OWN).collect()[0].text
    assert shown.count("!pic.png") == 8 and "<img:" not in shown
