from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.operators import geometry as G

SENTENCE = "This is a rather long sentence, as one finds it in running text but seldom in the cells of a table, isn't it?"


def tables():
    """Name, rows of cells, whether it is kept, confidence."""
    good = [["name", "amount"], ["a1", "20"], ["b2", "30"]]
    return [
        (good, True, 1.0),
        ([["name", "amount"]], False, 0.0),
        ([["one"], ["two"], ["three"]], False, 0.0),
        ([["ab", "c" * 801], ["d", "e"]], False, 0.0),
        ([[SENTENCE, SENTENCE], [SENTENCE, "x1"]], False, 0.0),
        ([[SENTENCE, "a1"], ["b1", "b2"], ["c1", "c2"]], True, 0.95),
        ([["", "x" * 90], ["", "y" * 90], ["k1", "z"], ["", "w w"]], False, 0.0),
        ([["", None, " "]] * 8 + [["ab", "", ""], ["cd", "", ""]], True, 0.8),
        ([["", "", ""]] * 12 + [["a", "", ""]], True, 0.35),
        ([["l" * 301, "m" * 301, "n1"], ["o1", "p" * 301, "q" * 301]], True, 0.9),
        ([["ab"] * 11, ["cd"] * 11], True, 1.0),
    ]


def test_candidates(spark):
    cells = [(1, 1, i, r, c, x) for i, (rows, _, _) in enumerate(tables()) for r, row in enumerate(rows) for c, x in enumerate(row)]
    df = spark.createDataFrame(cells + [(1, None, 0, 0, 0, "lost"), (1, 1, 0, None, 0, "lost")], "doc int, page int, id int, r int, c int, text string").repartition(3)
    got = {r.id: (r.kept, r.confidence) for r in G.candidate_scores(df).collect()}
    assert got == {i: (k, c) for i, (_, k, c) in enumerate(tables())}
    boxes = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 100.0, 100.0, 800.0, False), (1, 1, 10, 0.0, 0.0, 100.0, 100.0, 800.0, True), (1, 1, 5, 5.0, 5.0, 5.0, 9.0, 800.0, True), (1, 1, 7, 0.0, 0.0, 9000.0, 9000.0, 800.0, True)], "doc int, page int, id int, x0 double, y0 double, x1 double, y1 double, height double, told boolean")
    assert {r.id: r.confidence for r in G.candidate_scores(df, boxes).collect()} == {0: 1.0, 10: 1.0, 5: 0.85, 7: 0.7}
    assert G.candidate_scores(df.where("false")).count() == 0


def test_long_two_columns(spark):
    cells = [(1, 1, 1, r, c, f"k{r}") for r in range(16) for c in (0, 1)]
    df = spark.createDataFrame(cells, "doc int, page int, id int, r int, c int, text string")
    box = lambda high: spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 50.0, high, 800.0, False)], "doc int, page int, id int, x0 double, y0 double, x1 double, y1 double, height double, told boolean")
    assert [G.candidate_scores(df, box(h)).collect()[0].confidence for h in (560.0, 561.0)] == [1.0, 0.85]


def test_labelled_metadata(spark):
    df = spark.createDataFrame([("T", "a", None, 3), ("", None, "x", None), (None, None, None, None)], "t string, a string, k string, n int")
    fields = {"my_own": F.col("n"), "keywords": F.col("k"), "author": F.col("a"), "title": F.col("t"), "create_time": F.when(F.col("n") == 3, F.timestamp_seconds(F.lit(0)))}
    got = [r.b for r in df.select(T.labelled_metadata(fields, "en").alias("b")).collect()]
    assert got == ["<Document-Metadata>\n  Title: T\n  Author: a\n  Created: 1970-01-01 00:00:00\n  My Own: 3\n</Document-Metadata>", "<Document-Metadata>\n  Keywords: x\n</Document-Metadata>", ""]
    own = [r.b for r in df.limit(1).select(T.labelled_metadata({"title": F.col("t")}, tag=("<m>", "</m>")).alias("b")).collect()]
    assert own == ["<m>\n  제목: T\n</m>"]
