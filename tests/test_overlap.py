import random
import time

from pyspark.sql import functions as F

from docweave.operators import layout as L

CORNERS = ("x0", "y0", "x1", "y1")


def test_alike_boxes_are_compared_once(spark):
    """Every image on every cell: 3.6 billion pairs, one of boxes that differ."""
    n, box = 60_000, (1.0, 2.0, 7.0, 6.0)
    of = lambda name: spark.range(n).select(F.lit(0).alias("page"), F.col("id").alias(name), *[F.lit(v).alias(c) for c, v in zip(CORNERS, box, strict=True)])
    start = time.time()
    got = L.best_cells(of("image"), of("cell")).groupBy("page", "cell", "ratio").agg(F.count("*"), F.countDistinct("image")).collect()
    assert [tuple(r) for r in got] == [(0, 0, 1.0, n, n)]
    assert time.time() - start < 60


def test_best_cells_equal_all_pairs(spark):
    rng = random.Random(4)

    def boxes(n, ids, w, h):
        out = []
        for i in range(n):
            x, y = float(rng.randrange(-20, 140, 3)), float(rng.randrange(0, 120, 4))
            out.append((rng.randrange(2), rng.randrange(3), i % ids, x, y, x + rng.randrange(1, w), y + rng.randrange(1, h)))
        return out

    images, cells = boxes(900, 800, 9, 7), boxes(700, 650, 14, 12)
    best = {}
    for d, p, image, *i in images:
        for d2, p2, cell, *c in cells:
            shared = max(0.0, min(i[2], c[2]) - max(i[0], c[0])) * max(0.0, min(i[3], c[3]) - max(i[1], c[1]))
            ratio = shared / ((i[2] - i[0]) * (i[3] - i[1]))
            if (d, p) == (d2, p2) and ratio >= 0.6:
                best[d, p, image] = max(best.get((d, p, image), (0.0, 0)), (ratio, -cell))
    want = sorted((*k, -cell, ratio) for k, (ratio, cell) in best.items())
    df = lambda rows, name: spark.createDataFrame(rows, ["doc", "page", name, *CORNERS])
    got = sorted(tuple(r) for r in L.best_cells(df(images, "image"), df(cells, "cell"), keys=["doc", "page"]).collect())
    assert len(want) > 100 and got == want
