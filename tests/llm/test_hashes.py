"""Different words, grams and runs must not be taken for each other, however regular they are."""

import numpy as np
import pytest

import corpus_pipeline as P
from docweave.llm import decontaminate as D
from docweave.llm import jaccard as J
from docweave.llm.queries import op1_suffix_dedup_digest, op8_decontaminate_rows, op9_jaccard_rows

LENGTHS = [64, 72, 512, 1024, 2048, 4096]


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def pair(n):
    return thue_morse(n, "a", "b"), thue_morse(n, "b", "a")


def columns(rows):
    return [(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("seed", [0, 1])
def test_hashes_of_regular_words_differ(seed):
    words = [w for n in [1, 2, 4, 7, 8, 9, 15, 16, 17, 32, *LENGTHS] for w in pair(n)] + ["a" * n for n in range(3, 100)]
    text = np.frombuffer(" ".join(words).upper().encode(), np.uint8)
    h, begin = D.word_hashes(text, np.array([0, len(text)]), seed=seed)
    assert len(h) == len(words) == begin[-1] and len(set(h.tolist())) == len(words)
    again, _ = D.word_hashes(np.frombuffer((". ".join(reversed(words))).encode(), np.uint8), np.array([0, 2 * len(text)]), seed=seed)
    assert again[::-1].tolist() == h.tolist()


def test_grams_of_regular_words_differ():
    two = np.array([3, 5], np.uint64)
    for n in (8, 16, 64, 1024):
        a, b = (D.gram_hashes(two[[int(c) for c in thue_morse(n, x, y)]], n) for x, y in ("01", "10"))
        assert a[0] != b[0]


def test_regular_words_make_no_link_and_no_hit(spark):
    rows, items = [], []
    for k, n in enumerate(LENGTHS):
        a, b = pair(n)
        rows += [(10 * k, " ".join([a, b] * 7)), (10 * k + 1, " ".join([b, b, a] * 5)), (10 * k + 2, a), (10 * k + 3, b), (10 * k + 4, f"some {a} words {a} more {a} here"), (10 * k + 5, f"some {b} words {b} more {b} here")]
        items += [(2 * k, " ".join([a] * 13)), (2 * k + 1, " ".join([a, a, b] * 5))]
    values, schema = columns(rows)
    docs = spark.createDataFrame(values, schema).repartition(3)
    alone = {r.doc_id: r.component_id for r in op9_jaccard_rows(docs).collect()}
    assert alone == {i: i for i, _ in rows}
    assert P.near_copies(spark, docs, "").count() == len(rows)
    hits = op8_decontaminate_rows(docs, spark.createDataFrame(items, "item_id long, text string")).where("n_hit > 0 or contaminated")
    assert hits.count() == 0


def test_regular_words_stay_in_the_benchmark_stage(spark, tmp_path):
    rows = [(k, " ".join([pair(n)[1]] * 20)) for k, n in enumerate(LENGTHS)] + [(99, " ".join([pair(1024)[0]] * 20))]
    spark.createDataFrame([(1, " ".join([w for n in LENGTHS for w in [pair(n)[0]] * 13]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    values, schema = columns(rows)
    assert {r.doc_id for r in P.benchmark(spark, spark.createDataFrame(values, schema), str(tmp_path)).collect()} == set(range(len(LENGTHS)))


def test_regular_runs_are_not_removed(spark):
    a, b = pair(512)
    rows = [(1, "x" + a + "x"), (2, "y" + b + "y"), (3, "z" + a[:450]), (4, "plain")]
    got = {r.doc_id: r.n_removed for r in op1_suffix_dedup_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = {i: t.encode() for i, t in rows}
    starts = {}
    for i, t in texts.items():
        for p in range(len(t) - 399):
            starts.setdefault(t[p : p + 400], []).append((i, p))
    gone = {i: set() for i in texts}
    for at in starts.values():
        for i, p in at if len(at) > 1 else ():
            gone[i] |= set(range(p, p + 400))
    assert got == {i: len(x) for i, x in gone.items()}
