import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from docweave.llm import phrases as P
from docweave.llm.queries import op11_collocations_rows


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least=30, top=2000):
    f = {}
    for lang, text in rows:
        count = f.setdefault("und" if lang is None else lang, Counter())
        if text is None:
            continue
        for piece in re.split("[.,;:!?\x0a-\x0d]", low(text)):
            words = re.findall("[^\x20\x09]+", piece)
            for m in (1, 2, 3, 4):
                for i in range(len(words) - m + 1):
                    count[tuple(words[i : i + m])] += 1
    out = []
    for lang, count in f.items():
        n = sum(v for k, v in count.items() if len(k) == 1)
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in found.items():
            score, _, l, r = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                rows_.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def texts():
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(40)] + ["Été", "日本", "a", "A", "b-c", "\x00", "​", "don't"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    out = [(None, None), ("en", None), ("en", ""), ("", "x y x y " * 40), ("en", " \t\n..."), ("en", "aa aa aa aa aa. " * 35), (None, "New York City, " * 33), ("fr", "new\tyork  city; " * 31)]
    for lang in ("en", "en", "de", None):
        for _ in range(60):
            words = rnd.choices(vocab, weights, k=rnd.randint(0, 120))
            out.append((lang, "".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r", "\x0b", " ? "]) for w in words)))
    out += [("en", "the quick brown fox jumps. " * 30)] * 2 + [("de", "eins zwei drei vier fünf " * 200)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_phrases_against_all_counts(spark, monkeypatch, small):
    """Also with so few buckets that all words share them, divided pivots, and small blocks."""
    if small:
        for name, value in {"BUCKETS": 3, "SHARE": 50, "GATHERED": 300, "MINED": 40, "RANKED": 2}.items():
            monkeypatch.setattr(P, name, value)
        fragments, mined, counts = P._fragments, P._mined, P._word_counts

        def patched(make, *args):
            def run(batches):
                from docweave.llm import phrases

                before = {k: getattr(phrases, k) for k in ("BUCKETS", "SHARE", "GATHERED", "MINED")}
                vars(phrases).update(BUCKETS=3, SHARE=50, GATHERED=300, MINED=40)
                try:
                    yield from (make(*args)(batches) if args else make(batches))
                finally:
                    vars(phrases).update(before)

            return run

        monkeypatch.setattr(P, "_fragments", lambda *a: patched(fragments, *a))
        monkeypatch.setattr(P, "_mined", lambda *a: patched(mined, *a))
        monkeypatch.setattr(P, "_word_counts", patched(counts))
    rows = texts()
    df = spark.createDataFrame([(i, l, t, "x", 3) for i, (l, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int").repartition(5)
    got = sorted(tuple(r) for r in op11_collocations_rows(df).collect())
    assert got == brute(rows)
    assert len(got) > 30


def test_ranks_end_at_the_top(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(tuple(r) for r in P.collocations(df, least=3, top=25).collect())
    assert got == brute(rows, 3, 25)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert op11_collocations_rows(empty).count() == 0
    assert op11_collocations_rows(spark.createDataFrame([(1, None, None), (2, "en", " . ")], empty.schema)).count() == 0


def test_fragments_take_bounded_memory(monkeypatch):
    """A task's arrays for fragments, however many words it has, stay below 150 MB."""
    monkeypatch.setattr(P, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(5000)])
    batches = (pa.record_batch({"lang": ["en"] * 100, "text": [" ".join(words[rng.zipf(1.3, 500) % 5000]) for _ in range(100)]}) for _ in range(26))
    shared = SimpleNamespace(value=rng.integers(30, 4000, P.BUCKETS))
    tracemalloc.start()
    try:
        assert sum(x.num_rows for x in P._fragments(shared, 30)(batches))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    print(f"{peak:.0f} MB")
    assert peak < 150
