import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from docweave.llm import suffix_dedup as S
from docweave.llm.queries import op1_suffix_dedup_digest


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(r)) if gone[i] and (not i or not gone[i - 1]))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeéfgh") for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = [text(90) for _ in range(6)]
    texts = [None, "", "short", "ab" * 700, "z" * 900, "z" * 401, shared[0], shared[0]]
    for _ in range(60):
        body = text(rnd.randint(5, 300))
        for _ in range(rnd.randint(0, 3)):
            passage = rnd.choice(shared)
            cut = rnd.randint(0, 40)
            k = rnd.randint(0, len(body))
            body = body[:k] + passage[cut : len(passage) - rnd.randint(0, 40)] + body[k:]
        texts.append(body)
        if rnd.random() < 0.2:
            k = rnd.randint(0, len(body))
            texts.append(body[:k] + "Q" + body[k:])
    texts.append(text(3000) + shared[1] + text(2000) + shared[1])
    return texts


@pytest.mark.parametrize("hot", [2048, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "CHUNK", 1 << 12)
    monkeypatch.setattr(S, "BLOCK", 1 << 13)
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op1_suffix_dedup_digest(df).collect()}
    want = brute(texts, 400)
    assert [got[i] for i in range(len(texts))] == want


def test_repeated_rows_null_ids_and_empty(spark):
    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(300))
    df = spark.createDataFrame([(1, text), (1, text), (None, text[:500]), (None, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id or -1, r.n_bytes, r.n_removed) for r in op1_suffix_dedup_digest(df).collect()))
    assert rows == [(-1, 0, 0), (-1, 500, 500), (1, len(text), len(text)), (1, len(text), len(text))]
    assert op1_suffix_dedup_digest(df.where("false")).count() == 0


def test_equal_suffixes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 300):
        data = rng.integers(97, 99, 600).astype(np.uint8)
        starts = rng.integers(0, 600 - 40, n)
        strings = [data[s : s + 40].tobytes() for s in starts]
        want = [strings.count(x) > 1 for x in strings]
        assert S.equal_suffixes(data, starts, 40).tolist() == want
