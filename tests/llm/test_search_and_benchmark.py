import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from docweave.llm import decontaminate as D
from docweave.llm import topk as K
from docweave.llm.language import BLOCK, LEVEL, MARGIN, folded, learn, scorer
from docweave.llm.queries import op2_topk_rows, op3_language_rows, op8_decontaminate_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute8(doc, items):
    w, hit, found = words(doc), set(), []
    for i, t in items:
        v = words(t)
        k, ok = min(13, len(v)), False
        for a in range(len(v) - k + 1) if v else ():
            for p in range(len(w) - k + 1):
                if w[p : p + k] == v[a : a + k]:
                    ok = True
                    hit.update(range(p, p + k))
        if ok and i is not None:
            found.append(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("bits", [1 << 25, 64])
def test_decontamination_against_all_windows(spark, monkeypatch, bits):
    monkeypatch.setattr(D, "BITS", bits)
    rnd = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "abcé9" for b in "xyzß"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.choice([2, 5, 9, 12, 13, 14, 30, 60]))) for i in range(14)] + [(50, None), (51, ""), (52, "..."), (53, "ax ax " * 10)]
    docs = [None, "", "?!", "ax " * 40]
    for _ in range(60):
        parts = [text(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 2)):
            v = words(rnd.choice(items)[1])
            a = rnd.randint(0, max(0, len(v) - 13))
            parts += [rnd.choice([", ", " ", "\n-"]).join(v[a : a + rnd.randint(11, 40)]).upper().replace("SS", "ß").replace("É", "é"), text(rnd.randint(0, 400))]
        docs.append(" ".join(parts))
    df = spark.createDataFrame([(i if i != 5 else None, t, 0) for i, t in enumerate(docs)], "doc_id long, text string, hits int").repartition(3)
    bench = spark.createDataFrame([(i, t, "") for i, t in items], "item_id long, text string, doc_id string")
    got = {r.doc_id: tuple(r)[1:] for r in op8_decontaminate_rows(df, bench).collect()}
    for i, t in enumerate(docs):
        assert got[i if i != 5 else None] == brute8(t, items), i
    assert op8_decontaminate_rows(df, bench.where("false")).where("n_hit > 0").count() == 0
    assert op8_decontaminate_rows(df.where("false"), bench).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_topk_against_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(K, "ROW_BLOCK", 60)
    rnd = random.Random(8)
    rows = [(i, [scale * rnd.gauss(0, 0.3) for _ in range(24)]) for i in range(150)]
    rows += [(200, rows[3][1]), (220, [0.0] * 24), (240, None), (260, [math.nan] * 24), (280, [1.0, None]), (300, []), (None, rows[0][1]), (320, [math.inf] * 24), (340, [0.5] * 5)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(4)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in op2_topk_rows(df).collect())
    import numpy as np

    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:20]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert op2_topk_rows(df.where("false")).count() == 0


def test_levels_prune_what_can_be_pruned():
    import numpy as np

    rng = np.random.default_rng(3)

    def survivors(rows):
        ids, seen = np.arange(len(rows)), {}
        got = sorted(K.best(rows[:200], ids[:200], rows, ids, 20, seen=seen))
        scores = rows[:200] @ rows.T
        want = [(i, j, int(scores[i, j])) for i in range(200) for j in sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-scores[i, j], j))[:20]]
        assert got == sorted(want)
        return {s: round(b / a, 4) for s, (a, b) in seen.items()}, seen[64][0] / (200 * len(rows))

    smooth = np.repeat(rng.normal(0, 200, (6000, 8)), 8, axis=1) + rng.normal(0, 4, (6000, 64))
    shares, computed = survivors(np.floor(smooth).astype(np.int64))
    print("segments of even components:", shares, computed)
    assert computed < 0.25
    shares, computed = survivors(np.floor(rng.normal(0, 16, (6000, 64))).astype(np.int64))
    print("independent components:", shares, computed)


def test_language_samples_whole_texts_of_every_language(spark):
    late = "x" * 2000 + " zwei drei vier"
    rows = [(i, f"word{i} " * 5, f"l{i:03d}") for i in range(230)] + [(1000, late, "l000")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = learn(docs, F.lit(True))
    assert len(learned) == 230 and b"zwei drei vier" in learned["l000"] and learned["l007"] == folded(rows[7][1]).encode()
    assert len(learn(docs, F.lit(True), total=2300)) == 230 and all(len(v) < 300 for k, v in learn(docs, F.lit(True), total=2300).items() if k != "l000")


def test_language_is_the_least_code(spark):
    import zstandard as z

    rnd = random.Random(9)
    texts = {lang: [" ".join("".join(rnd.choice(a) for _ in range(5)) for _ in range(700)) for _ in range(4)] for lang, a in (("aa", "abcde"), ("bb", "cdefg"), ("cc", "fghij"))}
    dictionaries = {lang: folded(t[0]).encode() for lang, t in texts.items()}
    score = scorer(dictionaries)
    for text in [t for ts in texts.values() for t in ts[1:]] + ["abc", "fgh ij", "12", ""]:
        sizes = {}
        for lang, d in dictionaries.items():
            whole = z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT)
            how = z.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, dict_size=len(d), write_checksum=False, write_content_size=False, write_dict_id=False)
            body = folded(text)
            sizes[lang] = sum(len(z.ZstdCompressor(compression_params=how, dict_data=whole).compress(body[i : i + BLOCK].encode())) for i in range(0, len(body), BLOCK))
        lang, value, rejected = score(text)
        if not any(map(str.isalpha, text)):
            assert (lang, value, rejected) == ("und", 0.0, True)
            continue
        first, second = sorted(sizes.values())[:2]
        assert lang == min(sizes, key=lambda k: (sizes[k], k)) and value == min(1.0, (second - first) / first) and rejected == (value < MARGIN)


def test_language(spark):
    rnd = random.Random(6)
    stems = {"en": ["the", "ing", "th", "er", "and"], "fr": ["le", "eau", "é", "que", "oi"], "de": ["sch", "und", "ü", "ung", "ei"]}
    word = lambda lang: "".join(rnd.choice(stems[lang]) for _ in range(rnd.randint(1, 3)))
    rows = [(i, " ".join(word(lang) for _ in range(60)), lang) for i in range(240) for lang in [rnd.choice(list(stems))]]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "12 %", "de"), (None, "the and er", "en"), (1003, rows[0][1] * 800, None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in op3_language_rows(df).collect()}
    import zlib

    for i, t, lang in rows:
        r = got[i]
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.rejected == (r.score < MARGIN)
        assert r.lang_pred == "und" if i in (1000, 1001, 1002) else r.lang_pred in stems
    right = [got[i].lang_pred == lang for i, _, lang in rows if i is not None and i < 1000 and got[i].held_out]
    assert sum(right) >= 0.97 * len(right)
    assert op3_language_rows(df.where("false")).count() == 0
    assert {r.lang_pred for r in op3_language_rows(df.withColumn("lang", df.lang.substr(1, 0)).where("lang is null")).collect()} == {"und"}
