from collections import Counter

import corpus_pipeline as P


def test_stages_on_planted_documents(spark, tmp_path):
    word = lambda i: "".join("abcdefghij"[int(d)] for d in str(i))
    prose = lambda seed, n: " ".join(word((seed * 7919 + k * k * 31) % 99991) for k in range(n))
    bench = prose(777, 40)
    rows = [(i, prose(i, 120), "en", "s", 0) for i in range(1, 9)]
    rows += [(20, rows[0][1], "en", "s", 0), (21, rows[1][1] + " one more", "en", "s", 0)]
    rows += [(30, prose(30, 60) + " " + bench + " " + prose(31, 60), "en", "s", 0), (31, None, "en", "s", 0), (32, "1234 !!", "en", "s", 0)]
    rows += [(40, prose(40, 100) + ' token = "0123456789abcdef0123456789abcdef" ' + prose(41, 20), "en", None, 7), (None, prose(50, 100), None, "s", 0)]
    rows += [(100 + i, "ñandú " + prose(300 + i, 80).replace("a", "ñ").replace("e", "ú"), "es", "s", 0) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("b1", bench)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    for i, (name, stage) in enumerate(P.STAGES):
        docs = P.written(stage(spark, docs, str(tmp_path)))
        kept[name] = docs.collect()
        assert i + 1 == len(P.STAGES) or docs.columns == P.COLUMNS
    ids = {n: Counter(r.doc_id for r in rows) for n, rows in kept.items()}
    assert set(ids["language"]) == {r[0] for r in rows} - {31, 32}
    assert set(ids["near_copies"]) == set(ids["language"]) - {20, 21} and max(ids["near_copies"].values()) == 1
    assert set(ids["benchmark"]) == set(ids["near_copies"]) - {30} == set(ids["secrets"]) == set(ids["packing"])
    redacted = next(r for r in kept["secrets"] if r.doc_id == 40)
    assert "[SECRET]" in redacted.text and "0123456789abcdef" not in redacted.text and redacted.n_chars == len(redacted.text)
    assert sum(r.length for r in kept["packing"]) == sum({r.doc_id: r.doc_tokens for r in kept["packing"]}.values())


def test_near_copies_by_rows(spark):
    prose = lambda seed, n: " ".join(f"w{(seed * 7919 + k * k * 31) % 99991}" for k in range(n))
    a, b, c, d, e = (prose(i, 60) for i in range(1, 6))
    rows = [(1, a), (None, a + " more"), (None, a), (2, b), (2, c), (2, c + " more"), (3, c + " other")]
    rows += [(None, d), (None, d + " more"), (None, d), (None, e), (None, e), (None, ""), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], ", ".join(f"{c} {k}" for c, k in zip(P.COLUMNS, ["long", "string", "string", "string", "long"]))).repartition(3)
    got = Counter((r.doc_id, (r.text or "").split(" more")[0]) for r in P.near_copies(spark, docs, "").collect())
    assert got == Counter([(1, a), (2, b), (2, c), (None, d), (None, e), (None, ""), (None, "")])
