import hashlib
import random
import zlib

import numpy as np
import pytest

from docweave.llm import trie as T
from docweave.llm.queries import op13_prefix_trie_rows


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [(r.decode(), t.decode()) for _, _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    below = {k: [] for k in nodes}
    for k in nodes:
        if k:
            below[k[:-1]].append(k)
    out, sums = [], {}
    for k in sorted(nodes, key=len, reverse=True):
        mine = (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0)
        leaves = sum(sums[b][0] for b in below[k]) or 1
        sums[k] = (leaves, mine + sum(sums[b][1] for b in below[k]))
        ends = sorted(c for c in nodes[k] if len(built[c]) == len(k))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(below[k]), *sums[k], sha))
    return sorted(out, key=str)


def conversations():
    rnd = random.Random(9)
    say = ["", "yes", "no\x00", "más", "日本", "a longer text", None]
    rows = []
    for conv in [*range(40), *range(100, 160), 305, 317, 400, 401, 777]:
        for turn in range(rnd.randint(1, 9)):
            rows.append((conv, rnd.choice([None, turn, turn, turn]), rnd.choice(["user", "user", None, ""]), rnd.choice(say)))
    rows += [(c, t, "user", f"turn {t}") for c in range(500, 560) for t in range(12)]
    rows += [(None, 1, "user", "nobody"), (3, 1, "user", "twice"), (3, 1, "user", "twice"), (1000, 2**40, "r", "x")]
    rnd.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("bits", "segment"), [(61, 1 << 16), (1, 1 << 16), (2, 3), (61, 2)])
def test_trie_against_brute_force(spark, monkeypatch, bits, segment):
    """Also with turn hashes of one and two bits, so that most fingerprints collide, and with short segments."""
    monkeypatch.setattr(T, "SEGMENT", segment)
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", conv string, depth int").repartition(5)
    got = sorted((tuple(r) for r in op13_prefix_trie_rows(df, bits).collect()), key=str)
    assert got == brute(rows)


def test_empty_and_single(spark):
    assert op13_prefix_trie_rows(spark.createDataFrame([], SCHEMA)).count() == 0
    for rows in ([(7, None, None, None)], [(-150, 1, "a", "b"), (5, 1, "a", "b")]):
        got = sorted((tuple(r) for r in op13_prefix_trie_rows(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
        assert len(got) == len({(r[0], r[1]) for r in got}) and sum(r[5] for r in got if r[1] == 0) >= 1


def test_one_conversation_over_many_ranges(spark):
    rows = [(4, t, "user", f"t{t % 7}") for t in range(3000)] + [(c, t, "user", f"t{t % 7}") for c in (5, 6) for t in range(c * 100)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert sorted((tuple(r) for r in op13_prefix_trie_rows(df).collect()), key=str) == brute(rows)


def test_products_and_sums_modulo_the_prime():
    rng = np.random.default_rng(1)
    a, b = (np.r_[rng.integers(0, T.PRIME, 500).astype(np.uint64), np.array([0, 1, T.PRIME - 1, T.PRIME - 1], np.uint64)] for _ in range(2))
    assert T.product(a, b).tolist() == [int(x) * int(y) % T.PRIME for x, y in zip(a, b)]
    assert T.running(a).tolist() == [sum(a.tolist()[: i + 1]) % T.PRIME for i in range(len(a))]
    assert T.powers(40).tolist() == [pow(T.BASE, i, T.PRIME) for i in range(40)]


def test_long_lists_of_ends(spark, monkeypatch):
    rows = [(100 * c, 1, "user", "hello") for c in range(9000)]
    got = {r.depth: r for r in op13_prefix_trie_rows(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect() if r.n_convs > 1}
    assert got[1].n_convs == 9000 and got[1].ends_sha256 == hashlib.sha256(",".join(str(100 * c) for c in range(9000)).encode()).hexdigest()
