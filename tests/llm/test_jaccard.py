import random

import numpy as np
import pytest

from docweave.llm import jaccard as J
from docweave.llm.common import small_star
from docweave.llm.queries import op9_jaccard_rows


def shingles(text, n):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: 32 for i in range(9, 14)}).split(" ") if w]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for (d, _), g in zip(rows, group) if g == group[i] and d is not None]
        out.append((doc, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(11)
    words = [f"W{i}é" for i in range(600)]
    texts = [None, "", " \t\n", "one", "one", "ONE two", "one  two", "a b c", "A b\nc", "a b c d"]
    for size in (9, 10, 12, 20, 40, 70, 130, 400):
        for _ in range(4):
            base = [rnd.choice(words) for _ in range(size)]
            texts.append(" ".join(base))
            for _ in range(6):
                base = list(base)
                for _ in range(rnd.randint(0, max(1, size // 40))):
                    k = rnd.randrange(len(base))
                    base[k : k + rnd.randint(0, 1)] = rnd.choices(words, k=rnd.randint(0, 2))
                texts.append(" ".join(base))
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    return list(zip(ids, texts)) + [(None, texts[20]), (None, "alone here today"), (ids[15], texts[15])]


@pytest.mark.parametrize(("n", "percent", "family"), [(3, 90, 16 << 20), (5, 80, 16 << 20), (3, 90, 6000), (3, 50, 16 << 20)])
def test_components_against_all_pairs(spark, monkeypatch, n, percent, family):
    monkeypatch.setattr(J, "FAMILY_BYTES", family)
    monkeypatch.setattr(J, "LEAF", 4)
    monkeypatch.setattr(J, "FAN", 2)
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component int").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(df, n, percent).collect()), key=str)
    assert got == brute(rows, n, percent)


def chain(n):
    """Texts of which each shares a third with the next, so that they are one family without a link."""
    parts = [" ".join(f"p{i}x{j}" for j in range(30)) for i in range(n + 2)]
    return [f"{parts[i]} {parts[i + 1]} {parts[i + 2]}" for i in range(n)]


def test_a_chain_is_dealt_in_proportion(spark, monkeypatch):
    """A family that marks alone chain together and that is over FAMILY_BYTES doesn't go to all pairs of its tiles."""
    monkeypatch.setattr(J, "FAMILY_BYTES", 20_000)
    verify, dealt = J._verify, {}
    for n in (200, 800):
        rows = spark.sparkContext.accumulator(0)

        def counted(percent, rows=rows):
            def run(batches):
                def seen():
                    for batch in batches:
                        rows.add(batch.num_rows)
                        yield batch

                yield from verify(percent)(seen())

            return run

        monkeypatch.setattr(J, "_verify", counted)
        found = J.jaccard_components(spark.createDataFrame(list(enumerate(chain(n))), "doc_id long, text string"), 3, 80).collect()
        assert sorted((r.doc_id, r.component_id) for r in found) == [(i, i) for i in range(n)]
        dealt[n] = rows.value
    assert dealt[200] >= 200
    assert dealt[800] < 6 * dealt[200]


def test_empty(spark):
    assert op9_jaccard_rows(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(2)
    for _ in range(1500):
        size = int(rng.integers(1, 400))
        common = rng.integers(0, 2**63, size).astype(np.uint64)
        extra = (100 - percent) * size // percent
        a = int(rng.integers(0, extra + 1))
        b = extra - a
        more = rng.integers(0, 2**63, extra).astype(np.uint64)
        x, y = np.unique(np.r_[common, more[:a]]), np.unique(np.r_[common, more[a:]])
        assert len(np.intersect1d(J.signatures(x, percent), J.signatures(y, percent))), (size, a, b)


def test_tree_gives_every_pair_its_bound_allows(monkeypatch):
    monkeypatch.setattr(J, "LEAF", 4)
    monkeypatch.setattr(J, "FAN", 2)
    monkeypatch.setattr(J, "PAIRS", 50)
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 90):
        points = rng.integers(0, 6, (n, 3)).repeat(2, 0)[:n].astype(np.int32)
        size = points.sum(1)
        tree = J.Tree(points, size)
        assert sorted(tree.order.tolist()) == list(range(n))
        got = {tuple(sorted((int(tree.order[a]), int(tree.order[b])))) for i, j in tree.pairs(80) for a, b in zip(i, j)}
        want = {(a, b) for a in range(n) for b in range(a + 1, n) if 180 * np.minimum(points[a], points[b]).sum() >= 80 * (size[a] + size[b])}
        assert got == want


def smallest(edges):
    found = {x: x for e in edges for x in e}
    while True:
        new = dict(found)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == found:
            return found
        found = new


def graphs():
    rnd = random.Random(4)
    path = list(range(70))
    rnd.shuffle(path)
    return {
        "empty": [],
        "loops": [(3, 3)],
        "star": [(0, i) for i in range(1, 40)] + [(i, 0) for i in range(1, 40)],
        "high star": [(100, i) for i in range(40)],
        "path": list(zip(path, path[1:])),
        "negative": [(-5, 4), (4, 9), (9, -7), (1, 2)],
        "random": [(rnd.randrange(90), rnd.randrange(90)) for _ in range(60)],
    }


def test_small_star_makes_a_row_for_a_row(spark):
    rnd = random.Random(9)
    edges = sorted({(max(a, b), min(a, b)) for a, b in graphs()["random"] + [(rnd.randrange(40), 50 + rnd.randrange(3)) for _ in range(200)] if a != b})
    found = [tuple(r) for r in small_star(spark.createDataFrame(edges, "u long, v long")).collect()]
    assert len(found) == len(edges)
    assert all(u > v for u, v in found)
    assert smallest(found) == smallest(edges)


@pytest.mark.parametrize("name", graphs())
def test_components_of_graphs(spark, name):
    edges = [e for e in graphs()[name] if e[0] != e[1]]
    a, b = np.array(graphs()[name], np.int64).reshape(-1, 2).T
    assert dict(zip(*[x.tolist() for x in J.stars(a, b)])) == {x: y for x, y in smallest(edges).items() if x != y}
    found = J.components(spark.createDataFrame(graphs()[name], "a long, b long").repartition(3)).collect()
    assert sorted(map(tuple, found)) == sorted(smallest(edges).items())
