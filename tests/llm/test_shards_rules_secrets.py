import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docweave.llm.queries import RULES, op5_sharding_rows, op7_secrets_rows
from docweave.llm.secrets import ALARMS, ALPHABETS, _with_p, null_runs, redacted, secrets, thresholds, with_p_text
from docweave.llm.url_rules import judge


def least_capacity(sizes, shards):
    def fits(c):
        used, left = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > left:
                used, left = used + 1, c
            left -= s
        return used <= shards

    c = max(sizes)
    while not fits(c):
        c += 1
    return c


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_minimax(spark, shards):
    rnd = random.Random(shards)
    texts = [rnd.choice("abcdé") * rnd.randint(0, 30) for _ in range(70)] + [None, None, ""] + ["hot"] * 40
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(3, texts[3], 0), (None, "no id", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(4)
    got = op5_sharding_rows(df, shards).collect()
    assert len(got) == len(rows) and all(0 <= r.shard < shards for r in got)
    of, slots, by_text = Counter(), defaultdict(list), defaultdict(set)
    text = {i: t for i, t, _ in rows}
    for r in got:
        t = text[r.doc_id]
        assert r.size == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode())
        of[r.shard] += r.size
        slots[r.shard].append(r.slot)
        by_text[t].add(r.shard)
    assert all(len(s) == 1 for k, s in by_text.items() if k)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = defaultdict(lambda: [10**9, 0])
    for i, t, _ in rows:
        g = groups[t]
        g[0], g[1] = min(g[0], -1 if i is None else i), g[1] + len((t or "").encode()) + 1
    assert max(of.values()) == least_capacity([s for _, s in sorted(groups.values())], shards)


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op5_sharding_rows(empty).count() == 0 and op7_secrets_rows(empty).count() == 0


def brute_rule(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            if best is None or (len(h + p), len(h)) > (len(best[0]), best[2]):
                best = (h + p, v, len(h))
    return host, path, best and best[0], best[1] if best else "allow"


def test_url_rules(spark):
    rnd = random.Random(9)
    rules = RULES + [("a.com", "", "block"), ("com", "/", "allow"), ("b.a.com", "/x/y", "allow"), ("a.com", "/x", "allow"), ("a-b.com", "/", "block"), ("org", "/en/longer/path", "block")]
    hosts = ["example.org", "WWW.Example.org", "badexample.org", "com", "a.com", "b.a.com", "c.b.a.com", "a-b.com", "xa.com", "net", "org", "", "a.com:80", "..", "é.org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/de/", "/fr/x", "/de/#a", "/x/y/z", "/x", "/en/longer/path/1", "?q", "#f", "/a\nb"]
    urls = [None, "", "nothing", "http:/x", *(f"{s}://{h}{p}" for s in ("http", "x://y") for h in hosts for p in paths)]
    pages = [(i, u, "h") for i, u in enumerate(urls)] + [(0, None, "h")]
    rnd.shuffle(pages)
    df = spark.createDataFrame(pages, "page_id long, url string, host string").repartition(3)
    with_nulls = rules + [(None, "/", "block"), ("com", None, "block")]
    got = judge(df, spark.createDataFrame(with_nulls + rules[:1], "host string, path string, verdict string")).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute_rule(urls[r.page_id], rules), urls[r.page_id]
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in judge(df, none).collect()} == {"allow"} and judge(df.where("false"), none).count() == 0


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def brute_base(text):
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets(spark):
    rnd = random.Random(12)
    pick = lambda a, n: "".join(rnd.choice(a) for _ in range(n))
    hexes, upper, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    secret = pick(b64, 64)
    texts = [None, "", "nothing", "token=short", "secret: token:abcdefgh", "PassWord = 'x.y-z=1'", "api_key:AKIA" + pick(upper, 16), "AKIA123 AKIA" + pick(upper, 30), "é漢\U0001f600 " + pick(hexes, 40) + " 😀 " + pick(hexes, 23) + " token = " + pick(hexes, 40), "x " + secret + " y", "see a/very/long/path/of/plain/english/words/that/goes/on/and/on/2024 for more", "token=token=abcdefgh" * 3, "apikey=" + "a" * 6, pick(hexes, 24) + "-" + pick(hexes, 24)]
    texts += [f"before https://host/some/where/{'word' * rnd.randint(5, 9)}{i}/index after" for i in range(40)]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(None, texts[8], "s"), (8, texts[8], "s")], "doc_id long, text string, spans string").repartition(3)
    rows = op7_secrets_rows(df).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        base = brute_base(texts[8 if r.doc_id is None else r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        names = ["assign", "access", "hex"]
        listed = [f"{names[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",")) | {""}
    spans = {r.doc_id: r.spans for r in rows}
    assert spans[9] == "random:2:66"
    assert not any("random" in spans[i] for i in range(14, len(texts)))
    from pyspark.sql import functions as F

    plain = df.where("doc_id in (7, 8, 13)").drop("spans").dropDuplicates()
    done = plain.join(secrets(plain).select("doc_id", "spans").dropDuplicates(["doc_id"]), "doc_id").select("doc_id", redacted(F.col("text"), F.col("spans")).alias("t"))
    for r in done.collect():
        t, covered = texts[r.doc_id], [False] * len(texts[r.doc_id])
        for a, _, b in brute_base(t):
            covered[a:b] = [True] * (b - a)
        want = "".join(("[SECRET]" if not i or not covered[i - 1] else "") if c else t[i] for i, c in enumerate(covered))
        assert r.t == want


@pytest.mark.parametrize("others", [[], ["x " + "".join(random.Random(12).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=64)) + " y"]])
def test_runs_of_equals_signs(spark, others):
    texts = ["Title\n" + "=" * 24, "=" * 400, "a" + "=" * 23, "=" * 23 + "b1", "=" * 30 + "k3" + "=" * 30, "-" * 40, "_" * 24 + "="]
    df = spark.createDataFrame(list(enumerate(texts + others)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in op7_secrets_rows(df).collect()}
    assert len(spans) == len(texts + others) and not any(spans[i] for i in range(len(texts)))
    assert all(spans[len(texts) + i] == "random:2:66" for i in range(len(others)))


def test_runs_are_cut_at_fixed_patterns(spark):
    rnd = random.Random(12)
    pick = lambda a, n: "".join(rnd.choice(a) for _ in range(n))
    hexes, upper, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    first, second = pick(b64, 64), pick(b64, 64)
    texts = [f"{pick(hexes, 32)}_{first}", f"é AKIA{pick(upper, 16)}/{first} x", f"https://h/{pick(hexes, 32)}/{first}?a", f"{first}-{pick(hexes, 32)}-{second}", f"{first}/token={second}", f"{pick(hexes, 32)}_{'a1' * 11}", f"{pick(hexes, 32)}_{'ab' * 30}1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.join(secrets(df), "doc_id").select("doc_id", "base", "spans", redacted(F.col("text"), F.col("spans")).alias("t")).collect()
    of = {r.doc_id: r for r in rows}
    random_of = lambda i: [(s.start, s.end) for s in of[i].spans if s.kind == 3]
    assert [random_of(i) for i in range(7)] == [[(32, 97)], [(22, 87)], [(42, 107)], [(0, 65), (97, 162)], [(0, 65)], [], []]
    assert not any(first in r.t or second in r.t for r in rows)
    for r in rows:
        assert all(s.end <= b.start or b.end <= s.start for s in r.spans if s.kind == 3 for b in r.base)


@pytest.mark.parametrize(("name", "n"), [("base64", 24), ("base64", 40), ("hex", 32), ("base32", 32), ("base36", 64)])
def test_p_values_of_random_strings(spark, name, n):
    """Under its own alphabet a random string falls below a level about as often as the level says, or less."""
    rnd = random.Random(n)
    values = ["".join(rnd.choices(ALPHABETS[name], k=n)) for _ in range(4000)]
    rows = _with_p(spark.createDataFrame([(v,) for v in values], "value string")).collect()
    mine = [r.p for r in rows if r.encoding == name]
    assert len(mine) > 3900
    for level in (0.01, 0.05, 0.2):
        assert sum(p <= level for p in mine) <= level * len(mine) * 1.25 + 3 * (level * len(mine)) ** 0.5
    text = ["".join(rnd.choice(["/the", "some", "over", "path", "with", "house", "2024", "-"]) for _ in range(30))[:n] for _ in range(300)]
    low = [r.p for r in _with_p(spark.createDataFrame([(v,) for v in text], "value string")).collect()]
    assert sum(p <= 0.05 for p in low) >= 0.8 * len(low)


def slug(rnd, n):
    """Words, separators and a number, n characters in all."""
    words = "the some over path with house river green under value index report summer people market window little garden between morning company language number station holiday picture kitchen machine student country".split()
    out = f"{rnd.randint(1, 2030)}"
    while len(out) < n:
        out += rnd.choice("/-_") + (rnd.choice(words).capitalize() if rnd.random() < 0.2 else rnd.choice(words))
    return out[:n]


def test_reported_side_by_length(spark):
    """False alarms of text and of fresh null runs, and power, by length and encoding (printed)."""
    rnd = random.Random(77)
    values = [(f"{name} {n}", "".join(rnd.choices(ALPHABETS[name], k=n))) for name in ALPHABETS for n in (24, 32, 40, 64, 128, 600) for _ in range(200)]
    values += [(f"text {n}", slug(rnd, n)) for n in (24, 32, 40, 64, 128, 600) for _ in range(2000)]
    share = lambda level: F.avg((F.col("p_text") <= level).cast("int"))
    rows = with_p_text(_with_p(spark.createDataFrame(values, "what string, value string"))).groupBy("what").agg(share(0.05).alias("at5"), share(0.01).alias("at1")).collect()
    for r in sorted(rows, key=lambda r: (r.what.split()[0], int(r.what.split()[1]))):
        print(r.what, round(r.at5, 3), round(r.at1, 3))
        if r.what.startswith("text"):
            assert r.at5 <= 0.05 and r.at1 <= 0.01
        elif int(r.what.split()[1]) >= 64:
            assert r.at5 >= 0.95
    fresh = with_p_text(_with_p(null_runs(spark, 1000, seed=9).select("value"))).groupBy("encoding", "length_class").agg(share(0.05).alias("at5"), share(0.01).alias("at1")).collect()
    assert len(fresh) == 60 and all(r.at5 <= 0.09 and r.at1 <= 0.03 for r in fresh)
    assert sum(r.at5 for r in fresh) / len(fresh) <= 0.05 and sum(r.at1 for r in fresh) / len(fresh) <= 0.01


def test_thresholds():
    rnd = random.Random(4)
    for _ in range(50):
        bins = {b: rnd.randint(1, 20) for b in rnd.sample(range(-80, 1), 12)}
        ends = sorted(2 ** ((b + 1) / 4) for b, n in bins.items() for _ in range(n))
        kept = [i for i, p in enumerate(ends, 1) if p <= ALARMS * i / len(ends)]
        got = thresholds({5: bins})
        assert sum(n for b, n in bins.items() if 5 in got and b <= got[5]) == (max(kept) if kept else 0)
    assert thresholds({}) == {}


def test_reported_runs_are_secrets(spark):
    """Half the runs of every length are text: few of those reported are, most secrets of 40 characters or more are found."""
    rnd = random.Random(5)
    rows = []
    for i in range(1200):
        n, secret = rnd.choice((24, 32, 40, 64, 100, 300)), i % 2
        value = "".join(rnd.choices(ALPHABETS["base64"], k=n)) if secret else slug(rnd, n)
        rows.append((i, f"see {value} there", n, secret))
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, secret int").repartition(4)
    got = {r.doc_id for r in secrets(df).where("exists(spans, s -> s.kind = 3)").collect()}
    wrong, right = sum(not rows[i][3] for i in got), sum(rows[i][3] for i in got)
    print(f"{right} secrets and {wrong} texts reported")
    assert wrong <= 0.05 * len(got)
    for n, least in ((40, 0.8), (64, 0.95), (100, 0.95), (300, 0.95)):
        mine = [r[0] for r in rows if r[2] == n and r[3] and not brute_base(r[1])]
        assert sum(i in got for i in mine) >= least * len(mine)
