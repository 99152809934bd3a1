"""Secret scanning: fixed patterns, and a battery of randomness tests under false-discovery control.

Only DataFrame functions. A candidate is what fixed patterns leave of a maximal run of letters, digits and +/_=-:
every piece of 24 or more, of which 24 or more are left without the '=' at its ends. Its encoding is inferred (hex, base32, base36 or
base64 alphabet); under that alphabet's uniform distribution three tests give a p-value each: chi-squared on the symbol
counts, the runs test on the upper and lower half of the alphabet, and the correlation of neighbours. The least
of the three says how well the candidate passes for random.

What is reported is controlled, not what is cleared: the null is that a candidate is text-like. Runs made by rule, as
names, paths and slugs are made (null_runs()), go through the same tests in each class of lengths and encoding, and a
candidate's p_text is the chance that such a run passes for random as well as it does, by the mean and deviation of
sqrt(-2 ln least) there. In each class of lengths, Benjamini-Hochberg at level ALARMS over the candidates that mix digits
and letters picks those to report, so the expected share of text-like runs among them is at most ALARMS. Candidates over
LONGEST characters are held against null runs of LONGEST, which pass for random more easily than longer ones. The
thresholds come from counts of p_text by class and bin.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
LEAST = 24
RUN = r"[A-Za-z0-9+/_=\-]{%d,}" % LEAST
ALARMS = 0.05
LONGEST, NULL_RUNS = 256, 500
_fits: dict[tuple[str, int], tuple[float, float]] = {}
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Letters of English in a thousand.
LETTERS = {"e": 127, "t": 91, "a": 82, "o": 75, "i": 70, "n": 67, "s": 63, "h": 61, "r": 60, "d": 43, "l": 40, "c": 28, "u": 28, "m": 24, "w": 24, "f": 22, "g": 20, "y": 20, "p": 19, "b": 15, "v": 10, "k": 8, "j": 2, "x": 2, "q": 1, "z": 1}
ALPHABETS = {"hex": DIGITS + "abcdef", "base32": UPPER + "234567", "base36": DIGITS + LOWER, "base64": UPPER + LOWER + DIGITS + "+/"}


def _found(text: Column, pattern: str, kind: str, kept: str = "true") -> Column:
    """Array of (start, kind number, end, value) of a pattern's matches, in code points."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    struct = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(struct).alias("out"))

    def step(state, pair):
        start = state["at"] + pair["gap"]
        end = start + F.length(pair["value"])
        one = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.cast("long").alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(values, gaps, lambda v, g: F.struct(v.alias("value"), g.cast("long").alias("gap")))
    pairs = F.filter(pairs, lambda p: p["value"].isNotNull())
    return F.when(text.rlike(pattern), F.aggregate(pairs, begin, step)["out"]).otherwise(F.array().cast(struct))


def _normal_tail(z: Column) -> Column:
    """About the two-sided tail of a standard normal value, by the usual five-term polynomial."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def _with_p(tokens: DataFrame) -> DataFrame:
    """Add encoding, least (of three p-values) and p to tokens (value); values of fewer than LEAST characters between their outer '=' go."""
    bare = F.trim(F.translate("value", "_-", "/+"), F.lit("="))
    tokens = tokens.withColumn("bare", bare).withColumn("n", F.length("bare").cast("double")).where(F.col("n") >= LEAST)
    encoding = F.when(F.col("bare").rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(F.col("bare").rlike("^[A-Z2-7]+$"), "base32").when(F.col("bare").rlike("^([0-9a-z]+|[0-9A-Z]+)$"), "base36").otherwise("base64")
    tokens = tokens.withColumn("encoding", encoding)
    folded = F.when(F.col("encoding").isin("hex", "base36"), F.lower("bare")).otherwise(F.col("bare"))
    tokens = tokens.withColumn("bare", F.translate(folded, "=", ""))

    def by(value) -> Column:
        out = F.lit(None)
        for name, alphabet in ALPHABETS.items():
            out = F.when(F.col("encoding") == name, value(alphabet)).otherwise(out)
        return out

    squares = lambda a: F.aggregate(F.split(F.lit(a), ""), F.lit(0.0), lambda acc, s: acc + F.when(s == "", 0.0).otherwise(F.pow((F.length("bare") - F.length(F.replace("bare", s, F.lit("")))).cast("double"), 2)))
    tokens = tokens.withColumn("m", by(lambda a: F.lit(float(len(a))))).withColumn("squares", by(squares))
    tokens = tokens.withColumn("bits", by(lambda a: F.translate("bare", a, "0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2))))
    tokens = tokens.withColumn("codes", by(lambda a: F.transform(F.split("bare", ""), lambda c: F.when(c == "", None).otherwise(F.instr(F.lit(a), c).cast("double")))))
    tokens = tokens.withColumn("codes", F.filter("codes", lambda c: c.isNotNull()))
    chi = F.col("squares") * F.col("m") / F.col("n") - F.col("n")
    # Its mean is m - 1 and its variance 2 (m - 1) (n - 1) / n however few the counts: Wilson and Hilferty for a gamma of these.
    df = (F.col("m") - 1) * F.col("n") / (F.col("n") - 1)
    z1 = (F.pow(chi / (F.col("m") - 1), 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    tokens = tokens.withColumn("p1", F.when(z1 > 0, _normal_tail(z1) / 2).otherwise(F.lit(0.5)))
    ones = F.length(F.replace("bits", F.lit("0"), F.lit(""))).cast("double")
    zeros = F.col("n") - ones
    runs = F.length(F.regexp_replace("bits", "0+|1+", "x")).cast("double")
    mean = 2 * ones * zeros / F.col("n") + 1
    spread = F.sqrt((mean - 1) * (mean - 2) / (F.col("n") - 1))
    tokens = tokens.withColumn("p2", F.when((ones == 0) | (zeros == 0), F.pow(F.lit(0.5), F.col("n") - 1)).when(spread > 0, _normal_tail((runs - mean) / spread)).otherwise(F.lit(1.0)))
    tokens = tokens.withColumn("mean", F.aggregate("codes", F.lit(0.0), lambda a, c: a + c) / F.col("n"))
    var = F.aggregate("codes", F.lit(0.0), lambda a, c: a + F.pow(c - F.col("mean"), 2))
    next_codes = F.slice("codes", F.lit(2), F.size("codes"))
    pair = F.aggregate(F.zip_with("codes", next_codes, lambda a, b: (a - F.col("mean")) * (b - F.col("mean"))), F.lit(0.0), lambda a, c: a + F.coalesce(c, F.lit(0.0)))
    tokens = tokens.withColumn("var", var).withColumn("p3", F.when(F.col("var") > 0, _normal_tail((pair / F.col("var") + 1 / F.col("n")) * F.sqrt("n"))).otherwise(F.lit(0.0)))
    tokens = tokens.withColumn("least", F.least("p1", "p2", "p3"))
    return tokens.withColumn("p", F.least(F.lit(1.0), 3 * F.col("least"))).drop("bare", "m", "squares", "bits", "codes", "mean", "var", "p1", "p2", "p3")


def length_class(n: Column) -> Column:
    """Four classes for each doubling of the length; all from LONGEST on are one."""
    return F.floor(F.log2(F.least(n, F.lit(float(LONGEST)))) * 4).cast("int")


def _symbols(encoding: str) -> str:
    """Symbols of a text-like run in an encoding, each as often as it comes up: letters of English, a tenth digits, low
    ones first, and in base64 a sixth '/' and an eighth of the letters capitals."""
    share = {c: 0.9 * w / sum(LETTERS.values()) for c, w in LETTERS.items()}
    share |= {d: 0.1 * math.log(1 + 1 / (i + 1), 11) for i, d in enumerate(DIGITS)}
    if encoding == "base64":
        share = {c: w * 5 / 6 for c, w in share.items()} | {"/": 1 / 6}
        share = {c: w * 7 / 8 if c in LETTERS else w for c, w in share.items()} | {c.upper(): share[c] / 8 for c in LETTERS}
    if encoding == "base32":
        share = {c.upper(): w for c, w in share.items()}
    mine = {c: w for c, w in share.items() if c in ALPHABETS[encoding]}
    return "".join(c * round(2000 * w / sum(mine.values())) for c, w in mine.items())


def null_runs(spark: SparkSession, many: int = NULL_RUNS, seed: int = 0) -> DataFrame:
    """(encoding, value): `many` text-like runs for each encoding and class of lengths, of the class's least length.

    Symbols are drawn independently, which passes for random more easily than words do, whose neighbours depend on each
    other. Made by hash from (seed, encoding, length, number), so every session makes the same.
    """
    lengths = [max(LEAST, math.ceil(2 ** (c / 4))) for c in range(int(4 * math.log2(LEAST)), int(4 * math.log2(LONGEST)) + 1)]

    def run(table: str) -> Column:
        draw = lambda j: F.pmod(F.xxhash64(F.lit(seed), "encoding", "length", "id", j), F.lit(len(table)))
        symbols = F.transform(F.sequence(F.lit(1), "length"), lambda j: F.substring(F.lit(table), (draw(j) + 1).cast("int"), F.lit(1)))
        return F.array_join(symbols, "")

    made = F.lit(None)
    for name in ALPHABETS:
        made = F.when(F.col("encoding") == name, run(_symbols(name))).otherwise(made)
    kinds = F.explode(F.array(*[F.lit(name) for name in ALPHABETS]))
    rows = spark.range(many).withColumn("length", F.explode(F.array(*map(F.lit, lengths)))).withColumn("encoding", kinds)
    return rows.select("encoding", made.alias("value"))


def _distance() -> Column:
    """How far a run is from passing for random: about a normal deviate where its least p-value is small, towards 0 at 1."""
    return F.sqrt(-2 * F.log(F.greatest("least", F.lit(1e-300))))


def _null_fits(spark: SparkSession) -> dict[tuple[str, int], tuple[float, float]]:
    """Mean and deviation of _distance() over the null runs by encoding and class; the same always, so worked out once."""
    if not _fits:
        null = _with_p(null_runs(spark).select("value")).withColumn("length_class", length_class(F.col("n")))
        far = _distance()
        for r in null.groupBy("encoding", "length_class").agg(F.avg(far).alias("mean"), F.stddev(far).alias("spread")).collect():
            _fits[r["encoding"], r["length_class"]] = r["mean"], r["spread"]
    return _fits


def with_p_text(tokens: DataFrame) -> DataFrame:
    """Add to tested tokens (encoding, n, least) their length_class and p_text."""
    tokens = tokens.withColumn("length_class", length_class(F.col("n")))
    of_null = _null_fits(tokens.sparkSession)
    of = F.create_map(*[x for (e, c), (m, s) in sorted(of_null.items()) for x in (F.lit(f"{e} {c}"), F.array(F.lit(m), F.lit(s)))])
    fit = F.try_element_at(of, F.concat_ws(" ", "encoding", "length_class"))
    z = (_distance() - F.get(fit, F.lit(0))) / F.get(fit, F.lit(1))
    tail = F.when(z <= 0, _normal_tail(z) / 2).otherwise(1 - _normal_tail(z) / 2)
    return tokens.withColumn("p_text", F.coalesce(tail, F.lit(1.0)))


def thresholds(counts: dict[int, dict[int, int]], level: float = ALARMS) -> dict[int, int]:
    """Benjamini-Hochberg in each class from its counts by bin(): the last bin to report, where there is one."""
    last = {}
    for c, bins in counts.items():
        total, seen = sum(bins.values()), 0
        for b in sorted(bins):
            seen += bins[b]
            if 2 ** ((b + 1) / 4) * total <= level * seen:
                last[c] = b
    return last


def bin_of(p: Column) -> Column:
    """Quarters of powers of two; p lies below 2^((bin + 1) / 4)."""
    return F.greatest(F.lit(-200), F.floor(F.log2(F.greatest(p, F.lit(1e-300))) * 4).cast("int"))


def _pieces(runs: Column, base: Column) -> Column:
    """The runs cut at the base spans (ordered by start): pieces of LEAST or more characters, of the runs' fields.

    Where LEAST characters are left without them, the joiners at a piece's ends are not part of its value.
    """

    def cut(r) -> Column:
        def with_piece(state, end) -> Column:
            value = F.substring(r["value"], (state["at"] - r["start"] + 1).cast("int"), (end - state["at"]).cast("int"))
            core = F.regexp_replace(value, r"^[/_+=\-]+|[/_+=\-]+$", "")
            value = F.when(F.length(core) >= LEAST, core).otherwise(value)
            one = F.struct(state["at"].alias("start"), r["kind"].alias("kind"), end.alias("end"), value.alias("value"))
            return F.when(end - state["at"] >= LEAST, F.concat(state["out"], F.array(one))).otherwise(state["out"])

        met = F.filter(base, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
        begin = F.struct(r["start"].alias("at"), F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>").alias("out"))
        step = lambda state, b: F.struct(F.greatest(state["at"], b["end"]).alias("at"), with_piece(state, b["start"]).alias("out"))
        return F.when(F.size(met) == 0, F.array(r)).otherwise(F.aggregate(met, begin, step, lambda state: with_piece(state, r["end"])))

    return F.when(F.size(base) == 0, runs).otherwise(F.flatten(F.transform(runs, cut)))


def secrets(docs: DataFrame) -> DataFrame:
    """docs' key columns and spans: array of (start, kind number, end) by start, then kind, in code points.

    One row for each row of docs (doc_id, text; other columns are ignored): (doc_id, a, b, base, spans), a and b being
    its row_key(). Null and empty texts have no spans, repeated rows the same ones, a null doc_id is kept, an empty
    table gives no rows. Spans of different kinds may overlap; random ones overlap no other.
    """
    text = F.coalesce("text", F.lit(""))
    a, b = row_key()
    keyed = docs.select("doc_id", a.alias("a"), b.alias("b"), text.alias("text"))
    value = lambda s: F.regexp_extract(s["value"], ASSIGN, 2)
    found = keyed.select(
        "doc_id", "a", "b",
        F.filter(_found(F.col("text"), ASSIGN, "assign"), lambda s: F.length(value(s)) >= 6).alias("assign"),
        _found(F.col("text"), ACCESS, "access").alias("access"),
        _found(F.col("text"), HEX, "hex").alias("hex"),
        _found(F.col("text"), RUN, "random").alias("runs"),
    )
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    found = found.select("doc_id", "a", "b", F.array_sort(bare(F.concat("assign", "access", "hex"))).alias("base"), F.col("runs"))
    found = written(found.select("doc_id", "a", "b", "base", _pieces(F.col("runs"), F.col("base")).alias("runs")))
    tokens = found.where("size(runs) > 0").dropDuplicates(["a", "b"]).select("doc_id", "a", "b", F.explode("runs").alias("run")).select("doc_id", "a", "b", "run.*")
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    tokens = with_p_text(_with_p(tokens.where(mixed)))
    tokens = written(tokens.select("a", "b", "start", "kind", "end", "length_class", bin_of(F.col("p_text")).alias("bin")))
    counts: dict[int, dict[int, int]] = {}
    for r in tokens.groupBy("length_class", "bin").count().collect():  # 201 bins, 15 classes
        counts.setdefault(r["length_class"], {})[r["bin"]] = r["count"]
    last = F.lit(-1000)
    for c, b in thresholds(counts).items():
        last = F.when(F.col("length_class") == c, F.lit(b)).otherwise(last)
    random = written(tokens.where(F.col("bin") <= last).groupBy("a", "b").agg(F.collect_list(F.struct("start", "kind", "end")).alias("random")))
    joined = found.drop("runs").join(random, ["a", "b"], "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return joined.select("doc_id", "a", "b", "base", F.array_sort(F.concat("base", F.coalesce("random", none))).alias("spans"))


def named(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every maximal covered range replaced by the mark."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state, s):
        fresh = F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit(mark))
        joined = (s["start"] < state["at"]) & (state["at"] > 0)
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(joined, state["out"]).otherwise(fresh).alias("out"))

    end = F.aggregate(spans, begin, step)
    rest = F.substring(text, (end["at"] + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) > 0, F.concat(end["out"], rest)).otherwise(text)
