"""Phrase collocations by pivot partitioning of text fragments.

1. Words are counted by language, exactly. A fixed-size table of counts by hash (BUCKETS numbers, however many words
   there are) goes to every task: a word's bucket bounds its count from above and, with the word's hash, orders words by
   rarity in the same way everywhere.
2. A task rewrites its texts: words whose bucket is below the least count end a fragment, as pieces' ends do. The
   pivot of an n-gram is its rarest word, of equal ones the leftmost. Each word is routed with what it is the pivot of: up to
   LONGEST - 1 words before it that are less rare, and after it that aren't rarer. Equal fragments of a
   task are counted, those of one pivot travel as one text.
3. A task mines the fragments of its pivots alone, all n-grams that hold the pivot, so each n-gram has one owner.
   Pivots that are frequent are dealt to several tasks, whose counts are summed; counts of undivided pivots below the least
   leave at once.
4. Cuts, scores and containment are joins of the frequent n-grams with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, slices, text_buffer, written
from .decontaminate import _mixed, hashes_at, word_places

LONGEST = 4
BUCKETS = 1 << 20
#: Occurrences of a pivot for each task that mines it.
SHARE = 1 << 17
#: Words that a task counts together (a quarter of them where it makes fragments, which take more memory a word), and bytes of fragments that it mines together.
GATHERED, MINED = 1 << 20, 1 << 23
#: Ranges by hash of which each gives a language's first rows before the last ranking.
RANKED = 64
_BREAK = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t", np.uint8))
_LETTER = ~(_BREAK | _SPACE)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings data[starts[i]:ends[i]]."""
    size = ends - starts
    at = np.cumsum(np.r_[0, size])
    flat = data[np.repeat(starts - at[:-1], size) + np.arange(at[-1])]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(flat.tobytes())).cast(pa.string())


def _coded(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense numbers of the rows of integer columns (each below 2**31, from -1), and a row for each number."""
    code = columns[0].astype(np.int64)
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    for c in columns[1:]:
        _, first, code = np.unique((code << 32) + c + 1, return_index=True, return_inverse=True)
    return code, first


class Held:
    """Words of texts in order, with the piece of text and the language that each is of."""

    def __init__(self):
        self.words, self.hashes, self.pieces, self.langs, self.size, self.piece = [], [], [], [], 0, 0

    def add(self, data: np.ndarray, at: np.ndarray, langs: np.ndarray) -> None:
        starts, ends, begin = word_places(data, at, _LETTER)
        text = np.repeat(np.arange(len(at) - 1), np.diff(begin))
        cut = np.cumsum(np.r_[0, _BREAK[data]])[starts] + text  # a number that grows at every end of a piece
        self.words.append(_strings(_LOWER[data], starts, ends))
        self.hashes.append(hashes_at(data, starts, ends))
        self.pieces.append(cut + self.piece)
        self.langs.append(langs[text])
        self.piece += int(cut[-1]) + 1 if len(cut) else 0
        self.size += len(starts)

    def taken(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        out = (pa.concat_arrays(self.words), np.concatenate(self.hashes), np.concatenate(self.pieces), np.concatenate(self.langs))
        self.__init__()
        return out


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple]:
    """(words, hashes, pieces, language numbers, languages) of about `most` words each, from rows (lang, text)."""
    held, langs = Held(), {}
    for batch in slices(batches, "text"):
        column = batch.column(0).to_pylist()
        for lang in column:
            langs.setdefault(lang, len(langs))
        data, at = text_buffer(batch.column(1))
        held.add(data, at, np.array([langs[x] for x in column]))
        if held.size >= most:
            yield (*held.taken(), list(langs))
    if held.size:
        yield (*held.taken(), list(langs))


def _lang_hashes(langs: list[str]) -> np.ndarray:
    data = "".join(langs).encode()
    ends = np.cumsum([len(x.encode()) for x in langs])
    return hashes_at(np.frombuffer(data, np.uint8), np.r_[0, ends[:-1]], ends, 3)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to (lang, phrase, bucket, n)."""
    forget()
    for words, hashes, _, lang, langs in _gathered(batches, GATHERED):
        coded = words.dictionary_encode()
        code, first = _coded(lang, coded.indices.to_numpy(zero_copy_only=False))
        mark = _mixed(hashes[first] + _lang_hashes(langs)[lang[first]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs).take(pa.array(lang[first])), words.take(pa.array(first)), pa.array((mark % np.uint64(BUCKETS)).astype(np.int32)), pa.array(np.bincount(code, minlength=len(first)))], names=["lang", "phrase", "bucket", "n"]
        )


def _fragments(shared, least: int):
    """Rows (lang, text) to (lang, pivot, share, shares, lines): a line is `words before TAB words after TAB count`."""

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, part = shared.value, TaskContext.get().partitionId()
        for turn, (words, hashes, pieces, lang, langs) in enumerate(_gathered(batches, GATHERED // 4)):
            mark = _mixed(hashes + _lang_hashes(langs)[lang])
            often = counts[(mark % np.uint64(BUCKETS)).astype(np.int64)]
            good = np.flatnonzero(often >= least)
            if not len(good):
                continue
            # Pieces are told apart by their number, words left out by a gap in it.
            pieces = pieces[good] + np.cumsum(np.r_[0, np.diff(good) != 1])
            coded = words.take(pa.array(good)).dictionary_encode()
            code, first = _coded(lang[good], coded.indices.to_numpy(zero_copy_only=False))
            often, mark = often[good], mark[good]
            order = np.empty(len(first), np.int64)
            text = coded.dictionary.take(pa.array(coded.indices.to_numpy(zero_copy_only=False)[first]))
            # Rarest first; words of one bucket and one hash are told apart by their letters.
            by_letters = np.empty(len(first), np.int64)
            by_letters[pc.sort_indices(text).to_numpy()] = np.arange(len(first))
            order[np.lexsort((by_letters, mark[first], often[first]))] = np.arange(len(first))
            rank = order[code]
            n = len(rank)
            around = np.full((n, 2 * LONGEST - 2), -1, np.int64)
            for side, low in ((-1, 1), (1, 0)):  # before the pivot only less rare words, after it also the pivot itself
                open_ = np.ones(n, bool)
                for step in range(1, LONGEST):
                    at = np.arange(n) + side * step
                    inside = (at >= 0) & (at < n)
                    at = np.clip(at, 0, n - 1)
                    open_ = open_ & inside & (pieces[at] == pieces) & (rank[at] >= rank + low)
                    column = LONGEST - 1 - step if side < 0 else LONGEST - 2 + step
                    around[open_, column] = code[at[open_]]
            some = np.flatnonzero((around[:, LONGEST - 2] >= 0) | (around[:, LONGEST - 1] >= 0))
            if not len(some):
                continue
            around, pivot = around[some], code[some]
            group, head = _coded(pivot, *around.T)
            times = np.bincount(group, minlength=len(head))
            pivot, around = pivot[head], around[head]  # ordered by pivot
            names = pa.concat_arrays([text, pa.array([""])])

            def joined(columns: range, around: np.ndarray = around, names: pa.Array = names) -> pa.Array:
                parts = [names.take(pa.array(np.where(around[:, c] < 0, len(names) - 1, around[:, c]))) for c in columns]
                return pc.utf8_trim(pc.binary_join_element_wise(*parts, " "), " ")

            lines = pc.binary_join_element_wise(joined(range(LONGEST - 1)), joined(range(LONGEST - 1, 2 * LONGEST - 2)), pa.array(times).cast(pa.string()), "\t")
            start = np.flatnonzero(np.r_[True, np.diff(pivot) != 0])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[start, len(pivot)], pa.int32()), lines)
            owner = pivot[start]
            shares = 1 + often[first][owner] // SHARE
            share = (part + 7919 * turn) % shares
            lang_of = pa.array(langs).take(pa.array(lang[good][first][owner]))
            yield pa.RecordBatch.from_arrays([lang_of, text.take(pa.array(owner)), pa.array(share), pa.array(shares), pc.binary_join(lists, "\n")], names=["lang", "pivot", "share", "shares", "lines"])

    return fragments


def _mined(least: int):
    """Rows (lang, pivot, share, shares, lines), ordered, to (lang, phrase, n)."""

    def of(rows: list[tuple], whole: list[bool]) -> pa.RecordBatch | None:
        """rows: (group, lang, pivot, lines); whole: whether all rows of a group are here."""
        blob = pa.array([r[3] for r in rows], pa.large_string())
        lists = pc.split_pattern(blob, "\n")
        group = np.repeat(np.array([r[0] for r in rows]), pc.list_value_length(lists).to_numpy())
        fields = pc.split_pattern(lists.flatten(), "\t").flatten()
        n = len(group)
        column = lambda i: fields.take(pa.array(np.arange(n) * 3 + i))
        times = column(2).cast(pa.int64()).to_numpy()
        place = np.full((n, 2 * LONGEST - 2), -1, np.int64)
        sides = [pc.split_pattern(column(i), " ") for i in (0, 1)]
        flat = pa.chunked_array([x.flatten() for x in sides]).combine_chunks().dictionary_encode()
        codes, used, empty = flat.indices.to_numpy(zero_copy_only=False), 0, flat.dictionary.index(pa.scalar("", flat.dictionary.type)).as_py()
        for side, parts in enumerate(sides):
            size = pc.list_value_length(parts).to_numpy().astype(np.int64)
            at = np.cumsum(size) - size + used
            used += int(size.sum())
            for k in range(LONGEST - 1):
                has = np.flatnonzero(size > k)
                word = codes[at[has] + (size[has] - 1 - k if side == 0 else k)]
                place[has, LONGEST - 2 - k if side == 0 else LONGEST - 1 + k] = np.where(word == empty, -1, word)
        names = flat.dictionary.cast(pa.string())
        pivots = pa.array([r[2] for r in rows])
        langs = pa.array([r[1] for r in rows])
        row_of = {}
        for i, r in enumerate(rows):
            row_of.setdefault(r[0], i)
        complete = np.zeros(max(row_of) + 1, bool)
        complete[list(row_of)] = [whole[i] for i in row_of.values()]
        first_row = np.zeros(max(row_of) + 1, np.int64)
        first_row[list(row_of)] = list(row_of.values())
        out = []
        for a in range(LONGEST):
            for b in range(LONGEST - a):
                if a + b == 0:
                    continue
                words = list(range(LONGEST - 1 - a, LONGEST - 1)), list(range(LONGEST - 1, LONGEST - 1 + b))
                both = words[0] + words[1]
                have = np.flatnonzero((place[:, both] >= 0).all(1))
                if not len(have):
                    continue
                code, first = _coded(group[have], *(place[have, c] for c in both))
                total = np.zeros(len(first), np.int64)
                np.add.at(total, code, times[have])
                owner = group[have[first]]
                keep = np.flatnonzero((total >= least) | ~complete[owner])
                if not len(keep):
                    continue
                rows_at = have[first[keep]]
                source = first_row[owner[keep]]
                parts = [*(names.take(pa.array(place[rows_at, c])) for c in words[0]), pivots.take(pa.array(source)), *(names.take(pa.array(place[rows_at, c])) for c in words[1])]
                out.append((langs.take(pa.array(source)), pc.binary_join_element_wise(*parts, " "), pa.array(total[keep])))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.concat_arrays([o[i] for o in out]) for i in range(3)], names=["lang", "phrase", "n"])

    def mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        rows, size, key, number, cut = [], 0, None, 0, set()
        for batch in batches:
            for lang, pivot, share, shares, lines in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (lang, pivot, share) != key:
                    if size >= MINED:
                        done = of(rows, [r[0] not in cut for r in rows])
                        if done is not None:
                            yield done
                        rows, size, number, cut = [], 0, 0, set()
                    key, number = (lang, pivot, share), number + 1
                elif size >= 2 * MINED:  # a long group is mined in pieces, whose counts are summed later
                    cut.add(number)
                    done = of(rows, [r[0] not in cut for r in rows])
                    if done is not None:
                        yield done
                    rows, size, number = [], 0, 1
                    cut = {1}
                if shares > 1:
                    cut.add(number)
                rows.append((number, lang, pivot, lines))
                size += len(lines)
        if rows:
            done = of(rows, [r[0] not in cut for r in rows])
            if done is not None:
                yield done

    return mined


def frequent(docs: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f), (lang, n)): written tables of all phrases of 1 to LONGEST words that occur `least` times
    or more within pieces of a language's texts, and of its word occurrences.

    docs: (lang, text; others are ignored). Null texts are empty, a null lang is `und`, repeated rows count each.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where("text is not null")
    counts = texts.mapInArrow(_word_counts, "lang string, phrase string, bucket int, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"), F.first("bucket").alias("bucket"))
    counts = written(counts)
    sums = counts.groupBy("bucket").agg(F.sum("f").alias("f")).toArrow()  # at most BUCKETS rows
    table = np.zeros(BUCKETS, np.int64)
    table[sums.column("bucket").to_numpy()] = sums.column("f").to_numpy()
    shared = spark.sparkContext.broadcast(table)
    routed = texts.mapInArrow(_fragments(shared, least), "lang string, pivot string, share long, shares long, lines string")
    dealt = routed.repartition("lang", "pivot", "share").sortWithinPartitions("lang", "pivot", "share")
    mined = dealt.mapInArrow(_mined(least), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    words = F.size(F.split("phrase", " "))
    single = counts.where(F.col("f") >= least).select("lang", "phrase", F.lit(1).alias("words"), "f")
    several = mined.where(F.col("f") >= least).select("lang", "phrase", words.alias("words"), "f")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    return written(several.union(single)), totals


def collocations(docs: DataFrame, least: int = 30, scale: int = 2_000_000, cover: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to LONGEST words.

    a: occurrences, `least` or more; l and r: those of the two parts of the cut of lowest score floor(scale * a / (l + r)), of
    equal ones after fewest words; n: the language's word occurrences. Phrases that lie in a longer frequent one of cover
    percent of their occurrences or more are left out. Ordered by score and a, descending, then phrase by UTF-8
    bytes. Null and empty texts have no words, a null lang is `und`, an empty table gives no rows.
    """
    grams, totals = frequent(docs, least)
    phrases = grams.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    part = lambda a, b: F.array_join(F.slice(F.split("phrase", " "), a, b), " ")
    cuts = phrases.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.withColumn("first", part(F.lit(1), F.col("k"))).withColumn("rest", part(F.col("k") + 1, F.col("words") - F.col("k")))
    side = lambda name, f: grams.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumn("both", wide("l") + wide("r")).withColumn("scaled", wide("a") * F.lit(scale).cast("decimal(10,0)"))
    cuts = cuts.withColumn("score", F.expr("scaled div both"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = phrases.where("words > 2").withColumn("size", F.explode(F.expr("sequence(2, words - 1)"))).withColumn("at", F.explode(F.expr("sequence(1, words - size + 1)")))
    inside = inside.select("lang", part(F.col("at"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * cover))
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # A language may hold most phrases: each range by hash ranks its own first.
    ranged = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANKED))).orderBy(*order)
    few = rows.withColumn("place", F.row_number().over(ranged)).where(F.col("place") <= top).drop("place")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
