"""Benchmark decontamination by winnowing.

Texts become sequences of 64-bit word hashes. Of every WINDOW consecutive hashes of GRAM words the least is kept, on
both sides, so a shared span of GRAM + WINDOW - 1 = 13 words always shares a kept hash.

1. The benchmark becomes a table of prints: kept hashes, hashes of its 13-word windows by item, and of items of fewer
   words as a whole.
2. One pass over the documents gives each row's number of words, and its kept hashes with the 13-word windows that hold
   them. A bitmap of BITS bits, of that size however large the benchmark is, keeps most foreign hashes out of the shuffle.
3. Kept hashes of both sides are joined, and each hit is extended to the windows around it: those that equal a window of
   the benchmark are hits, found by a second join. Items of fewer words go straight to that one. Both joins are of
   plain shuffled tables, so adaptive execution can split a hash that many rows share.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, row_key, slices, text_buffer, written

SPAN, GRAM = 13, 9
WINDOW = SPAN - GRAM + 1
#: Size of the bitmap; a larger benchmark only lets more through to the join.
BITS = 1 << 25

_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of more bytes are hashed one by one by xxh3.
LONG = 64


@functools.cache
def _factors(k: int, seed: int = 0) -> np.ndarray:
    """Odd random factors of a gram's places."""
    return np.random.default_rng([7, seed]).integers(0, 2**64, k, np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_places(data: np.ndarray, at: np.ndarray, letters: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the texts data[at[i]:at[i+1]], and the n + 1 places where each text's words begin."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = letters[data]
    edge = np.diff(inside.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts + 1]])  # words don't cross texts
    starts, ends = np.sort(np.r_[starts, cuts]), np.sort(np.r_[ends, cuts])
    return starts, ends, np.searchsorted(starts, at)


def hashes_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte strings data[starts[i]:ends[i]], A-Z lower-cased: eight bytes after eight are mixed into
    the state, so no arrangement of the letters cancels out, whatever its length; long words go to xxh3."""
    low = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", low, strides=(1,))
    size = ends - starts
    state = _mixed(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _factors(1, seed))
    which = np.flatnonzero(size <= LONG)
    done = 0
    while len(which):
        left = np.minimum(size[which] - done, 8)
        part = eight[starts[which] + done] & (np.uint64(2**64 - 1) >> ((8 - left).astype(np.uint64) * np.uint64(8)))
        state[which] = _mixed(_mixed(state[which] + part) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(done + 1))
        done += 8
        which = which[size[which] > done]
    text = memoryview(low)
    for i in np.flatnonzero(size > LONG).tolist():
        state[i] = xxhash.xxh3_64_intdigest(text[starts[i] : ends[i]], seed)
    return state


def word_hashes(data: np.ndarray, at: np.ndarray, letters: np.ndarray = _WORD, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[at[i]:at[i+1]], and the n + 1 places where each text's words begin."""
    starts, ends, begin = word_places(data, at, letters)
    return hashes_at(data, starts, ends, seed), begin


def gram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all k consecutive words: their sum by a random odd factor for each place."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    factors = _factors(k, seed)
    total = words[:n] * factors[0]
    for i in range(1, k):
        total += words[i : i + n] * factors[i]
    return _mixed(total)


def winnowed(grams: np.ndarray) -> np.ndarray:
    """Places of the least hash of every WINDOW consecutive ones (of equal ones the first of a window)."""
    if len(grams) < WINDOW:
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    return np.unique(windows.argmin(1) + np.arange(len(windows)))


def _benchmark_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items to rows (kind, h, item): kind 0 is a kept hash, another kind the number of words that h is made of."""
    for batch in slices(batches, "text"):
        words, begin = word_hashes(*text_buffer(batch.column(1)))
        ids = batch.column(0)
        kinds, hashes, items = [], [], []
        grams, spans = gram_hashes(words, GRAM), gram_hashes(words, SPAN)
        kept = winnowed(grams)
        for i, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
            if b - a >= SPAN:
                mine = np.unique(grams[kept[(kept >= a) & (kept + GRAM <= b)]])
                whole = np.unique(spans[a : b - SPAN + 1])
                kinds += [np.zeros(len(mine), np.int32), np.full(len(whole), SPAN, np.int32)]
                hashes += [mine, whole]
                items += [np.full(len(mine) + len(whole), i)]
            elif b > a:
                kinds.append(np.array([b - a], np.int32))
                hashes.append(gram_hashes(words[a:b], b - a))
                items.append(np.array([i]))
        if kinds:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds)), pa.array(np.concatenate(hashes).view(np.int64)), ids.take(pa.array(np.concatenate(items)))], names=["kind", "h", "item"])


def _document_prints(shared, short: list[int]):
    """Rows to (doc_id, a, b, kind, print, h, at): kind -1 has the number of words in at; kind SPAN is a window h at word
    `at` around the kept hash `print`; a smaller kind is so many words at `at`."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        bitmap = shared.value
        mask = np.uint64(BITS - 1)

        def known(h: np.ndarray) -> np.ndarray:
            spot = h & mask
            return (bitmap[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)

        for batch in slices(batches, "text"):
            words, begin = word_hashes(*text_buffer(batch.column(3)))
            n = batch.num_rows
            rows, kinds, kept_h, hashes, at = [np.arange(n)], [np.full(n, -1)], [np.zeros(n, np.uint64)], [np.zeros(n, np.uint64)], [np.diff(begin)]

            def add(kind: int, places: np.ndarray, of: np.ndarray, kept: np.ndarray, h: np.ndarray) -> None:
                rows.append(of), kinds.append(np.full(len(of), kind)), kept_h.append(kept), hashes.append(h), at.append(places - begin[of])  # noqa: B023

            grams = gram_hashes(words, GRAM)
            # A window that crosses two texts keeps no more than it should, and one inside a text keeps its own least.
            kept = winnowed(grams)
            kept = kept[known(grams[kept])]
            of = np.searchsorted(begin, kept, "right") - 1
            inside = kept + GRAM <= begin[of + 1]
            kept, of = kept[inside], of[inside]
            if len(kept):
                around = kept[:, None] - np.arange(WINDOW)
                good = (around >= begin[of][:, None]) & (around + SPAN <= begin[of + 1][:, None])
                which = np.nonzero(good)[0]
                around = around[good]
                add(SPAN, around, of[which], grams[kept][which], gram_hashes(words, SPAN)[around])
            for k in short:
                grams_k = gram_hashes(words, k)
                places = np.flatnonzero(known(grams_k))
                of = np.searchsorted(begin, places, "right") - 1
                inside = places + k <= begin[of + 1]
                places, of = places[inside], of[inside]
                add(k, places, of, np.zeros(len(of), np.uint64), grams_k[places])
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(take) for i in range(3)), pa.array(np.concatenate(kinds).astype(np.int32)), *(pa.array(np.concatenate(x).view(np.int64)) for x in (kept_h, hashes)), pa.array(np.concatenate(at))],
                names=["doc_id", "a", "b", "kind", "print", "h", "at"],
            )

    return prints


def _bitmap(prints: DataFrame) -> np.ndarray:
    """BITS bits in which every kept hash and every short item's has its bit: at most BITS / 64 rows are gathered."""
    spot = F.col("h").bitwiseAND(BITS - 1)
    found = prints.where(F.col("kind") != SPAN).select(F.shiftright(spot, 6).alias("i"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("i").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(max(1, BITS // 64), np.uint64)
    out[found.column("i").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, a, b, n_words, n_hit, hits, items) for each row of docs (doc_id, text; others are ignored); a and b are its row_key().

    hits: maximal ranges of hit words, n_hit their words; items: ids of the items found, sorted as strings. Null and
    empty texts have no words, items without words or id are never found, repeated rows count each, an empty benchmark
    finds nothing, an empty table gives no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null and text is not null")
    prints = written(items.mapInArrow(_benchmark_prints, "kind int, h long, item string"))
    short = sorted(r["kind"] for r in prints.where(F.col("kind").between(1, SPAN - 1)).select("kind").distinct().collect())  # at most 12
    a, b = row_key()
    rows = docs.select("doc_id", a.alias("a"), b.alias("b"), F.coalesce("text", F.lit("")).alias("text"))
    shared = spark.sparkContext.broadcast(_bitmap(prints))  # of BITS bits
    found = written(rows.mapInArrow(_document_prints(shared, short), "doc_id long, a long, b long, kind int, print long, h long, at long"))
    kept = prints.where("kind = 0").select(F.col("h").alias("print")).distinct()
    near = found.where(F.col("kind") == SPAN).join(kept, "print", "left_semi")
    windows = written(near.union(found.where(F.col("kind").between(1, SPAN - 1)).select(near.columns)).select("a", "b", "kind", "h", "at").distinct())
    hits = written(windows.join(prints.where("kind > 0"), ["kind", "h"]).select("a", "b", "at", (F.col("at") + F.col("kind")).alias("end"), "item"))
    order = Window.partitionBy("a", "b").orderBy("at", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("a", "b", "at", "end").distinct().withColumn("before", F.max("end").over(order))
    new = F.col("before").isNull() | (F.col("at") > F.col("before"))
    island = F.sum(new.cast("int")).over(Window.partitionBy("a", "b").orderBy("at", "end"))
    spans = spans.withColumn("island", island).groupBy("a", "b", "island").agg(F.min("at").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("a", "b").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("hits"))
    named = hits.select("a", "b", "item").distinct().groupBy("a", "b").agg(F.array_sort(F.collect_list("item")).alias("items"))
    both = written(spans.join(named, ["a", "b"]))
    base = found.where("kind = -1").select("doc_id", "a", "b", F.col("at").alias("n_words"))
    none = lambda kind: F.array().cast(kind)
    joined = base.join(both, ["a", "b"], "left")
    return joined.select("doc_id", "a", "b", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("hits", none("array<struct<start:bigint,end:bigint>>")).alias("hits"), F.coalesce("items", none("array<string>")).alias("items"))
