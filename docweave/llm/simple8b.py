"""Token ids in Simple-8b: 64-bit words whose upper four bits select how many ids of how many bits the rest holds.

A file row is a block of whole documents in ascending doc_id order: first place, ids and words of each document, the
packed words and the escaped ids. No word crosses documents. Blocks lie in shards of ascending doc_id ranges; every
block decodes by itself, and by the counts of words so does every document in it. Texts are dealt out before they are
encoded: here packed ids take as many bytes as the text, and encoding first would have to be written once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, text_buffer, written
from .tokens import SLICE, words

#: Ids and bits by selector 0 to 13; selectors 0 and 1 stand for runs of zero.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: A word 15 << 60 | ESCAPE says that the id, of over 60 bits (or ESCAPE itself), is the next of the block's escapes.
ESCAPE = (1 << 60) - 1
BLOCK_IDS = 1 << 16


def packed(ids: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and escapes of unsigned 64-bit ids; no word crosses the places `at` (n + 1, or the whole array's two ends),
    and each part's words and escapes begin at the places returned with them."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    at = np.array([0, n]) if at is None else at
    left = np.repeat(at[1:].astype(np.int32), np.diff(at)) - np.arange(n, dtype=np.int32)
    big = ids >= np.uint64(ESCAPE)
    escapes, small = ids[big], np.where(big, np.uint64(ESCAPE), ids)
    choice = np.full(n, 15, np.int8)
    fit, value = np.arange(n, dtype=np.int32), small
    for s in range(14, -1, -1):  # the widest ids first; what fits more ids a word replaces it
        fits = value < np.uint64(1 << int(BITS[s])) if BITS[s] else value == 0
        if not fits.all():
            fit, value = fit[fits], value[fits]
        c = int(COUNTS[s])
        if len(fit) >= c:  # c places in a row that all fit and lie in one part
            head = fit[: len(fit) - c + 1]
            choice[head[(fit[c - 1 :] - head == c - 1) & (left[head] >= c)]] = s
    step = (np.arange(n) + COUNTS[choice]).tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i = step[i]
    begin = np.array(starts, np.int64)
    chosen = choice[begin]
    out = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(2, 16):
        rows = np.flatnonzero(chosen == s)
        if len(rows):
            word = np.zeros(len(rows), np.uint64)
            for k in range(int(COUNTS[s])):
                word |= small[begin[rows] + k] << np.uint64(k * int(BITS[s]))
            out[rows] |= word
    return out, escapes, np.searchsorted(begin, at), np.searchsorted(np.flatnonzero(big), at)


def unpacked(packed_words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    chosen = (packed_words >> np.uint64(60)).astype(np.int64)
    sizes = COUNTS[chosen]
    at = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint64)
    for s in range(2, 16):
        rows = np.flatnonzero(chosen == s)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(int(COUNTS[s]) if len(rows) else 0):
            out[at[rows] + k] = (packed_words[rows] >> np.uint64(k * int(BITS[s]))) & mask
    out[out == np.uint64(ESCAPE)] = escapes
    return out


def _cells(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary array of the parts of 64-bit values."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((8 * at).astype(np.int64)), pa.py_buffer(values.astype("<u8"))]).cast(pa.binary())


def _blocks(path: str, end_id: int):
    """Texts in order to blocks of BLOCK_IDS ids or a little more."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = words(path)
        held: list[pa.RecordBatch] = []
        start = number = size = 0

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            column = lambda c: rows.column(c).combine_chunks()
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            (data, at), (escapes, _) = text_buffer(column("words")), text_buffer(column("escapes"))
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([start]), pa.array([size], pa.int64()), one(column("doc_id")), one(column("count")), one(pa.array(np.diff(at) // 8)), pa.array([data.tobytes()], pa.binary()), pa.array([escapes.tobytes()], pa.binary())], names=["block", "shard_start", "n_ids", "doc_ids", "counts", "spots", "words", "escapes"])

        for batch in slices(batches, "text", SLICE):
            ids, at = encoder.batch(batch.column(1), end_id)
            values, escapes, value_at, escape_at = packed(ids, at)
            docs = pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), _cells(values, value_at), _cells(escapes, escape_at)], names=["doc_id", "count", "words", "escapes"])
            while docs.num_rows:
                sums = np.cumsum(docs.column(1).to_numpy())
                n = min(docs.num_rows, int(np.searchsorted(sums, BLOCK_IDS - size)) + 1)
                held.append(docs.slice(0, n))
                size += int(sums[n - 1])
                docs = docs.slice(n)
                if size >= BLOCK_IDS:
                    yield block()
                    held, start, number, size = [], start + size, number + 1, 0
        if held:
            yield block()

    return blocks


BLOCK_SCHEMA = "block long, shard_start long, n_ids long, doc_ids array<long>, counts array<long>, spots array<long>, words binary, escapes binary"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Encode docs (doc_id, text; other columns are ignored), write the file and return its blocks as read back.

    Null texts are empty, each document ends with end_id, null doc_ids come first, rows that tie are ordered by text;
    repeated rows are written each, an empty table gives no blocks. counts are ids, spots words of each document.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(dealt.mapInArrow(_blocks(tokenizer, end_id), BLOCK_SCHEMA).withColumn("shard", F.spark_partition_id()))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids = unpacked(np.frombuffer(batch.column(4)[i].as_py(), "<u8"), np.frombuffer(batch.column(5)[i].as_py(), "<u8")).astype("<u4")
            counts = np.array(batch.column(3)[i].as_py(), np.int64)
            at = np.cumsum(counts) - counts
            parts = [ids[a : a + n].tobytes() for a, n in zip(at.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(counts), np.int64))), batch.column(2)[i].values, pa.array(at + batch.column(1)[i].as_py()), pa.array(counts), pa.array(parts, pa.binary())],
                names=["shard", "doc_id", "place", "n_tokens", "ids"],
            )


def read_tokens(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document; ids: little-endian unsigned 32-bit integers."""
    docs = blocks.select("shard", "shard_start", "doc_ids", "counts", "words", "escapes").mapInArrow(_decode, "shard int, doc_id long, place long, n_tokens long, ids binary")
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # one row a shard
    return docs.join(F.broadcast(starts), "shard").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids")
