"""Best-fit decreasing packing of token pieces into sequences.

Each document is first cut into full windows and a rest; the pieces, long before short, go each to the open
sequence with the least remaining capacity that holds it, which a segment tree over capacities finds.
Pieces are dealt by hash to groups of about GROUP pieces that are packed apart, so no task holds more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .tokens import SLICE, words

GROUP = 20_000


class Capacities:
    """Segment tree: how many open sequences have each remaining capacity from 0 to top."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = self.leaves + capacity
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity of an open sequence that is at least `need`; -1 if there is none."""
        i, count = self.leaves + need, self.count
        if count[i]:
            return need
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; lengths are 1 to window, in any order."""
    tree, stacks = Capacities(window), [[] for _ in range(window + 1)]
    sequence, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room = tree.tightest(n)
        if room < 0:
            s, room, made = made, window, made + 1
        else:
            s = stacks[room].pop()
            tree.add(room, -1)
        sequence[i], offset[i] = s, window - room
        if room > n:
            stacks[room - n].append(s)
            tree.add(room - n, 1)
    return sequence, offset


def _cut(path: str, end_id: int, window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = words(path)
        for batch in slices(batches, "text", SLICE):
            ids, at = encoder.batch(batch.column(2), end_id)
            total = np.diff(at)
            pieces = -(-total // window)
            doc = np.repeat(np.arange(batch.num_rows), pieces)
            start = window * (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            length = np.minimum(window, total[doc] - start)
            raw, first = memoryview(ids.astype("<u4").tobytes()), 4 * (at[doc] + start)
            crc = [zlib.crc32(raw[a : a + n]) for a, n in zip(first.tolist(), (4 * length).tolist(), strict=True)]
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[doc])], names=["doc_id", "key", "start", "length", "ids_crc32", "doc_tokens"])

    return cut


def _pack(window: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come ordered by group; groups are bounded by their number."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                groups = batch.column(0).to_numpy()
                last = groups[0]
                n = int(np.searchsorted(groups, last, "right"))
                if held and held[0].column(0)[0].as_py() != last:
                    yield solve(held)
                    held = []
                held.append(batch.slice(0, n))
                batch = batch.slice(n)
        if held:
            yield solve(held)

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        sequence, offset = best_fit(rows.column("length").to_numpy(), window)
        base = rows.column("group")[0].as_py() << 40
        cols = [rows.column(c).combine_chunks() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
        return pa.RecordBatch.from_arrays([*cols, pa.array(sequence + base), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048) -> DataFrame:
    """A row for each piece of docs (doc_id, text; other columns are ignored).

    Null texts are empty and consist of end_id alone; repeated rows are packed each; a null doc_id is kept; an empty
    table gives no rows. sequence_id is the group in the upper bits and the group's own count in the lower 40.
    """
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = written(rows.mapInArrow(_cut(tokenizer, end_id, window), "doc_id long, key long, start long, length long, ids_crc32 long, doc_tokens long"))
    groups = max(1, round(pieces.count() / GROUP))
    # The row number of the written table tells repeated rows apart, which else would meet in one group.
    pieces = pieces.withColumn("copy", F.monotonically_increasing_id())
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("key", "start", "copy"), F.lit(groups))).select("group", "key", "doc_id", "start", "length", "ids_crc32", "doc_tokens")
    dealt = dealt.repartition("group").sortWithinPartitions("group", "key", "start")
    return dealt.mapInArrow(_pack(window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
