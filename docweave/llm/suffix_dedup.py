"""Remove every byte that lies in a string of `length` bytes which also starts anywhere else in the corpus.

A string start p is judged in three steps.

1. Starts whose `length` bytes have the same least GRAM hash form a run (at most RUN starts). Equal strings have
   equal least hashes, so a run whose hash no other run has holds no repeats and leaves.
2. Runs that are equal as a whole, from their first start to the end of their last string, are repeats at once:
   a count for each distinct run says so, and one of each stands for all of them from here on.
3. The starts of the remaining distinct runs are suffix-sorted, deep-shallow: multikey quicksort over eight-byte
   characters to SHALLOW bytes, then blind tries split the groups that are still open. Neighbours whose common prefix
   reaches `length` are repeats. A task sorts bounded blocks; runs of one hash stay in one block, and hashes
   with over HOT distinct runs are settled by counting 128-bit digests of their strings, summed before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, forget, row_key, slices, text_buffer, written

RUN, SHALLOW, HOT, BLOCK, CHUNK = 256, 16, 2048, 1 << 20, 1 << 20

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(0, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64. Grams that collide only make starts candidates of each other."""
    if n not in _powers:
        _powers[n] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, np.uint64(x))]) for x in (_BASE, pow(_BASE, -1, 2**64)))
    return _powers[n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def runs_of(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For texts data[at[i]:at[i+1]]: least hash, hash of the whole run, first start, number of starts and whether
    the run's surroundings repeat within RUN bytes, for each run."""
    width = min(RUN, max(1, length // 2))
    gram = length - width + 1
    found, n = [], len(data)
    for c in range(0, max(0, n - length + 1), CHUNK):
        part = data[c : c + CHUNK + length - 1]
        if len(part) < length:
            break
        powers = _power(CHUNK + length)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[part] * powers[0][: len(part)])])
        grams = _mixed((sums[gram:] - sums[:-gram]) * powers[1][: len(part) - gram + 1])
        least, step = grams, 1
        while step * 2 <= width:
            least, step = np.minimum(least[:-step], least[step:]), step * 2
        if step < width:
            least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
        starts = len(part) - length + 1
        bad = np.zeros(starts + 1, np.int32)
        ends = at[1:][(at[1:] > c) & (at[:-1] < c + starts)] - c
        first = at[:-1][(at[1:] > c) & (at[:-1] < c + starts)] - c
        np.add.at(bad, np.clip(np.maximum(first, ends - length + 1), 0, starts), 1)
        np.add.at(bad, np.clip(ends, 0, starts), -1)
        p = np.flatnonzero(np.cumsum(bad[:-1]) == 0)
        if not len(p):
            continue
        new = np.r_[True, (np.diff(p) != 1) | (least[p[1:]] != least[p[:-1]])]
        head = np.flatnonzero(new)
        size = np.diff(np.r_[head, len(p)])
        parts = -(-size // RUN)
        begin = np.repeat(p[head], parts) + RUN * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        count = np.minimum(RUN, np.repeat(p[head] + size, parts) - begin)
        stop = begin + count - 1 + length
        text = memoryview(np.ascontiguousarray(part))
        whole = np.fromiter((xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)), np.uint64, len(begin))
        # A run can only repeat inside itself if its text has a short period, and then so has some probed gram.
        space = max(1, width // 2)
        probe = grams[::space]
        near = np.zeros(len(probe), bool)
        for d in range(1, RUN):
            ahead = grams[d::space]
            near[: len(ahead)] |= probe[: len(ahead)] == ahead
        odd = np.flatnonzero(near) * space
        i = np.searchsorted(odd, begin - RUN - length)
        periodic = (i < len(odd)) & (odd[np.minimum(i, max(0, len(odd) - 1))] < stop) if len(odd) else np.zeros(len(begin), bool)
        found.append((least[begin], whole, begin + c, count, periodic))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, bool))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def equal_suffixes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the suffixes share their first `length` bytes with another: deep-shallow sorting to that depth."""
    n, out = len(starts), np.zeros(len(starts), bool)
    if n < 2:
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    order, group, depth = np.arange(n), np.zeros(n, np.int64), 0
    views = np.lib.stride_tricks.sliding_window_view(padded, 8)
    while depth < min(SHALLOW, length) and len(order):  # multikey quicksort, a character being eight bytes
        key = views[starts[order] + depth].copy().view(">u8").ravel().astype(np.uint64)
        if depth + 8 > length:
            key >>= np.uint64(8 * (depth + 8 - length))
        by = np.lexsort((key, group))
        order, key, group = order[by], key[by], group[by]
        new = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])]
        ids = np.cumsum(new) - 1
        keep = np.bincount(ids)[ids] > 1
        order, group, depth = order[keep], ids[keep], depth + 8
    if depth >= length:
        out[order] = True
        return out
    skip = np.full(len(order), depth)
    windows = np.lib.stride_tricks.sliding_window_view(padded, length)
    while len(order):  # blind tries: each open group splits along the path of its first member
        head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[head, len(order)])
        first = np.repeat(starts[order[head]], size)
        common = np.empty(len(order), np.int64)
        for i in range(0, len(order), 16384):
            mine = windows[starts[order[i : i + 16384]]]
            differ = mine != windows[first[i : i + 16384]]
            common[i : i + 16384] = np.where(differ.any(1), differ.argmax(1), length)
        same = common == length
        of = np.repeat(np.arange(len(head)), size)
        out[order[same & (np.bincount(of, same)[of] > 1)]] = True
        rest = ~same
        order, of, skip = order[rest], of[rest], common[rest]
        branch = padded[starts[order] + skip].astype(np.int64)
        by = np.lexsort((branch, skip, of))
        order, of, skip, branch = order[by], of[by], skip[by], branch[by]
        if not len(order):
            break
        new = np.r_[True, (of[1:] != of[:-1]) | (skip[1:] != skip[:-1]) | (branch[1:] != branch[:-1])]
        ids = np.cumsum(new) - 1
        keep = np.bincount(ids)[ids] > 1
        order, group = order[keep], ids[keep]
    return out


def _emit_runs(length: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, "text"):
            data, at = text_buffer(batch.column(2))
            least, whole, begin, count, periodic = runs_of(data, at, length)
            doc = np.searchsorted(at, begin, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(least.view(np.int64)), pa.array(whole.view(np.int64)), batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), pa.array((begin - at[doc]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(periodic)],
                names=["least", "whole", "did", "tc", "p", "n", "periodic"],
            )

    return emit


def _cut_runs(length: int):
    """Rows (did, tc, text, runs) to one row a run with its bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, at = text_buffer(batch.column(2))
            for i, runs in enumerate(batch.column(3).to_pylist()):
                if not runs:
                    continue
                text = data[at[i] : at[i + 1]].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["least"] for r in runs], pa.int64()), pa.array([batch.column(0)[i].as_py()] * len(runs), pa.int64()), pa.array([batch.column(1)[i].as_py()] * len(runs), pa.int64()), pa.array([r["p"] for r in runs], pa.int32()), pa.array([r["n"] for r in runs], pa.int32()), pa.array([r["settled"] for r in runs], pa.bool_()), pa.array([r["hot"] for r in runs], pa.bool_()), pa.array([text[r["p"] : r["p"] + r["n"] - 1 + length] for r in runs], pa.binary())],
                    names=["least", "did", "tc", "p", "n", "settled", "hot", "bytes"],
                )

    return cut


def _sort_runs(length: int):
    def solve(batch: pa.Table) -> pa.RecordBatch:
        data, at = text_buffer(batch.column("bytes"))
        n = batch.column("n").to_numpy()
        of = np.repeat(np.arange(len(n)), n)
        local = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = equal_suffixes(data, at[of] + local, length) & ~batch.column("settled").to_numpy()[of]
        i = np.flatnonzero(hit)
        new = np.r_[True, (np.diff(i) != 1) | (np.diff(of[i]) != 0)] if len(i) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        rows = pa.array(of[i[head]])
        p = batch.column("p").to_numpy()[of[i[head]]] + local[i[head]]
        return pa.RecordBatch.from_arrays([batch.column("did").combine_chunks().take(rows), batch.column("tc").combine_chunks().take(rows), pa.array(p.astype(np.int32)), pa.array(np.diff(np.r_[head, len(i)]).astype(np.int32))], names=["did", "tc", "p", "n"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come ordered by hash; a block ends where a hash ends."""
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            for piece in slices([batch], "bytes", BLOCK // 4):
                held.append(piece)
                size += piece.column(piece.schema.get_field_index("bytes")).nbytes
                if size >= BLOCK:
                    block = pa.Table.from_batches(held)
                    least = block.column("least").to_numpy()
                    cut = int(np.searchsorted(least, least[-1]))
                    if cut:
                        yield solve(block.slice(0, cut))
                        rest = block.slice(cut).combine_chunks()
                        held, size = rest.to_batches(), rest.nbytes
        if held:
            yield solve(pa.Table.from_batches(held))

    return sort


def _digests(length: int):
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [xxhash.xxh3_128_digest(row["bytes"][j : j + length]) for j in range(row["n"])]
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([row["did"]] * n, pa.int64()), pa.array([row["tc"]] * n, pa.int64()), pa.array([row["p"] + j for j in range(n)], pa.int32()), pa.array([row["settled"]] * n, pa.bool_())], names=["digest", "did", "tc", "p", "settled"])

    return digests


def _keep(length: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, at = text_buffer(batch.column(1))
            spans_out, kept_out = [], []
            for i, starts in enumerate(batch.column(2).to_pylist()):
                text = data[at[i] : at[i + 1]].tobytes()
                spans: list[list[int]] = []
                for p, n in sorted((r["p"], r["n"]) for r in starts or ()):
                    end = p + n - 1 + length
                    if spans and p <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([p, end])
                edges = [0, *(x for s in spans for x in s), len(text)]
                kept_out.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if spans else text)
                spans_out.append([{"start": a, "end": b} for a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(spans_out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept_out, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return keep


def suffix_dedup(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for each row of docs (doc_id, text; other columns are ignored).

    spans: maximal removed byte ranges; kept: the remaining bytes. Null texts count as empty, texts shorter than
    `length` keep all, repeated rows repeat each other, a null doc_id is kept, an empty table gives none.
    """
    did, tc = row_key()
    rows = docs.select(did.alias("did"), tc.alias("tc"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    runs = written(rows.select("did", "tc", "text").mapInArrow(_emit_runs(length), "least long, whole long, did long, tc long, p int, n int, periodic boolean"))
    seen = runs.groupBy("least").agg(F.count("*").alias("seen"), F.max("periodic").alias("any_periodic")).where("seen > 1 or any_periodic")
    seen = written(seen.select("least"))
    open_runs = written(runs.join(seen.hint("merge"), "least"))
    dropped(runs)
    one = F.min(F.struct("did", "tc", "p", "n")).alias("one")
    classes = open_runs.groupBy("least", "whole").agg(F.count("*").alias("copies"), one, F.max("periodic").alias("periodic"))
    classes = written(classes)
    several = written(classes.where("copies > 1").select("least", "whole"))
    repeated = open_runs.join(several.hint("merge"), ["least", "whole"]).select("did", "tc", "p", "n")
    mixed = classes.groupBy("least").agg(F.count("*").alias("kinds"), F.max("periodic").alias("any_periodic"), F.max(F.expr("copies = 1")).alias("single"))
    mixed = written(mixed.where("single and (kinds > 1 or any_periodic)").select("least", (F.col("kinds") > HOT).alias("hot")))
    wanted = classes.join(mixed.hint("merge"), "least").select("one.*", F.struct("least", "one.p", "one.n", (F.col("copies") > 1).alias("settled"), "hot").alias("run"))
    wanted = wanted.groupBy("did", "tc").agg(F.collect_list("run").alias("runs"))
    cut = rows.join(wanted, ["did", "tc"]).select("did", "tc", "text", "runs").mapInArrow(_cut_runs(length), "least long, did long, tc long, p int, n int, settled boolean, hot boolean, bytes binary")
    cut = written(cut)
    sorted_runs = cut.where("not hot").select("least", "did", "tc", "p", "n", "settled", "bytes").repartition("least").sortWithinPartitions("least")
    by_sort = sorted_runs.mapInArrow(_sort_runs(length), "did long, tc long, p int, n int")
    strings = cut.where("hot").mapInArrow(_digests(length), "digest binary, did long, tc long, p int, settled boolean")
    counted = written(strings.groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1").select("digest"))
    by_count = strings.where("not settled").join(counted.hint("merge"), "digest").select("did", "tc", "p", F.lit(1).alias("n"))
    starts = repeated.union(by_sort).union(by_count).groupBy("did", "tc").agg(F.collect_list(F.struct("p", "n")).alias("starts"))
    found = rows.join(starts, ["did", "tc"], "left").select("doc_id", "text", "starts")
    return found.mapInArrow(_keep(length), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
