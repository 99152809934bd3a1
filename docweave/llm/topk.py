"""Exact top-k inner products by multi-resolution segment statistics.

Cut a vector into segments and keep each segment's mean and deviation: over a segment of n components, q . x is at
most n * (mean_q * mean_x + dev_q * dev_x), so that |q|^2 + |x|^2 - 2 * (sum of those) is a lower bound of the
squared distance and the sum an upper bound of the score. A task holds one block of queries and one block of rows,
bounds their pairs coarse to fine (1 segment, then an eighth and half as many as there are components) and computes the
scores of what is left. A level that let over nine in ten of the pairs through in the part before isn't asked for the next
part, so where nothing can be pruned the work is that of the scores. What a query's k-th best score must reach comes
from the first block of rows, which all of its queries meet first, and rises while the other blocks are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

QUERY_BLOCK, ROW_BLOCK, PART = 2048, 4096, 1024
#: Most shuffle partitions of a join; beyond so many pairs of blocks a task takes several, one after another.
MOST_TASKS = 50_000
#: Share of pairs from which on a level or the scores are computed for all pairs at once.
DENSE = 0.1


def levels_of(width: int) -> list[int]:
    """Numbers of segments, coarse to fine."""
    return sorted({1, width // 8, width // 2} - {0, width})


def quantized(embedding: str, scale: int = 64) -> Column:
    """floor(scale * x) of each component, or null where the vector or a component is null or not finite."""
    e = F.col(embedding)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(e.isNotNull() & (F.size(e) > 0) & fine, F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def segment_stats(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, both times the square root of its length: their product bounds x . y."""
    parts = np.array_split(x, segments, axis=1)
    mean = np.stack([p.mean(1) * np.sqrt(p.shape[1]) for p in parts], 1)
    dev = np.stack([p.std(1) * np.sqrt(p.shape[1]) for p in parts], 1)
    return np.concatenate([mean, dev], 1)


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, floor: np.ndarray | None = None, seen: dict[int, list[int]] | None = None) -> Iterator[tuple[int, int, int]]:
    """(query position, row id, score) of each query's k best rows here that reach floor, ties to smaller ids.

    floor: what the k-th best score of each query is known to reach. seen, if given, gets the pairs that each level was
    asked for and let through, and at the vectors' width those whose scores were computed and kept.
    """
    width = max(queries.shape[1], rows.shape[1])
    wide = lambda a: np.pad(a, ((0, 0), (0, width - a.shape[1])))
    queries, rows = wide(queries), wide(rows)
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * width
    exact = queries.dtype != object and rows.dtype != object and most < 2**53
    q, x = queries.astype(float), rows.astype(float)
    stats = {s: (segment_stats(q, s), segment_stats(x, s)) for s in levels_of(width)}
    useful, slack = dict.fromkeys(stats, True), 1e-9 * most + 1e-6
    floor = np.full(len(q), -np.inf) if floor is None else floor.astype(float)
    scores = np.full((len(q), k), -np.inf)
    found_q, found_x, found_s = [], [], []

    def asked(u: np.ndarray, v: np.ndarray, left: np.ndarray | None, need: np.ndarray) -> np.ndarray:
        """Of the pairs left (None: all) as flat places, those whose u . v reaches need."""
        if left is None or len(left) > DENSE * len(u) * len(v):
            good = u @ v.T >= need[:, None]
            return np.flatnonzero(good) if left is None else left[good.ravel()[left]]
        i, j = np.divmod(left, len(v))
        good = [np.einsum("ij,ij->i", u[i[c : c + (1 << 16)]], v[j[c : c + (1 << 16)]]) >= need[i[c : c + (1 << 16)]] for c in range(0, len(i), 1 << 16)]
        return left[np.concatenate(good)] if good else left

    for a in range(0, len(x), PART):
        b = min(a + PART, len(x))
        left, need = None, np.maximum(scores[:, 0], floor)
        for s, (sq, sx) in stats.items():
            if useful[s]:
                before = len(q) * (b - a) if left is None else len(left)
                left = asked(sq, sx[a:b], left, need - slack)
                useful[s] = len(left) <= 0.9 * before or a == 0  # the first part's needs may still be low
                if seen is not None:
                    counts = seen.setdefault(s, [0, 0])
                    counts[0], counts[1] = counts[0] + before, counts[1] + len(left)
        if exact:
            before = len(q) * (b - a) if left is None else len(left)
            kept = asked(q, x[a:b], left, need)
            if seen is not None:
                counts = seen.setdefault(width, [0, 0])
                counts[0], counts[1] = counts[0] + before, counts[1] + len(kept)
            i, j = np.divmod(kept, b - a)
            s = np.concatenate([np.einsum("ij,ij->i", q[i[c : c + (1 << 16)]], x[a:b][j[c : c + (1 << 16)]]) for c in range(0, len(i), 1 << 16)] or [np.zeros(0)])
        else:
            i, j = np.divmod(np.arange(len(q) * (b - a)) if left is None else left, b - a)
            s = np.array([sum(int(u) * int(v) for u, v in zip(queries[m], rows[a + n], strict=True)) for m, n in zip(i, j, strict=True)], object)
        other = query_ids[i] != row_ids[a:b][j]
        i, j, s = i[other], j[other], s[other]
        found_q.append(i), found_x.append(row_ids[a:b][j]), found_s.append(s)
        if exact and len(i):  # the k best scores so far, in ascending order
            order = np.lexsort((-s, i))
            i2, s2 = i[order], s[order]
            place = np.arange(len(i2)) - np.searchsorted(i2, i2)
            top = place < k
            now = np.full((len(q), k), -np.inf)
            now[i2[top], place[top]] = s2[top]
            scores = np.sort(np.concatenate([scores, now], 1), 1)[:, -k:]
    i, ids, s = np.concatenate(found_q), np.concatenate(found_x), np.concatenate(found_s)
    order = sorted(range(len(i)), key=lambda n: (i[n], -s[n], ids[n])) if not exact else np.lexsort((ids, -s, i))
    i, ids, s = i[order], ids[order], s[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    for n in np.flatnonzero(place < k):
        yield int(i[n]), int(ids[n]), int(s[n])


def _join(k: int):
    def join(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            ids = queries["vec_id"].to_numpy(np.int64)
            floor = queries["floor"].astype(float).fillna(-np.inf).to_numpy()
            out = [(ids[i], n, s) for i, n, s in best(_matrix(list(queries["v"])), ids, _matrix(list(rows["v"])), rows["vec_id"].to_numpy(np.int64), k, floor)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return join


def _matrix(vectors: list) -> np.ndarray:
    """Rows of a common width; shorter vectors end in zeros."""
    width = max(map(len, vectors))
    if min(map(len, vectors)) == width:
        return np.stack(vectors).astype(np.int64, copy=False)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) over vectors (vec_id, v array<bigint>): the k other rows of largest v . v.

    Rows with a null vec_id or v take no part; vectors of different length are compared as if zeros followed;
    repeated rows are all kept as candidates (a row's own are those of its vec_id); an empty table gives no rows.
    Scores must fit into 64 bits.
    Queries go in blocks of QUERY_BLOCK to blocks of ROW_BLOCK rows, every pair of blocks being one group: to the first
    block of rows before the others, which then know what the k-th best score reaches.
    """
    vectors = vectors.select("vec_id", "v").where("vec_id is not null and v is not null")
    queries = vectors.where(is_query).dropDuplicates(["vec_id"])
    n_rows, n_queries = vectors.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n_rows // ROW_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    left = queries.withColumn("qb", deal(query_blocks))
    right = vectors.withColumn("rb", deal(row_blocks))

    def met(left: DataFrame, first: int, last: int) -> DataFrame:
        """The best of each query among the row blocks from first to last, a group being a pair of blocks."""
        tasks = min(query_blocks * (last - first + 1), MOST_TASKS)
        every = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b)))
        mine = left.withColumn("rb", every(first, last)).repartition(tasks, "qb", "rb")
        theirs = right.where(F.col("rb").between(first, last)).withColumn("qb", every(0, query_blocks - 1)).repartition(tasks, "qb", "rb")
        mine = mine.toDF(*mine.columns)  # both come from one table; its columns need names of their own
        return mine.groupBy("qb", "rb").cogroup(theirs.groupBy("qb", "rb")).applyInPandas(_join(k), "query_id long, vec_id long, score long")

    found = met(left.withColumn("floor", F.lit(None).cast("long")), 0, 0)
    if row_blocks > 1:
        found = written(found)
        floor = found.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k)
        known = left.join(floor.select(F.col("query_id").alias("vec_id"), "floor"), "vec_id", "left")
        found = found.union(met(known, 1, row_blocks - 1))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
