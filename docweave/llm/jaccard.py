"""Exact n-gram Jaccard join and its components.

Texts become sets of shingle hashes; texts of equal sets are one node. Nodes that can link are found in three steps.

1. Families. Two sets of sizes x and y and of similarity t or more differ in at most D = (1 - t) / (1 + t) (x + y)
   elements. Deal the elements by hash to over D / 2 parts of three cells each: some part holds one differing element at
   most, so two of its cells hold the same elements in both sets. Nodes that share the elements of two such cells (a
   class of sizes, the cells and the sum of their hashes, deduplicated in a task before the shuffle) are of one family.
   Each set leaves out pairs of cells of fewer elements than it has in all pairs of its D / 2 fullest parts: the set of
   the higher limit still shares what it gives. Sets of few elements have parts of one cell, of which over D are taken.
   Families are components over pairs of a mark's least node and the others, so linear in their size; a task first
   connects blocks of its pairs.
2. Count-vector R-tree. In a family, elements are dealt by hash to DIMS groups; the group counts are a set's point.
   The points are split at the median of their widest dimension into leaves, and FAN neighbours make a node of the
   next level up. The tree is joined with itself from the root down: the sum of coordinate minima bounds the overlap of
   two boxes, and pairs of nodes that can't reach the similarity go with all below them. What passes among the sets is
   verified on the whole sets, except pairs that links already connect.
   Families chain texts that only share marks, so the largest grows faster than the corpus. One of over FAMILY_BYTES is
   cut into clusters, which overlap: each holds the nodes of all marks that have the same least node, so that nodes that
   can link meet in one, and a node goes to as many as its marks have least nodes. What a mark's nodes hold of over
   FAMILY_BYTES is dealt to tiles, and every pair of tiles is a task, so no task is unbounded.
3. Components over the links found, which a task gives as one star for each component of its family. Sets are told apart by 128 bits there and in the result; 64 bits, which suffice to
   propose candidates, name them in the families.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forget, row_key, slices, stars, text_buffer, written
from .decontaminate import _mixed, gram_hashes, hashes_at, word_hashes, word_places

DIMS, LEAF, FAN, FAMILY_BYTES = 32, 32, 8, 16 << 20
#: Pairs of tree nodes looked at together.
PAIRS = 1 << 15
#: Edges that a task connects at once.
EDGES = 1 << 20
#: Sets that may differ in so many elements have parts of three cells.
TRIPLES = 8
_SPACE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])


def _bounds() -> list[int]:
    """Sizes where classes begin, each about half more than the last."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


BOUNDS = _bounds()


def shingled(words: np.ndarray, begin: np.ndarray, n: int, seed: int = 0) -> list[np.ndarray]:
    grams = gram_hashes(words, n, seed)
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        out.append(np.unique(grams[a : b - n + 1]) if b - a >= n else gram_hashes(words[a:b], b - a, seed) if b > a else grams[:0])
    return out


def sets_of(data: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingles of n words; of fewer words, the whole sequence is one."""
    return shingled(*word_hashes(data, at, _SPACE), n)


def named_sets(data: np.ndarray, at: np.ndarray, n: int) -> list[tuple[np.ndarray, int, int]]:
    """sets_of() and two 64-bit names of each set, by words and shingles hashed with two seeds (0 for the empty set)."""
    starts, ends, begin = word_places(data, at, _SPACE)
    first, other = (shingled(hashes_at(data, starts, ends, seed), begin, n, seed) for seed in (0, 1))
    return [(x, node_of(x), node_of(y)) for x, y in zip(first, other, strict=True)]


def signatures(items: np.ndarray, percent: int) -> np.ndarray:
    """What a set shares at least one of with each set of similarity percent / 100 or more."""
    size, found = len(items), []
    c = int(np.searchsorted(BOUNDS, size, "right")) - 1
    largest = size * 100 // percent
    for label in range(c, int(np.searchsorted(BOUNDS, largest, "right"))):
        top = BOUNDS[label + 1] - 1
        differ = (100 - percent) * (size + min(top, largest)) // (100 + percent)
        if not differ:
            found.append(_mixed(_mixed(items).sum(keepdims=True) + np.uint64(label)))
            continue
        most = 2 * (100 - percent) * top // (100 + percent)
        each, spare = (3, 2) if most >= TRIPLES else (1, 1)
        parts = (9 * (most // spare + 1) + 7) // 8
        cell = ((items >> np.uint64(20)) % np.uint64(parts * each)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        count = np.bincount(cell, minlength=parts * each)
        total = np.zeros(parts * each, np.uint64)
        full = np.flatnonzero(count)
        total[full] = np.add.reduceat(_mixed(items[order]), (np.cumsum(count) - count)[full])
        count, total = count.reshape(parts, each), total.reshape(parts, each)
        if each > 1:
            count, total = count.sum(1, keepdims=True) - count, total.sum(1, keepdims=True) - total
        least = np.sort(count.min(1))[parts - 1 - differ // spare]
        use = np.flatnonzero(count.ravel() >= least)
        found.append(_mixed(total.ravel()[use] + _mixed((use + (label << 40)).astype(np.uint64)) * np.uint64(3)))
    return np.concatenate(found)


def node_of(items: np.ndarray) -> int:
    """A 64-bit hash that stands for a set; 0 for the empty one."""
    return int(_mixed(_mixed(items).sum(keepdims=True) + np.uint64(len(items))).view(np.int64)[0]) if len(items) else 0


def _nodes(n: int):
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, "text"):
            sets = named_sets(*text_buffer(batch.column(3)), n)
            node, twin = (pa.array([s[i] if len(s[0]) else None for s in sets], pa.int64()) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), node, twin, pa.array([len(s[0]) for s in sets], pa.int64())], names=["doc_id", "i", "k", "node", "twin", "n_shingles"])

    return nodes


def _marks(n: int, percent: int):
    """Texts to rows (mark, node): of a slice, each mark's first node, and for each other node that has one of that
    node's marks, a mark of just the two."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, "text"):
            sets = {node_of(s): s for s in sets_of(*text_buffer(batch.column(0)), n) if len(s)}
            if not sets:
                continue
            each = [signatures(s, percent) for s in sets.values()]
            of = np.repeat(np.array(list(sets), np.int64), [len(x) for x in each])
            mark, lead, back = np.unique(np.concatenate(each), return_index=True, return_inverse=True)
            first = of[lead][back]
            pairs = np.unique(np.stack([first, of], 1)[first != of], axis=0)
            a, b = pairs[:, 0].copy(), pairs[:, 1].copy()
            both = _mixed(_mixed(a.view(np.uint64)) + b.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([mark, both, both]).view(np.int64)), pa.array(np.concatenate([of[lead], a, b]))], names=["mark", "node"])

    return marks


def _all_marks(n: int, percent: int):
    """Rows (node, text) to rows (mark, node)."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, "text"):
            nodes = batch.column(0).to_numpy()
            each = [signatures(s, percent) for s in sets_of(*text_buffer(batch.column(1)), n)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each).view(np.int64)), pa.array(np.repeat(nodes, [len(x) for x in each]))], names=["mark", "node"])

    return marks


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows (mark, node) ordered by both to distinct pairs, of a block of rows, of each mark's least node and another."""
    mark, lead, held, size = None, 0, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        marks, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.r_[mark is None or marks[0] != mark, marks[1:] != marks[:-1]]
        at = np.maximum.accumulate(np.where(new, np.arange(len(marks)), -1))
        leads = np.where(at >= 0, nodes[at], lead)
        mark, lead = marks[-1], leads[-1]
        differ = np.flatnonzero(nodes != leads)
        held.append(np.unique(np.stack([leads[differ], nodes[differ]], 1), axis=0))
        size += len(held[-1])
        if size >= EDGES:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mark, node) ordered by both to pairs that connect each mark's nodes: of a block of rows, each node with the
    least that it reaches."""
    for pairs in _led(batches):
        node, least = stars(pairs[:, 0], pairs[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(least), pa.array(node)], names=["a", "b"])


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mark, node) ordered by both to (lead, node): each mark's least node with all that it has, if they are several."""
    for pairs in _led(batches):
        lead = np.unique(pairs[:, 0])
        pairs = np.unique(np.concatenate([pairs, np.stack([lead, lead], 1)]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["lead", "node"])


def _sets(n: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, at = text_buffer(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.tobytes() for s in sets_of(data, at, n)], pa.binary())], names=["id", "clusters", "items"])

    return sets


class Tree:
    """R-tree of points: level 0 are the points in tree order, each further one the boxes of FAN (first: LEAF) before."""

    def __init__(self, points: np.ndarray, size: np.ndarray):
        n = len(points)
        order, parts = np.arange(n), [(0, n)]
        while parts:  # halve each part at the median of its widest dimension until it is a leaf
            a, b = parts.pop()
            if b - a <= LEAF:
                continue
            mine = order[a:b]
            wide = int(np.ptp(points[mine], axis=0).argmax())
            half = LEAF * -(-(b - a) // (2 * LEAF))
            order[a:b] = mine[np.argpartition(points[mine, wide], half - 1)] if half < b - a else mine
            parts += [(a, a + half), (a + half, b)]
        self.order = order
        self.high, self.low = [points[order]], [size[order]]
        while len(self.low[-1]) > 1:
            starts = np.arange(0, len(self.low[-1]), LEAF if len(self.low) == 1 else FAN)
            self.high.append(np.maximum.reduceat(self.high[-1], starts))
            self.low.append(np.minimum.reduceat(self.low[-1], starts))

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points, i before j, whose bound reaches the similarity, in portions."""
        open_pairs = [(len(self.low) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64), False)]
        while open_pairs:
            level, i, j, good = open_pairs.pop()
            if not good:
                if len(i) > PAIRS:
                    open_pairs.append((level, i[PAIRS:], j[PAIRS:], False))
                    i, j = i[:PAIRS], j[:PAIRS]
                high, low = self.high[level], self.low[level]
                bound = np.minimum(high[i], high[j]).sum(1, dtype=np.int64)
                reach = (100 + percent) * bound >= percent * (low[i] + low[j])
                i, j = i[reach], j[reach]
                if not level:
                    if (i < j).any():
                        yield i, j
                    continue
            # So many pairs are opened at once as give PAIRS below them; the others wait as they are.
            fan, n = LEAF if level == 1 else FAN, len(self.low[level - 1])
            some = max(1, PAIRS // fan**2)
            if len(i) > some:
                open_pairs.append((level, i[some:], j[some:], True))
                i, j = i[:some], j[:some]
            x = (i[:, None] * fan + np.arange(fan)).repeat(fan, 1)
            y = np.tile(j[:, None] * fan + np.arange(fan), fan)
            inside = (x < n) & (y < n) & (x < y if level == 1 else x <= y)
            open_pairs.append((level - 1, x[inside], y[inside], False))


def linked(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what all links of similarity percent / 100 or more connect, by a count-vector R-tree.
    With side, only pairs of different sides are looked at."""
    size = np.array([len(s) for s in sets])
    points = np.stack([np.bincount((s >> np.uint64(50)).astype(np.int64) % DIMS, minlength=DIMS) for s in sets]).astype(np.int32)
    tree = Tree(points, size)
    parent, out = list(range(len(sets))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in tree.pairs(percent):
        i, j = tree.order[i], tree.order[j]
        own, back = np.unique(np.concatenate([i, j]), return_inverse=True)
        roots = np.array([root(x) for x in own.tolist()])[back]
        apart = roots[: len(i)] != roots[len(i) :]
        if side is not None:
            apart &= side[i] != side[j]
        for x, y in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            if (rx := root(x)) == (ry := root(y)):
                continue
            small, large = (sets[x], sets[y]) if size[x] <= size[y] else (sets[y], sets[x])
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            both = int((large[at] == small).sum())
            if 100 * both >= percent * (size[x] + size[y] - both):
                parent[ry] = rx
                out.append((x, y))
    return out


def _verify(percent: int):
    def solve(held: list[tuple]) -> pa.RecordBatch:
        rows = sorted({r[3]: r for r in held}.values(), key=lambda r: r[3])
        tiles = np.array([r[5] for r in rows])
        side = tiles if rows and rows[0][1] != rows[0][2] else None
        ids = [r[3] for r in rows]
        pairs = linked([np.frombuffer(r[4], np.uint64) for r in rows], percent, side) if len(rows) > 1 else []
        node, least = stars(*np.array(pairs, np.int64).reshape(-1, 2).T)
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in least], pa.binary()), pa.array([ids[j] for j in node], pa.binary())], names=["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        key, held = None, []
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if row[:3] != key and held:
                    yield solve(held)
                    held = []
                key = row[:3]
                held.append(row)
        if held:
            yield solve(held)

    return verify


def _families(rows: DataFrame, n: int, percent: int) -> DataFrame:
    marks = rows.select("text").mapInArrow(_marks(n, percent), "mark long, node long").repartition("mark").sortWithinPartitions("mark", "node")
    return components(marks.mapInArrow(_pairs, "a long, b long"))


def _clusters(chosen: DataFrame, n: int, percent: int) -> DataFrame:
    """(id, clusters) for rows (id, node, n_shingles, family, large, text): structs (cluster, tiles), being the family or, if it
    is large, the leads of the node's marks. A node of the family names a cluster, so no two families share one."""
    marks = chosen.where("large").select("node", "text").mapInArrow(_all_marks(n, percent), "mark long, node long").repartition("mark").sortWithinPartitions("mark", "node")
    leads = marks.mapInArrow(_leads, "lead long, node long").distinct()
    split = chosen.where("large").select("id", "node", "n_shingles").distinct().join(leads, "node").select("id", "n_shingles", F.col("lead").alias("cluster"))
    placed = written(chosen.where("not large").select("id", "n_shingles", F.col("family").alias("cluster")).distinct().union(split))
    tiles = placed.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") * 8 / FAMILY_BYTES).cast("int").alias("tiles"))
    return written(placed.join(tiles, "cluster").groupBy("id").agg(F.collect_list(F.struct("cluster", "tiles")).alias("clusters")))


def row_components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, i, k, n_shingles, component) for each row of docs (doc_id, text; other columns are ignored).

    i and k are the row's row_key(). component: the binary id of a set of shingles that stands for all that links of
    similarity percent / 100 or more reach, null if the row has no shingles.
    """
    i, k = row_key()
    rows = docs.select("doc_id", i.alias("i"), k.alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    nodes = written(rows.mapInArrow(_nodes(n), "doc_id long, i long, k long, node long, twin long, n_shingles long"))
    set_id = F.to_binary(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("node", "twin")]), F.lit("hex"))
    family = _families(rows, n, percent).withColumnRenamed("component", "family")
    one = nodes.where("node is not null").groupBy("node", "twin").agg(F.min(F.struct("i", "k")).alias("at"), F.max("n_shingles").alias("n"))
    member = written(one.join(family, "node").select("at.i", "at.k", set_id.alias("id"), "node", "family", F.col("n").alias("n_shingles")))
    large = member.groupBy("family").agg((F.sum("n_shingles") * 8 > FAMILY_BYTES).alias("large"))
    chosen = rows.join(member.join(large, "family").hint("merge"), ["i", "k"]).select("id", "node", "n_shingles", "family", "large", "text")
    chosen = written(chosen)
    sets = chosen.select("id", "text").join(_clusters(chosen, n, percent).hint("merge"), "id").select("id", "clusters", "text")
    sets = sets.mapInArrow(_sets(n), "id binary, clusters array<struct<cluster:long,tiles:int>>, items binary")
    dealt = sets.select("id", "items", F.inline("clusters")).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    dealt = dealt.select("cluster", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "id", "items", "tile")
    dealt = dealt.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y")
    component = components(dealt.mapInArrow(_verify(percent), "a binary, b binary")).withColumnRenamed("node", "id")
    named = nodes.select("doc_id", "i", "k", "n_shingles", F.when(F.col("node").isNotNull(), set_id).alias("id"))
    return named.join(component, "id", "left").select("doc_id", "i", "k", "n_shingles", F.coalesce("component", "id").alias("component"))


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text; other columns are ignored).

    component_id: the smallest doc_id that links of similarity percent / 100 or more reach. Texts that are null, empty
    or blank have no shingles and link with nothing; repeated rows and equal texts are linked; a null doc_id takes
    part in links and is nobody's smallest; an empty table gives no rows.
    """
    named = written(row_components(docs, n, percent))
    least = named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return named.join(least, "component", "left").select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
