"""A prefix trie of conversations.

1. `ordered` numbers the turns of each conversation. Rows are dealt by range of (conversation, turn), so a conversation
   of any length spreads over tasks; only pieces of conversations that cross a range get a carry.
2. `fingerprints`: a numpy scan gives each turn the polynomial rolling fingerprint, modulo 2**61 - 1, of all turns up to
   it. A conversation is scanned in segments of SEGMENT turns; the sums are additive, so later segments add the earlier
   ones' totals.
3. Equal (depth, fingerprint) are candidates for one node. Every turn of such a group is compared with the turn of its
   representative, the smallest conversation, by role and text, summed up in tasks before the shuffle. All comparisons
   of a prefix together compare it turn by turn. Where texts differ, the group is split: members get the number of their
   text, and what is below keeps the numbers of its prefix.
4. Parents roll up sums over their members instead of walking the levels: each conversation owns the nodes of which it is
   the smallest member, a lower part of its path. A node's distinct texts are those from it on of its own
   conversation and what the other members own; its leaves are the members whose owned end has no child.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

PRIME = (1 << 61) - 1
#: Any number below PRIME that isn't small.
BASE = 0x0C2B2AE3D27D4EB5
SEGMENT = 1 << 16
#: Conversation ids that are joined to one text before the texts of a node are hashed one after the other.
PACK = 4096
_M31, _M30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_S31, _S30, _S61 = np.uint64(31), np.uint64(30), np.uint64(61)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> _S61)
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME for numbers below it."""
    a1, a0, b1, b0 = a >> _S31, a & _M31, b >> _S31, b & _M31
    middle = a1 * b0 + a0 * b1
    return _reduced(np.uint64(2) * a1 * b1 + (middle >> _S30) + ((middle & _M30) << _S31) + a0 * b0)


def running(x: np.ndarray) -> np.ndarray:
    """Prefix sums modulo PRIME of numbers below it."""
    high, low = np.cumsum(x >> _S31), np.cumsum(x & _M31)
    return _reduced(product(_reduced(high), np.full(len(x), 1 << 31, np.uint64)) + _reduced(low))


@functools.cache
def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 to n - 1."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, product(out, np.full(len(out), pow(BASE, len(out), PRIME), np.uint64))])
    return out[:n]


def _groups(keys: np.ndarray, last) -> np.ndarray:
    """Where a new key begins, `last` being the one before."""
    return np.r_[last is None or keys[0] != last, keys[1:] != keys[:-1]]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by conversation, each with its number (from 1) among the conversation's rows of this task."""
    last, count = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_numpy()
        new = _groups(conv, last)
        start = np.maximum.accumulate(np.where(new, np.arange(len(conv)), -1))
        number = np.arange(len(conv)) - start + 1
        number[start < 0] += count - 1
        last, count = conv[-1], int(number[-1])
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(number)], names=["conv", "role", "text", "finger", "chars", "i"])


def ordered(turns: DataFrame, bits: int = 61) -> DataFrame:
    """(conv, i, role, text, finger, chars): the turns of each conversation numbered from 1, as a written table.

    turns: (conv_id, turn, role, text). Ordered by turn, nulls first; turns that tie by role and then text, as UTF-8 bytes.
    Null role or text becomes empty; rows without conv_id belong to no conversation and are left out. finger: `bits` bits
    of a hash of role and text; chars: code points of the text.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("finger", F.xxhash64("role", "text").bitwiseAND((1 << bits) - 1) % PRIME).withColumn("chars", F.length("text").cast("long"))
    dealt = rows.repartitionByRange("conv", F.col("turn").asc_nulls_first()).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    kind = "conv long, role string, text string, finger long, chars long, i long"
    held = written(dealt.select("conv", "role", "text", "finger", "chars").mapInArrow(_numbered, kind).withColumn("part", F.spark_partition_id()))
    pieces = held.groupBy("conv", "part").agg(F.max("i").alias("n"))
    crossing = pieces.groupBy("conv").agg(F.count("*").alias("parts")).where("parts > 1").select("conv")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = pieces.join(crossing, "conv", "left_semi").select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carry"))
    carry = written(carry)  # at most two rows a range
    return held.join(F.broadcast(carry), ["conv", "part"], "left").withColumn("i", F.col("i") + F.coalesce("carry", F.lit(0))).drop("part", "carry")


def rebuilt(rows: DataFrame, base: Column, shared: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from another one: (conv) of all, and their turns (conv, p, finger, chars, source, at).

    rows: an ordered() table. base and shared are columns of conv: the first `shared` (at most `most`) turns of the conversation
    `base`, or all if there are fewer, none if it is absent, then conv's own turns after its first `shared`. source and
    at say which row of `rows` a turn is.
    """
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n"))
    convs = sizes.select("conv", base.alias("base"), shared.alias("shared"))
    taken = convs.join(sizes.select(F.col("conv").alias("base"), "n"), "base", "left")
    taken = written(taken.select("conv", "base", "shared", F.least("shared", F.coalesce("n", F.lit(0))).alias("taken")))
    light = rows.select("conv", "i", "finger", "chars")
    own = light.join(taken.hint("merge"), "conv").where("i > shared")
    own = own.select("conv", (F.col("i") - F.col("shared") + F.col("taken")).alias("p"), "finger", "chars", F.col("conv").alias("source"), F.col("i").alias("at"))
    first = light.where(F.col("i") <= most).withColumnRenamed("conv", "base")
    copied = taken.where("taken > 0").join(first, "base").where("i <= taken")
    copied = copied.select("conv", F.col("i").alias("p"), "finger", "chars", F.col("base").alias("source"), F.col("i").alias("at"))
    return taken.select("conv"), own.union(copied)


def _scanned(length: int):
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (conv, p, finger, chars, source, at) ordered by the first two to (…, print, upto), summed within conv's segments."""
        last, total, reached, scale = None, np.uint64(0), 0, {}
        table = powers(length)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, p, finger, chars = (batch.column(i).to_numpy() for i in range(4))
            segment = p // length
            new = _groups(conv, last and last[0]) | _groups(segment, last and last[1])
            value = product(finger.astype(np.uint64), table[p % length])
            for s in np.unique(segment[segment > 0]).tolist():
                scale[s] = scale.get(s) or pow(BASE, s * length, PRIME)
                mine = segment == s
                value[mine] = product(value[mine], np.full(int(mine.sum()), scale[s], np.uint64))
            sums, lengths = running(value), np.cumsum(chars)
            start = np.maximum.accumulate(np.where(new, np.arange(len(p)), -1))
            fresh = start > 0
            before = np.where(fresh, sums[np.maximum(start - 1, 0)], np.uint64(0))
            prints = _reduced(sums + np.uint64(PRIME) - before)
            upto = lengths - np.where(fresh, lengths[np.maximum(start - 1, 0)], 0)
            carried = start < 0
            prints[carried] = _reduced(prints[carried] + total)
            upto[carried] += reached
            last, total, reached = (conv[-1], segment[-1]), prints[-1], int(upto[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 3, 4, 5)), pa.array(prints.astype(np.int64)), pa.array(upto)], names=["conv", "p", "chars", "source", "at", "print", "upto"])

    return scanned


def fingerprints(turns: DataFrame) -> DataFrame:
    """(conv, p, chars, source, at, print, upto) for turns (conv, p, finger, chars, source, at), as a written table.

    print: fingerprint of the conversation's first p turns; upto: their code points.
    """
    segment = F.floor(F.col("p") / SEGMENT)
    dealt = turns.select("conv", "p", "finger", "chars", "source", "at").repartition("conv", segment).sortWithinPartitions("conv", "p")
    found = written(dealt.mapInArrow(_scanned(SEGMENT), "conv long, p long, chars long, source long, at long, print long, upto long"))
    long = found.where(F.col("p") >= SEGMENT).select("conv").distinct()
    if long.isEmpty():
        return found
    segments = found.join(long, "conv", "left_semi").groupBy("conv", segment.alias("segment")).agg(F.max_by(F.struct("print", "upto"), "p").alias("total"))
    before = Window.partitionBy("conv").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)  # one row for SEGMENT turns
    wide = F.sum(F.col("total.print").cast("decimal(38,0)")).over(before) % PRIME
    carry = segments.select("conv", "segment", wide.cast("long").alias("more"), F.sum("total.upto").over(before).alias("longer"))
    joined = found.withColumn("segment", segment).join(carry.where("more is not null"), ["conv", "segment"], "left")
    whole = ((F.col("print") + F.coalesce("more", F.lit(0))) % PRIME).alias("print")
    return written(joined.select("conv", "p", "chars", "source", "at", whole, (F.col("upto") + F.coalesce("longer", F.lit(0))).alias("upto")))


def _split(found: DataFrame, rows: DataFrame) -> DataFrame:
    """fingerprints() rows with `split`: empty, or what tells apart prefixes of one fingerprint."""
    groups = found.groupBy("p", "print").agg(F.count("*").alias("n"), F.min("conv").alias("rep")).where("n > 1").select("p", "print", "rep")
    members = found.select("conv", "p", "print", "source", "at").join(groups, ["p", "print"])
    wanted = members.groupBy("p", "print", "source", "at").agg(F.min(F.col("conv") != F.col("rep")).alias("other"))
    texts = wanted.join(rows.select(F.col("conv").alias("source"), F.col("i").alias("at"), "role", "text"), ["source", "at"])
    kinds = texts.groupBy("p", "print", "role", "text").agg(F.min("other").alias("other"), F.min(F.struct("source", "at")).alias("one"))
    apart = kinds.groupBy("p", "print").agg(F.count("*").alias("kinds")).where("kinds > 1").select("p", "print")
    apart = written(apart)
    if apart.isEmpty():
        return found.withColumn("split", F.lit(""))
    number = F.row_number().over(Window.partitionBy("p", "print").orderBy("other", "role", "text")) - 1  # the representative's text is 0
    numbers = kinds.join(apart, ["p", "print"]).select("p", "print", "role", "text", number.alias("number")).where("number > 0")
    differing = texts.join(numbers, ["p", "print", "role", "text"]).select("p", "print", "source", "at", "number")
    marks = found.join(differing, ["p", "print", "source", "at"]).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("p", "number"))).alias("marks"))
    marks = written(marks)
    joined = found.join(marks.hint("merge"), "conv", "left")
    upto = F.filter("marks", lambda m: m["p"] <= F.col("p"))
    text = F.array_join(F.transform(upto, lambda m: F.concat_ws(":", m["p"], m["number"])), ",")
    return written(joined.select(*found.columns, F.coalesce(text, F.lit("")).alias("split")))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (p, print, split, conv), ordered, to rows (p, print, split, first, ids): at most PACK ids joined by commas."""
    for batch in batches:
        if not batch.num_rows:
            continue
        p, prints, split, conv = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), batch.column(3)
        marks = np.array(split.to_pylist(), object)
        new = _groups(p, None) | _groups(prints, None) | _groups(marks, None)
        head = np.flatnonzero(new)
        size = np.diff(np.r_[head, len(p)])
        parts = -(-size // PACK)
        start = np.repeat(head, parts) + PACK * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        end = np.r_[start[1:], len(p)]
        ids = [",".join(map(str, conv.slice(a, b - a).to_pylist())) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        at = pa.array(start)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), split.take(at), conv.take(at), pa.array(ids, pa.string())], names=["p", "print", "split", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (p, print, split, first, ids), ordered, to (p, print, split, ends_sha256): SHA-256 of all ids of a node, a piece at a time."""
    from hashlib import sha256

    key, state = None, None
    names = ["p", "print", "split", "ends_sha256"]
    for batch in batches:
        done = []
        for *found, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if found != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = found, sha256()
                state.update(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names=names)


def prefix_trie(convs: DataFrame, turns: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each node of the trie.

    convs: (conv) of all conversations, turnless ones too; turns: (conv, p, finger, chars, source, at), p from 1 without
    gaps; rows: (conv, i, role, text), of which source and at name one. A node is a distinct sequence of first turns, its
    conv_id the smallest member's and so with depth its name. saved_tokens: over the node's subtree, members without
    the first times code points of the last text. ends_sha256: SHA-256 of the ids of members that end there, ascending,
    joined by commas. No conversations give no node, repeated turns are turns of their own.
    """
    key = ["p", "print", "split"]
    found = _split(fingerprints(turns), rows)
    ends = found.groupBy("conv").agg(F.max("p").alias("size"), F.max("upto").alias("length"))
    ends = written(convs.join(ends, "conv", "left").select("conv", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("length", F.lit(0)).alias("length")))
    whole = found.join(ends.hint("merge"), "conv").select("conv", *key, "chars", "upto", "size", "length")
    nothing = F.lit(0).cast("long")
    roots = ends.select("conv", nothing.alias("p"), nothing.alias("print"), F.lit("").alias("split"), nothing.alias("chars"), nothing.alias("upto"), "size", "length")
    members = written(whole.union(roots))
    here = F.when(F.col("p") == F.col("size"), F.col("conv"))
    nodes = members.groupBy(*key).agg(
        F.count("*").alias("n"), F.min(F.struct("conv", "chars", "upto", "size", "length")).alias("rep"), F.sum("length").cast("decimal(38,0)").alias("lengths"), F.count(here).alias("n_ends"), F.min(here).alias("end")
    )
    nodes = written(nodes)
    # What each conversation owns: its path from `top` on, of it with others up to `alone`.
    leaf = F.max(((F.col("p") == F.col("rep.size")) & (F.col("n_ends") == F.col("n"))).cast("long"))
    owners = nodes.groupBy(F.col("rep.conv").alias("conv")).agg(F.min(F.struct("p", "rep.upto", "rep.chars", "rep.length")).alias("top"), F.min(F.when(F.col("n") == 1, F.col("p"))).alias("alone"), leaf.alias("leaf"))
    own = F.col("top.length") - F.col("top.upto") + F.col("top.chars")
    owners = written(owners.select("conv", F.col("top.p").alias("top"), "alone", "leaf", own.alias("own")))
    shared = members.select("conv", *key).join(owners.hint("merge"), "conv").where("alone is null or p < alone")
    sums = shared.groupBy(*key).agg(F.sum("own").cast("decimal(38,0)").alias("own"), F.sum("leaf").alias("leaves"), F.count(F.when(F.col("p") == F.col("top") - 1, 1)).alias("born"))
    # The one parent that a conversation doesn't own itself is that of its topmost node.
    above = shared.where("p = top - 1").select(*key, F.col("conv").alias("child"))
    above = above.join(nodes.select(*key, F.col("rep.conv").alias("parent")), key).select(F.col("child").alias("conv"), (F.col("p") + 1).alias("p"), "parent")
    listed = written(members.where("p = size").join(nodes.where("n_ends > 1").select(*key), key, "left_semi").select(*key, "conv"))
    packed = listed.repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv").mapInArrow(_joined, "p long, print long, split string, first long, ids string")
    hashed = packed.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(_hashed, "p long, print long, split string, ends_sha256 string")
    out = nodes.join(sums, key, "left").join(hashed, key, "left").withColumn("conv", F.col("rep.conv"))
    out = out.join(above, ["conv", "p"], "left")
    prefix, one = F.col("rep.upto") - F.col("rep.chars"), F.col("n") == 1
    repeated = F.col("lengths") - F.col("n") * prefix
    distinct = F.col("own") - F.col("own_rep") + F.col("rep.length") - prefix
    out = out.join(owners.select("conv", F.col("own").alias("own_rep")), "conv")
    parent = F.when(F.col("p") == 0, F.lit(None)).otherwise(F.coalesce("parent", "conv"))
    no_list = F.sha2(F.coalesce(F.col("end").cast("string"), F.lit("")), 256)
    return out.select(
        F.col("conv").alias("conv_id"),
        F.col("p").alias("depth"),
        parent.alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        ((F.col("rep.size") > F.col("p")).cast("long") + F.coalesce("born", F.lit(0))).alias("n_children"),
        F.when(one, F.lit(1)).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
        F.when(one, F.lit(0)).otherwise(repeated - distinct).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", no_list).alias("ends_sha256"),
    )
