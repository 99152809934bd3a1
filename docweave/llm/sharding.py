"""Minimax contiguous partition: atomic groups in order, cut into shards so that the largest shard is as small as can be.

Only DataFrame functions. Groups (equal texts) stand in the order of their least doc_id. The least feasible capacity is
found by binary search (several candidates a round); a candidate is checked greedily, each of its shards taking all
groups that still fit, by looking up the last group end within reach in the distributed prefix sums of sizes. Per
lookup one row a candidate returns. Then the order is cut where the least capacity's greedy run cuts it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prefix_sums, written

CANDIDATES = 64


def _last_ends(groups: DataFrame, reach: list[int]) -> list[int]:
    """For each of the ascending reaches the largest group end that is at most it, or 0."""
    asked = sorted(set(reach))
    place = "cast(" + " + ".join(f"cast(stop > {r} as int)" for r in asked) + " as int)"
    found = {r["i"]: r["m"] for r in groups.groupBy(F.expr(place).alias("i")).agg(F.max("stop").alias("m")).collect()}
    out, best = {}, 0
    for i, r in enumerate(asked):  # i ends lie beyond reach number i - 1 and up to number i
        best = max(best, found.get(i, 0))
        out[r] = best
    return [out[r] for r in reach]


def cuts(groups: DataFrame, total: int, largest: int, shards: int) -> list[int]:
    """Ends, in prefix sums, of the shards of the least feasible capacity, the last being total."""

    def greedy(capacities: list[int]) -> list[list[int]]:
        ends = [[0] for _ in capacities]
        for _ in range(shards):
            reached = _last_ends(groups, [e[-1] + c for e, c in zip(ends, capacities, strict=True)])
            for e, r in zip(ends, reached, strict=True):
                e.append(r)
        return ends

    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest  # the upper one is always feasible
    best = None
    while best is None or low < high:
        step = max(1, -(-(high - low) // CANDIDATES))
        tried = sorted({*range(low, high, step), high})
        runs = greedy(tried)
        i = next(i for i, e in enumerate(runs) if e[-1] >= total)
        best, high = runs[i][1:], tried[i]
        low = tried[i - 1] + 1 if i else high
    return best


def minimax_shards(rows: DataFrame, shards: int) -> DataFrame:
    """Add shard (0 to shards - 1) and slot (gapless from 0 in a shard) to rows (doc_id, size, kin, any others) and drop kin.

    Other columns stay, whatever their names, but for those of the result's two and names that begin with _shard. kin: what rows of one atomic group share, null being one group too; sizes are positive. Null doc_ids come first,
    rows that tie are ordered by size and arbitrarily beyond. A group larger than an even share sets the capacity;
    then some shards may stay empty, as they do where there are fewer groups than shards. An empty table gives no rows.
    """
    kept = [c for c in rows.columns if c not in ("kin", "shard", "slot")]
    rows = rows.withColumn("_shard_kin", F.coalesce(F.col("kin").cast("string"), F.lit(""))).drop("kin", "shard", "slot")
    group = rows.groupBy("_shard_kin").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("_shard_lead"), F.count("*").alias("_shard_n"))
    several = written(group.where("_shard_n > 1").select("_shard_kin", "_shard_lead"))
    placed = rows.join(several.hint("merge"), "_shard_kin", "left").withColumn("_shard_lead", F.coalesce("_shard_lead", "doc_id", F.lit(-(2**63))))
    placed = placed.withColumn("_shard_one", F.lit(1).cast("long"))
    ordered = written(prefix_sums(placed, ["_shard_lead", "_shard_kin", "doc_id", "size"], {"_shard_start": "size", "_shard_before": "_shard_one"}))
    groups = written(ordered.groupBy("_shard_lead", "_shard_kin").agg(F.max(F.col("_shard_start") + F.col("size")).alias("stop"), F.sum("size").alias("of")))
    total, largest = groups.agg(F.max("stop"), F.max("of")).first()
    if total is None:
        return rows.select(*kept, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ends = cuts(groups, total, largest, shards)
    shard = sum((F.expr(f"cast(_shard_start >= {e} as int)") for e in sorted(set(ends)) if e < total), F.lit(0))
    ordered = ordered.withColumn("shard", shard)
    firsts = {r["shard"]: r["b"] for r in ordered.groupBy("shard").agg(F.min("_shard_before").alias("b")).collect()}
    base = F.element_at(F.create_map(*[F.lit(x).cast("long" if i % 2 else "int") for kv in sorted(firsts.items()) for i, x in enumerate(kv)]), F.col("shard"))
    return ordered.select(*kept, "shard", (F.col("_shard_before") - base).alias("slot"))


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, kin) of docs: UTF-8 bytes plus 1, crc32 of the text (null: of nothing), and its digest."""
    raw = F.col("text").cast("binary")
    return docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(raw, F.lit("").cast("binary"))).alias("text_crc32"), F.md5(raw).alias("kin"))
