"""URL rules by a sort-merge range join.

A host's key is its labels in reverse, each ended by \\x01, so that a rule's host stands for the interval of keys that
begin with its own: the host and all subdomains. URLs are dealt by ranges of (key, hash), rules to every range that
their interval meets; a range is sorted and swept once, with a stack of the rule hosts whose intervals are open, each
holding its path prefixes in order, every one linked to the next shorter prefix of its own. A hot host spreads over
many ranges by the hash, and its rules go to all of them.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sampled keys for each range; they only balance the ranges.
SAMPLE = 40


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty where it is null or has no ://."""
    ok = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(ok, F.translate(host, up, low)).otherwise(""), F.when(ok, path).otherwise("")


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\x01"), F.lit("\x01")))


def _ranges(bounds: list[str]) -> Callable[[Column], Column]:
    """The range of a sort key, by binary search; code points order as Spark's bytes do."""

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, k) for k in keys], dtype="int32")

    return place


class Prefixes:
    """Path prefixes of one rule host."""

    def __init__(self, key: str):
        self.key, self.paths, self.rules, self.shorter = key, [], [], []

    def add(self, path: str, rule: tuple) -> None:
        """Paths come in ascending order."""
        if self.paths and self.paths[-1] == path:
            return
        i = len(self.paths) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.shorter[i]
        self.paths.append(path), self.rules.append(rule), self.shorter.append(i)

    def longest(self, path: str) -> tuple | None:
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.shorter[i]
        return self.rules[i] if i >= 0 else None


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, key, rank, path, page_id, host, rule, verdict) in order; rank 0 is a rule, 1 a url."""
    stack: list[Prefixes] = []
    at = None
    for batch in batches:
        out: list[tuple] = []
        for part, key, rank, path, page_id, host, rule, verdict in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if part != at:
                stack, at = [], part
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if rank == 0:
                if not stack or stack[-1].key != key:
                    stack.append(Prefixes(key))
                stack[-1].add(path, (rule, verdict))
                continue
            best = None
            for open_host in stack:
                found = open_host.longest(path)
                if found and (best is None or len(found[0]) >= len(best[0])):
                    best = found
            out.append((page_id, host, path, *(best or (None, None))))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.string()] * 4), strict=True)], names=["page_id", "host", "path", "rule", "verdict"])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id, url; other columns are ignored).

    rules: (host, path, verdict). The longest rule that fits wins (host and path together; of equal ones the longer
    host), `default` holds where none does. Null urls and urls without :// have empty host and path; repeated rows
    are judged each, of repeated rules one counts; rules with nulls never fit; no rules or pages are no error.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    salt = F.hex(F.xxhash64("page_id", "path"))
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumn("sort", F.concat("key", F.lit("\x02"), salt))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, SAMPLE * ranges / max(1, pages.count()))
    sample = sorted(r["sort"] for r in urls.select("sort").sample(share, 17).limit(4 * SAMPLE * ranges).collect())
    bounds = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)} if sample else set())
    place = _ranges(bounds)
    left = urls.select(place("sort").alias("range"), "key", F.lit(1).alias("rank"), "path", "page_id", "host", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    own = rules.where("host is not null and path is not null and verdict is not null and host <> ''").select(host_key(F.col("host")).alias("key"), "host", "path", "verdict").dropDuplicates(["key", "path"])
    own = own.withColumn("first", place("key")).withColumn("last", place(F.concat("key", F.lit("\U0010ffff"))))
    own = own.withColumn("range", F.explode(F.sequence("first", "last")))
    right = own.select("range", "key", F.lit(0).alias("rank"), "path", F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("host"), F.concat("host", "path").alias("rule"), "verdict")
    order = ["range", "key", "rank", "path"]
    swept = left.union(right).repartition(ranges, "range").sortWithinPartitions(*order)
    out = swept.mapInArrow(_sweep, "page_id long, host string, path string, rule string, verdict string")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
