"""Boxes near each other and what hangs together: a tile join and connected components in plain DataFrame operations."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a table written below spark.checkpoint.dir, which cuts their lineage.

    Where that is unset, a session of one machine (tests) gets a folder of its own; on a cluster that is an error.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("docweave.local.steps", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docweave-")
        spark.conf.set("docweave.local.steps", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(df: DataFrame) -> None:
    """Delete the files of a cut() table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def near_pairs(boxes: DataFrame, keys: list[str], near: Column, reach: float, tile: float = 100) -> DataFrame:
    """(keys, a, b): pairs of ids, a below b, for which `near` holds; it speaks of the boxes a and b (a.x0 and so on).

    boxes: keys, id, x0, y0, x1, y1. Boxes grown by half of `reach`, the largest gap that `near` allows, are dealt to the
    tiles they touch, so the join is on equal keys and tiles; a pair counts in the first tile that both touch only.
    """
    half = reach / 2
    dealt = boxes.select(*keys, "id", "x0", "y0", "x1", "y1")
    for axis in "xy":
        first, last = (F.floor((F.col(f"{axis}{e}") + d) / tile).cast("long") for e, d in ((0, -half), (1, half)))
        dealt = dealt.withColumn(f"_{axis}", first).withColumn(f"_t{axis}", F.explode(F.sequence(first, F.greatest(first, last))))
    a, b = dealt.alias("a"), dealt.alias("b")
    equal = F.col("a.id") < F.col("b.id")
    for k in [*keys, "_tx", "_ty"]:
        equal &= F.col(f"a.{k}") == F.col(f"b.{k}")
    once = (F.col("a._tx") == F.greatest("a._x", "b._x")) & (F.col("a._ty") == F.greatest("a._y", "b._y"))
    return a.join(b, equal & once & near).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def gap(axis: str, a: str = "a", b: str = "b") -> Column:
    """The distance of two boxes along an axis, 0 where they overlap."""
    return F.greatest(F.lit(0.0), F.col(f"{b}.{axis}0") - F.col(f"{a}.{axis}1"), F.col(f"{a}.{axis}0") - F.col(f"{b}.{axis}1"))


def over(axis: str, a: str = "a", b: str = "b") -> Column:
    """Whether two boxes overlap along an axis by more than an edge."""
    return F.greatest(f"{a}.{axis}0", f"{b}.{axis}0") < F.least(f"{a}.{axis}1", f"{b}.{axis}1")


def connected(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, root) for nodes (keys, id): the smallest id that edges (keys, a, b) reach within the keys.

    Every round each node points to the smallest of what it and its neighbours point to, then pointers are followed one
    further, and edges are drawn anew between what their ends point to, so that a path shrinks to a part of its length. Rounds end
    when no edge is left. Repeated edges and loops are allowed; a node without edges is its own root; keys aren't null.
    """
    ends = lambda e: e.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    links = cut(ends(edges))
    labels = cut(nodes.select(*keys, "id").distinct().withColumn("root", F.col("id")))
    while not links.isEmpty():
        both = links.select(*keys, F.col("a").alias("id"), F.col("b").alias("to")).union(links.select(*keys, F.col("b").alias("id"), F.col("a").alias("to")))
        least = both.groupBy(*keys, "id").agg(F.least("id", F.min("to")).alias("to"))
        further = least.select(*keys, F.col("id").alias("to"), F.col("to").alias("further"))
        jumped = cut(least.join(further, [*keys, "to"], "left").select(*keys, "id", F.least("to", "further").alias("to")))
        moved = lambda rows, c: rows.join(jumped.withColumnRenamed("id", c), [*keys, c], "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: E731, B023
        old = (links, labels, jumped)
        links, labels = cut(ends(moved(moved(links, "a"), "b"))), cut(moved(labels, "root").select(*keys, "id", "root"))
        for table in old:
            freed(table)
    return labels
