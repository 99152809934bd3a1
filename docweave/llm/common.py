"""What the corpus operators share: tables, written steps, Arrow text buffers, prefix sums and components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What Python workers remember from task to task, by module.
REMEMBERED: list[dict] = []


def forget() -> None:
    """Free what earlier stages left in this worker, which Spark uses again for stages that don't need it."""
    for kept in REMEMBERED:
        kept.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor shares.

    Where that is unset, a session of one machine (tests) gets a folder of its own; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("docweave.local.scratch", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docweave-")
        spark.conf.set("docweave.local.scratch", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write df once and read it back: cuts the lineage, and a lost executor costs only a reread.

    The write's own shuffle files go as soon as it has ended, since nothing reads them again.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a written() table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def row_key() -> tuple[Column, Column]:
    """Two longs that stand for a row of (doc_id, text): the id and a hash of the text, or without an id 128 bits of the text.

    Repeated rows have the same key; a null text and an empty one have different ones.
    """
    text, none = F.col("text"), F.col("doc_id").isNull()
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("text"), text)), F.when(none, F.xxhash64(F.lit("none"), text)).otherwise(F.xxhash64(text))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets, without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    all_bytes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return all_bytes[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of each is at most about `most` bytes (one longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_buffer(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add, for each (name: column) of sums, the sum of the column over all rows before this one in `order`.

    Rows are dealt by range and summed within each range; only one total a range is gathered.
    `order` must be a total order, or rows that tie get their place arbitrarily.
    """
    spark = df.sparkSession
    dealt = written(df.repartitionByRange(*order).withColumn("_sum_range", F.spark_partition_id()))
    totals = dealt.groupBy("_sum_range").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    before = Window.orderBy("_sum_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_sum_range", *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_sum_{n}") for n in sums])
    rows = spark.createDataFrame(starts.collect(), starts.schema)
    within = Window.partitionBy("_sum_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(rows), "_sum_range")  # one row a range
    for n, c in sums.items():
        out = out.withColumn(n, F.col(f"_sum_{n}") + F.coalesce(F.sum(c).over(within), F.lit(0)))
    return out.drop("_sum_range", *[f"_sum_{n}" for n in sums])


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node each reaches) for the edges a[i], b[i], without nodes that are the smallest themselves."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = back[: len(a)], back[len(a) :], np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    found = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[found], nodes[label[found]]


def small_star(links: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, with u's neighbours hung on the least of them instead of on u: a row for a row."""
    small = links.select("u", "v", F.min("v").over(Window.partitionBy("u")).alias("m"))
    return small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of the edges reaches.

    Rounds of large-star and small-star over edges (u, v), u > v, until each u has one edge, to a node that has none to a
    smaller one. Large-star looks at v's least neighbour in a written table, so that Spark can split the join at a v of
    many edges; small-star sorts the edges of each u.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    links = written(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        least = written(links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"), F.count("*").alias("down")))
        jumped = links.join(least.select("node", "m"), F.col("v") == F.col("node"), "left")
        big = written(jumped.select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved")))
        ended = least.where("down > 1").isEmpty() and big.where("moved").isEmpty()
        dropped(least)
        if ended:
            dropped(big)
            break
        old, links = links, written(small_star(big).distinct())
        dropped(old)
        dropped(big)
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
