"""Incremental ingestion: new files or rows become chunks as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_documents


def stream_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks of a streaming frame of documents; stateless, so any trigger and any restart give the same rows."""
    return chunk_documents(docs, size=size, overlap=overlap)


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Read what parquet files arrive below source, chunk their documents, append to target, then stop."""
    docs = spark.readStream.schema(schema).parquet(source)
    writer = stream_chunks(docs).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(target)
