"""Chunks to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def markdown_chunks(chunks: DataFrame, document: str = "doc_id") -> DataFrame:
    """(document, chunk_index, value) of chunks (document, chunk_index, text): each chunk under its heading and before a rule.

    A document's first chunk also has its name and number of chunks above it. Null texts are empty.
    """
    whole = Window.partitionBy(document)
    total, first = F.count("*").over(whole), F.min("chunk_index").over(whole)
    place = F.row_number().over(whole.orderBy("chunk_index"))
    parts = chunks.select(document, "chunk_index", F.coalesce("text", F.lit("")).alias("text"), total.alias("n"), first.alias("first"), place.alias("i"))
    name = F.coalesce(F.col(document).cast("string"), F.lit(""))
    head = F.when(F.col("chunk_index") == F.col("first"), F.concat(F.lit("total_chunks: "), F.col("n").cast("string"), F.lit("\nsource_file: "), name, F.lit("\n\n"))).otherwise("")
    value = F.concat(head, F.lit("## Chunk "), F.col("i").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit("\n\n"), "text", F.lit("\n\n---\n"))
    return parts.select(document, "chunk_index", value.alias("value"))


def save_markdown(chunks: DataFrame, path: str, document: str = "doc_id") -> None:
    """A text file part for each range of documents, chunks in order."""
    each = markdown_chunks(chunks, document).repartitionByRange(document, "chunk_index").sortWithinPartitions(document, "chunk_index")
    each.select("value").write.mode("overwrite").text(path)
