"""Whole flows: files to text, files to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunk_documents
from ..operators.tables import chunk_by_kind
from ..sources.readers import read_documents


def extract_text(spark: SparkSession, path: str, mode: str = "PERMISSIVE", hidden: bool = True) -> DataFrame:
    """Texts of all files below path, sheets laid out as blocks."""
    return read_documents(spark, path, mode, layout=True, hidden=hidden)


def extract_chunks(spark: SparkSession, path: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks with positions of all readable files below path."""
    return chunk_documents(read_documents(spark, path, "DROPMALFORMED", layout=True).drop("error"), size=size, overlap=overlap)


def extract_table_chunks(spark: SparkSession, path: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Like extract_chunks, but cut by file type: sheets and tables between rows with their headers, paged files by pages."""
    found = read_documents(spark, path, "DROPMALFORMED", layout=True).drop("error")
    return chunk_by_kind(found, F.col("ext"), size=size, overlap=overlap)
