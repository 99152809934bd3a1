"""Table functions for SQL: `select d.doc_id, c.* from docs d, lateral chunk(d.text, 1000, 200) c`."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.chunking import CHUNKS, CODE, check, chunk_rows, code_rows


class Chunk:
    """chunk(text, size, overlap, ext): the rows that chunk_documents, or with a code type as ext chunk_code, gives for a text.

    size (1000), overlap (200) and ext (null) are optional and constant; a wrong size, overlap or type of argument fails when the query is analysed. The columns
    follow from ext: code has no page_number.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None, ext: AnalyzeArgument | None = None) -> AnalyzeResult:
        given = {"size": size, "overlap": overlap, "ext": ext}
        for name, a in given.items():
            if a is not None and not a.isConstantExpression:
                raise ValueError(f"{name} must be constant")
        if text.dataType.simpleString() not in ("string", "void"):
            raise ValueError("text must be a string")
        check(size.value if size else 1000, overlap.value if overlap else 200)
        fields = [c.split() for c in (CHUNKS if ext is None or ext.value is None else CODE).split(",")]
        return AnalyzeResult(StructType([StructField(n, StringType() if kind == "string" else IntegerType()) for n, kind in fields]))

    def eval(self, text: str, size: int = 1000, overlap: int = 200, ext: str | None = None) -> Iterator[tuple]:
        yield from chunk_rows(text, size, overlap) if ext is None else code_rows(text, ext, size, overlap)


def register(spark: SparkSession) -> None:
    """Let SQL call chunk()."""
    spark.udtf.register("chunk", udtf(Chunk))
