"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..operators.chunking import OVERLAP, SIZE, split_recursively


@udtf
class Chunks:
    """``chunks(TABLE(docs) [, size [, overlap]])``: every row's text cut to chunks.

    Columns are those of the table but ``text``, then chunk_index (from 0), total_chunks and
    content.  Rows stay where they are read, so nothing is shuffled.
    """

    @staticmethod
    def analyze(docs: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not docs.isTable or "text" not in docs.dataType.names:
            raise ValueError("the first argument must be a table with a column text")
        kept = [f for f in docs.dataType.fields if f.name != "text"]
        return AnalyzeResult(StructType([*kept, StructField("chunk_index", IntegerType()), StructField("total_chunks", IntegerType()), StructField("content", StringType())]))

    def eval(self, row: Row, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple]:
        kept = [row[c] for c in row.__fields__ if c != "text"]
        found = split_recursively(row["text"] or "", size, overlap)
        for i, content in enumerate(found):
            yield *kept, i, len(found), content


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    spark.udtf.register("chunks", Chunks)
