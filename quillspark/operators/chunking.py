"""Texts to chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import paragraphs

SIZE, OVERLAP = 1000, 200
#: Separators, tried in order.
SEPARATORS = ["\n\n", "\n", ". ", " ", ""]


def split_recursively(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: list[str] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters.

    A text is cut at the first separator that it holds (which stays with the piece
    after it); pieces still too long are cut by the next.  Neighbouring pieces are put
    together while they fit, and a chunk starts with whole pieces of the last one's end,
    ``overlap`` characters at most.  Chunks are stripped, empty ones left out.
    """
    def pieces(t: str, level: int) -> Iterator[str]:
        if len(t) <= size:
            yield t
            return
        while level < len(separators) - 1 and separators[level] not in t:
            level += 1
        sep = separators[level]
        if not sep:
            yield from (t[i:i + size] for i in range(0, len(t), size))
            return
        parts = t.split(sep)
        for i, part in enumerate(parts):
            piece = part if i == 0 else sep + part
            if piece:
                yield from pieces(piece, level + 1) if len(piece) > size else (piece,)

    out, held, total = [], [], 0
    for piece in pieces(text, 0):
        if held and total + len(piece) > size:
            out.append("".join(held))
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    if held:
        out.append("".join(held))
    return [s for s in (c.strip() for c in out) if s]


def chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_index (from 0), total_chunks, content of every document's recursive chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                rows = [(d, j, len(c), x) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for c in [split_recursively(t or "", size, overlap)] for j, x in enumerate(c)]
                cols = list(zip(*rows, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], names=["doc_id", "chunk_index", "total_chunks", "content"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, chunk_index int, total_chunks int, content string")


def paragraph_chunks(docs: DataFrame, separator: str = "\n\n") -> DataFrame:
    parts = docs.select("doc_id", paragraphs(F.col("text"), separator).alias("p"))
    return parts.select("doc_id", F.size("p").alias("total_chunks"), F.posexplode("p").alias("chunk_index", "content"))


def renumbered(parts: list[DataFrame], key: str = "doc_id") -> DataFrame:
    """Chunks of several kinds one after the other (in the list's order, then by their
    own chunk_index), numbered anew; columns that a kind lacks are null."""
    tagged = [p.withColumn("__kind", F.lit(i)) for i, p in enumerate(parts)]
    both = tagged[0]
    for p in tagged[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(key)
    return both.withColumns({"total_chunks": F.count("*").over(w).cast("int"), "chunk_index": (F.row_number().over(w.orderBy("__kind", "chunk_index")) - 1).cast("int")}).drop("__kind")


def kind_counts(chunk_rows: DataFrame) -> DataFrame:
    """doc_id, summary: ``n kind, …`` by first chunk of each kind."""
    each = chunk_rows.groupBy("doc_id", "content_type").agg(F.count("*").alias("n"), F.min("chunk_index").alias("first"))
    return each.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", F.concat(F.col("n").cast("string"), F.lit(" "), "content_type").alias("t")))), lambda x: x["t"]), ", ").alias("summary"))


def payload(core: dict[str, Column], extras: str) -> Column:
    """A map of the core columns over the map column ``extras``: core keys win."""
    return F.map_concat(F.col(extras), F.create_map(*(x for k, v in core.items() for x in (F.lit(k), v.cast("string")))))
