"""Vector search and what is made of its hits: context, citations, evaluation.

Queries are a stated set: few are sent to the tasks after their number is checked, more
are dealt in blocks.  A score is computed once per pair, in Arrow batches, before it is
filtered, and only what can rank goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.models import Generator, generated
from ..functions.text import snippet

THRESHOLD, K = 0.3, 5
#: Queries held by a task at once (8 bytes a component).
QUERY_BLOCK = 2048
#: Points of a block that meets a block of queries in one task.
POINT_BLOCK = 65536
NOTHING_FOUND = "No relevant documents found."


def normalised(vec: Column) -> Column:
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vec, lambda x: x.cast("double") / norm))


def scored(ids: np.ndarray, matrix: np.ndarray, points: pa.RecordBatch | pa.Table, threshold: float, k: int | None, by: str | None = None) -> list[pa.Table]:
    """Of a piece of points the k best of every query (and value of column ``by``), or all from the threshold on."""
    out = []
    at = points.schema.names.index("vector")
    rest = [c for c in points.schema.names if c != "vector"]
    group = np.zeros(points.num_rows, np.int64)
    if by is not None:
        group = pa.array(points.column(rest.index(by) if rest.index(by) < at else rest.index(by) + 1).to_pylist()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    for low in range(0, points.num_rows, 512):
        part = points.slice(low, 512)
        vector = part.column(at)
        vector = vector.combine_chunks() if isinstance(vector, pa.ChunkedArray) else vector
        x = vector.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
        s = np.zeros((len(ids), len(x)))
        for j in range(x.shape[1]):  # one order of additions for all pairs
            s += np.outer(matrix[:, j], x[:, j])
        q, p = np.nonzero(s >= threshold)
        score = s[q, p]
        if k is not None and len(q):
            own = group[low:low + 512][p]
            point = part.column(part.schema.names.index("point_id")).to_numpy(zero_copy_only=False)[p]
            order = np.lexsort((point, -score, own, q))
            q, p, score, own = q[order], p[order], score[order], own[order]
            new = np.append(True, (q[1:] != q[:-1]) | (own[1:] != own[:-1])) if len(q) else np.empty(0, bool)
            first = np.flatnonzero(new)
            keep = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k
            q, p, score = q[keep], p[keep], score[keep]
        columns = [part.column(part.schema.names.index(c)).take(pa.array(p)) for c in rest]
        out.append(pa.table([pa.array(ids[q], pa.int64()), pa.array(score, pa.float64()), *columns], names=["query_id", "score", *rest]))
    return out


def similar(points: DataFrame, queries: DataFrame, threshold: float = THRESHOLD, block: int = QUERY_BLOCK, k: int | None = None, by: str | None = None) -> DataFrame:
    """(query, point) pairs of cosine >= threshold: query_id, score and the columns of
    points but vector.  With ``k`` each piece of points gives at most k for a query (and
    value of ``by``; points then need point_id), so what goes on is no more than can rank.

    ``points`` has vector, ``queries`` has query_id and vector.  Up to ``block`` queries
    go to the tasks that read the points; more are dealt in blocks, and blocks of queries
    meet blocks of points by a shuffle.  Null and zero vectors are similar to nothing.
    """
    q = queries.select("query_id", normalised(F.col("vector")).alias("vector")).where("vector is not null")
    ready = points.withColumn("vector", normalised(F.col("vector"))).where("vector is not null")
    schema = ", ".join(["query_id long", "score double", *(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields if f.name != "vector")])
    few = q.limit(block + 1).toArrow()  # bounded by ``block``
    if few.num_rows <= block:
        ids, matrix = few.column("query_id").to_numpy(), np.array(few.column("vector").to_pylist())

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches if len(ids) else ():
                for table in scored(ids, matrix, batch, threshold, k, by):
                    yield from table.combine_chunks().to_batches()

        return ready.mapInArrow(score, schema)
    n, m = q.count(), ready.count()
    many, groups = -(-n // block), -(-m // POINT_BLOCK)
    left = ready.withColumns({"__g": F.pmod(F.xxhash64(*points.columns), F.lit(groups)), "__b": F.explode(F.sequence(F.lit(0), F.lit(many - 1)))})
    right = q.withColumns({"__b": F.pmod(F.xxhash64("query_id"), F.lit(many)).cast("int"), "__g": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))})

    def cell(p: pa.Table, asked: pa.Table) -> pa.Table:
        ids, matrix = asked.column("query_id").to_numpy(), np.array(asked.column("vector").to_pylist())
        own = p.drop_columns(["__g", "__b"])
        found = scored(ids, matrix, own, threshold, k, by) if own.num_rows and len(ids) else []
        rest = [c for c in own.schema.names if c != "vector"]
        none = pa.table([pa.array([], pa.int64()), pa.array([], pa.float64()), *(own.column(c).slice(0, 0) for c in rest)], names=["query_id", "score", *rest])
        return pa.concat_tables([none, *found])

    return left.groupBy("__g", "__b").cogroup(right.groupBy("__g", "__b")).applyInArrow(cell, schema)


def _top(df: DataFrame, keys: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def best_ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k hits of highest score of every query, ties to the smaller point_id."""
    return _top(hits, ["query_id"], [F.desc("score"), "point_id"], k)


def retrieve(points: DataFrame, queries: DataFrame, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """The k best hits of every query over all collections; ties to the smaller point_id."""
    return best_ranked(similar(points, queries, threshold, k=k), k)


def retrieve_multi(points: DataFrame, queries: DataFrame, collections: int, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """ceil(k / collections) hits of each collection, then the k best of those."""
    each = max(1, -(-k // collections))
    first = _top(similar(points, queries, threshold, k=each, by="collection"), ["query_id", "collection"], [F.desc("score"), "point_id"], each, "place")
    return _top(first, ["query_id"], [F.desc("score"), "collection", "point_id"], k).drop("place")


def or_else(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def context(hits: DataFrame) -> DataFrame:
    """query_id, context: ``[Source i: file, Page p]`` blocks in rank order.  ``hits``
    has rank, content, text, source_file, filename, page (string)."""
    file = F.coalesce(or_else(F.col("source_file"), F.col("filename")), F.lit("Unknown"))
    block = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(": "), file, F.lit(", Page "), F.coalesce(F.col("page").cast("string"), F.lit("N/A")), F.lit("]\n"), F.coalesce(or_else(F.col("content"), F.col("text")), F.lit("")))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n---\n\n").alias("context"))


def citations(hits: DataFrame) -> DataFrame:
    """One row for each (document_id, page, chunk_id) of a query, the best ranked, with a snippet."""
    keyed = hits.select("query_id", "rank", F.coalesce("document_id", F.lit(0)).alias("document_id"), F.coalesce(F.col("page"), F.col("page_number")).alias("page"), F.coalesce(or_else(F.col("filename"), F.col("source_file")), F.lit("Unknown")).alias("filename"), or_else(F.col("chunk_id"), F.col("point_id").cast("string")).alias("chunk_id"), snippet(F.coalesce(or_else(F.col("text"), F.col("content")), F.lit(""))).alias("chunk_text"), "score")
    return _top(keyed, ["query_id", "document_id", "page", "chunk_id"], ["rank"], 1, "__first").drop("__first")


def evaluation(agents: DataFrame, points: DataFrame, vectors: DataFrame, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """Hits of every test question of every agent: agents has agent_id and
    test_questions array<struct<question_id, question>>, vectors question_id and vector."""
    asked = agents.select("agent_id", F.explode("test_questions").alias("q")).select("agent_id", "q.question_id", "q.question")
    hits = retrieve(points, vectors.select(F.col("question_id").alias("query_id"), "vector"), k, threshold)
    return asked.join(hits.withColumnRenamed("query_id", "question_id"), "question_id", "left")


def answers(questions: DataFrame, hits: DataFrame, model: Generator | None = None, system: str = "", paths: DataFrame | None = None) -> DataFrame:
    """query_id, question, context, answer, n_sources: retrieve, then generate.  ``hits`` as for
    ``context``; ``paths`` (query_id, rendered) are added where known.  A question without hits is answered
    ``NOTHING_FOUND`` and costs no call."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("n_sources"))
    out = questions.select("query_id", "question").join(context(hits), "query_id", "left").join(n, "query_id", "left").na.fill(0, ["n_sources"])
    note = F.lit("")
    if paths is not None:
        out = out.join(paths.select("query_id", F.col("rendered").alias("__path")), "query_id", "left")
        note = F.coalesce(F.concat(F.lit("\n\nReasoning Path (entity connections): "), "__path"), F.lit(""))
    prompt = F.concat(F.lit(system + "\n"), note, F.lit("\n\nContext:\n"), "context")
    answer = F.coalesce(generated(F.when(F.col("n_sources") > 0, prompt), F.col("question"), model), F.lit(NOTHING_FOUND))
    return out.select("query_id", "question", F.coalesce("context", F.lit(NOTHING_FOUND)).alias("context"), answer.alias("answer"), "n_sources")
