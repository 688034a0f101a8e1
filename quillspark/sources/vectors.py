"""A stored collection of vectors that a search reads only in part.

Points are dealt to lists by their nearest centroid (spherical k-means on a bounded sample)
and written with the list's number as a folder, the centroids beside them.  A search asks
the lists of a query's nearest centroids alone: the folders of other lists are pruned before
a file is opened, so what is read falls with the share of lists that are probed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import K, THRESHOLD, best_ranked, normalised, scored

#: Vectors that centroids are fitted on, and lists, at most.
SAMPLE, MOST_LISTS = 8192, 1024
#: Queries that a task holds; more are answered in as many reads.
QUERIES = 2048
#: The list of null and zero vectors, which are similar to nothing.
NOWHERE = -1


def _centroids(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors."""
    c = x[np.random.default_rng(7).choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        total = np.zeros_like(c)
        np.add.at(total, (x @ c.T).argmax(1), x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return c


def _nearest(vectors: pa.Array, c: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centroids of each unit vector."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    return np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :n]


def write_index(points: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE) -> int:
    """Writes ``points`` (vector and any other columns) to a new ``path``; gives the number of lists.
    By default there are as many lists as the root of the number of points, ``MOST_LISTS`` at most."""
    unit = points.withColumn("__u", normalised(F.col("vector")))
    able = unit.where("__u is not null")
    n = able.count()
    fitted = able.select("__u").orderBy(F.xxhash64("__u"), "__u").limit(sample).toArrow().column(0).combine_chunks()
    x = fitted.flatten().to_numpy(zero_copy_only=False).reshape(len(fitted), -1) if len(fitted) else np.zeros((0, 1))
    count = min(len(x), lists or max(1, min(MOST_LISTS, round(n**0.5))))
    c = _centroids(x, count) if count else x

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = batch.column(batch.num_columns - 1)
            own = np.full(batch.num_rows, NOWHERE, np.int32)
            some = u.is_valid().to_numpy(zero_copy_only=False)
            if some.any():
                own[some] = _nearest(u.filter(pa.array(some)), c, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own)], names=[*batch.schema.names[:-1], "list"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    dealt = unit.mapInArrow(deal, f"{kinds}, list int")
    # files of even size: large lists are split, small ones are not scattered
    dealt.hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/lists")
    spark = points.sparkSession
    spark.createDataFrame([(i, v) for i, v in enumerate(c.tolist())], "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    return count


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """All points, with their list."""
    return spark.read.parquet(f"{path}/lists")


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = K, threshold: float = THRESHOLD, probes: int | None = None) -> DataFrame:
    """query_id, score, rank and the points' columns but vector: the ``k`` best of the points in the
    ``probes`` nearest lists of every query (query_id, vector), all lists if None; ties to the smaller point_id.
    Scores are exact, as ``retrieval.retrieve`` has them."""
    table = spark.read.parquet(f"{path}/centroids").orderBy("list").toArrow()  # MOST_LISTS rows at most
    c = np.array(table.column("centroid").to_pylist())
    points = read_index(spark, path)
    ready = points.withColumn("vector", normalised(F.col("vector")))
    names = [f.name for f in points.schema.fields if f.name != "vector"]
    schema = ", ".join(["query_id long", "score double", *(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields if f.name != "vector")])
    asked = queries.select("query_id", normalised(F.col("vector")).alias("vector")).where("vector is not null")
    out = ready.limit(0).select(F.lit(0).cast("long").alias("query_id"), F.lit(0.0).alias("score"), *names)
    block: list = []

    def answered(rows: list) -> DataFrame:
        ids, matrix = np.array([r["query_id"] for r in rows]), np.array([r["vector"] for r in rows])
        near = np.argsort(-(matrix @ c.T), axis=1, kind="stable")[:, :probes or len(c)]
        who = {int(i): np.flatnonzero((near == i).any(1)) for i in np.unique(near)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(batch.schema.names.index("list")).to_numpy()
                for i in np.unique(own):
                    mine = who[int(i)]
                    for found in scored(ids[mine], matrix[mine], batch.filter(pa.array(own == i)), threshold, k):
                        yield from found.combine_chunks().to_batches()

        return ready.where(F.col("list").isin([int(i) for i in who])).mapInArrow(run, schema)

    for row in asked.toLocalIterator() if len(c) else ():
        block.append(row)
        if len(block) == QUERIES:
            out, block = out.unionByName(answered(block)), []
    if block:
        out = out.unionByName(answered(block))
    return best_ranked(out, k)
