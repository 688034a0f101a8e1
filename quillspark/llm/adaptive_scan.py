"""Approximate nearest neighbours by an adaptive scan of rotated dimensions.

Nearness is the inner product.  Vectors get one more component so that all have the
norm of the longest; then the largest inner product is the smallest distance.  They
are dealt to the lists of nearest centroids (k-means on a bounded sample; every
vector is dealt).  A query probes its nearest lists: as many as hold the share ``AIM`` of the
nearest neighbours within the sample, so clustered vectors need few and vectors without any
structure most of them.  Inside a list, vectors and query are turned by one random rotation,
so that any first d components are a fair sample of the distance, and are read in blocks of
columns: after each block a candidate is abandoned when its distance so far is larger than
what a candidate within the query's present 20th distance would show, at ``EPSILON`` standard
errors.  What is left gets its exact inner product, in double precision, on the vectors as
given.  The sample serves for centroids, for the number of lists and for a first limit (the
20th distance within the probed lists); every result comes out of a scanned list.

Lists are cut into tiles of bounded numbers of vectors and queries, so one list that holds a
third of all rows is many tasks.  Defined cases: vectors that are
null, all zero, of another length than most, or that hold null or non-finite
components take no part, nor do null ids; rows with equal id and vector are one
candidate, and rows of one id are never candidates of a query with that id; ties go to the smaller id; with fewer candidates than
wanted all are given; an empty table gives an empty result; other columns are ignored.
(Products of vectors of different lengths are not defined; components may be floats or doubles.)
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

NEAREST = 20
#: Vectors that centroids, the number of probed lists and first limits are fitted on, at most.
SAMPLE = 8192
MOST_LISTS = 1024
#: Share of a query's nearest neighbours that the probed lists should hold, and the vectors of
#: the sample whose neighbours tell how many lists that takes.
AIM, ASKED = 0.98, 512
#: A query's lists hold so many times the wanted vectors at least.
PLENTY = 8
#: Standard errors of the test that abandons a candidate.
EPSILON = 2.5
#: Columns read at a time.
BLOCK = 16
#: Vectors and queries of a tile: twice what a list holds on average, within these bounds.
FEWEST, MOST = 1024, 16384
#: Queries of a tile that are compared with its vectors at once.
AT_ONCE = 256
_SEED = 11


def _kind(df: DataFrame, vec_col: str) -> str:
    """Components are read as they are stored, so that scores are those of the original vectors."""
    kind = getattr(df.schema[vec_col].dataType, "elementType", None)
    return "float" if kind is not None and kind.simpleString() == "float" else "double"


def _usable(df: DataFrame, id_col: str, vec_col: str, is_query: Column) -> DataFrame:
    """id, vec, is_query of rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{_kind(df, vec_col)}>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    return rows.where("id is not null and vec is not null and size(vec) > 0").where(~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0))


def _matrix(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """One more component, so that all rows have length ``norm``."""
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(norm * norm - (x * x).sum(1), 0))])


def _flat(q: np.ndarray) -> np.ndarray:
    return np.column_stack([q.astype(np.float64), np.zeros(len(q))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T


def centroids(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's k-means from a seeded choice of rows."""
    rng = np.random.default_rng(_SEED)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        own = _distances(x, c).argmin(1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def products(x: np.ndarray, q: np.ndarray, px: np.ndarray, pq: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, added up in one order for every pair, so that
    equal vectors tie."""
    out = np.zeros(len(px))
    for j in range(x.shape[1]):
        out += x[px, j].astype(np.float64) * q[pq, j].astype(np.float64)
    return out


def probes_needed(x: np.ndarray, q: np.ndarray, center: np.ndarray, k: int, aim: float = AIM, asked: int = ASKED) -> int:
    """How many nearest lists hold the share ``aim`` of the ``k`` nearest neighbours within ``x``
    of its own rows, which are ``q`` as queries."""
    some = np.random.default_rng(_SEED).choice(len(x), min(asked, len(x)), replace=False)
    d = _distances(q[some], x)
    d[np.arange(len(some)), some] = np.inf
    near = np.argsort(d, axis=1, kind="stable")[:, :max(1, min(k, len(x) - 1))]
    own = _distances(x, center).argmin(1)
    rank = np.argsort(np.argsort(_distances(q[some], center), axis=1, kind="stable"), axis=1)
    held = np.bincount(np.take_along_axis(rank, own[near], 1).ravel(), minlength=len(center)).cumsum()
    return int(np.searchsorted(held, aim * held[-1])) + 1


def scan_tile(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, q: np.ndarray, limit: np.ndarray, norm: float, turn: np.ndarray, k: int, epsilon: float, block: int):
    """Nearest of one tile: query number, row number, score.  ``limit`` is a distance
    (squared) within which a query is known to have k candidates, or infinity."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    a, b = _lifted(x, norm) @ turn, _flat(q) @ turn
    dim = a.shape[1]
    slack = {d: d / dim * (1 + epsilon / math.sqrt(d)) ** 2 for d in range(block, dim, block)}
    pairs_q, pairs_x = [], []
    for i in range(len(b)):
        if i % AT_ONCE == 0:
            first = _distances(b[i:i + AT_ONCE, :block], a[:, :block])
        part, limit_i = first[i % AT_ONCE], limit[i]
        # the k that look nearest so far stay: there are always k to report, and their distances bound the k-th
        some = np.argpartition(part, k)[:k + 1] if len(ids) > k + 1 else np.arange(len(ids))
        some = some[ids[some] != queries[i]][:k]
        if len(some) == k:
            limit_i = min(limit_i, float(((a[some] - b[i]) ** 2).sum(1).max()))
        limit_i = limit_i * (1 + 1e-9) + 1e-12
        alive = np.flatnonzero(part <= limit_i * slack.get(block, 1.0))
        part = part[alive]
        for d in range(block, dim, block):
            if not len(alive):
                break
            diff = a[alive, d:d + block] - b[i, d:d + block]
            part = part + np.einsum("ij,ij->i", diff, diff)
            stay = part <= limit_i * slack.get(d + block, 1.0)
            alive, part = alive[stay], part[stay]
        alive = np.union1d(alive[ids[alive] != queries[i]], some)
        pairs_q.append(np.full(len(alive), i))
        pairs_x.append(alive)
    pq, px = np.concatenate(pairs_q), np.concatenate(pairs_x)
    score = products(x, q, px, pq)
    best = np.lexsort((ids[px], -score, pq))
    pq, px, score = pq[best], px[best], score[best]
    begin = np.searchsorted(pq, np.arange(len(b)))
    keep = np.arange(len(pq)) - begin[pq] < k
    return pq[keep], ids[px[keep]], score[keep]


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = NEAREST, sample: int = SAMPLE, aim: float = AIM, epsilon: float = EPSILON, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row of ``is_query``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    kind = _kind(vectors, vec_col)
    result = "query_id long, vec_id long, score double"
    rows = _usable(vectors, id_col, vec_col, is_query)
    sizes = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("norm2")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, norm = sizes[0]["dim"], sizes[0]["n"], math.sqrt(sizes[0]["norm2"])
    rows = rows.where(F.size("vec") == dim)
    fitted = rows.orderBy(F.xxhash64("id", "vec"), "id").limit(sample).select("id", "vec").toArrow()
    sample_ids, sample_vec = fitted.column("id").to_numpy(), _matrix(fitted.column("vec"), dim)
    sample_x = _lifted(sample_vec, norm)
    center = centroids(sample_x, max(1, min(MOST_LISTS, round(math.sqrt(n) / 3))))
    sample_list = _distances(sample_x, center).argmin(1)
    probes = probes_needed(sample_x, _flat(sample_vec), center, max(1, round(k * len(sample_x) / n)), aim)
    turn = rotation(dim + 1)

    def deal(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            for at in range(0, len(x), 4096):
                own = _distances(_lifted(x[at:at + 4096], norm), center).argmin(1)
                part = batch.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.astype(np.int32))], names=["id", "vec", "is_query", "list"])

    dealt = scratch.stored(rows.mapInArrow(deal, f"id long, vec array<{kind}>, is_query boolean, list int"), "lists")
    # rows of a list, and below its queries: at most MOST_LISTS numbers each
    held = {r["list"]: r["n"] for r in dealt.groupBy("list").agg(F.count("*").alias("n")).collect()}
    sizes = np.array([held.get(i, 0) for i in range(len(center))])

    def aimed_at(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            for at in range(0, len(x), 512):
                part, q = batch.slice(at, 512), _flat(x[at:at + 512])
                near = np.argsort(_distances(q, center), axis=1, kind="stable").astype(np.int32)
                enough = (np.cumsum(sizes[near], axis=1) < PLENTY * k).sum(1) + 1
                count = np.minimum(np.maximum(probes, enough), len(center)).astype(np.int32)
                probed = np.zeros(near.shape, bool)
                np.put_along_axis(probed, near, np.arange(near.shape[1]) < count[:, None], 1)
                d = np.where(probed[:, sample_list], np.maximum(_distances(q, sample_x), 0), np.inf)
                d[part.column(0).to_numpy()[:, None] == sample_ids[None, :]] = np.inf
                limit = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(q), np.inf)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), np.concatenate([x[:c] for x, c in zip(near, count, strict=True)]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(limit), lists], names=["id", "vec", "limit", "lists"])

    aimed = scratch.stored(dealt.where("is_query").select("id", "vec").mapInArrow(aimed_at, f"id long, vec array<{kind}>, limit double, lists array<int>"), "queries")
    asked = {r["list"]: r["n"] for r in aimed.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("n")).collect()}
    rows_each, queries_each = (min(MOST, max(FEWEST, 2 * total // len(center))) for total in (n, sum(asked.values())))
    blocks = F.array(*(F.lit(max(1, -(-held.get(i, 0) // rows_each))) for i in range(len(center))))
    chunks = F.array(*(F.lit(max(1, -(-asked.get(i, 0) // queries_each))) for i in range(len(center))))
    left = dealt.where(F.array_contains(F.array(*(F.lit(i) for i in sorted(asked))), F.col("list")) if asked else F.lit(False))
    left = left.select("list", F.pmod(F.xxhash64("id", "vec"), F.get(blocks, F.col("list"))).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.get(chunks, F.col("list")) - 1)).alias("chunk"), "id", "vec")
    right = aimed.select("id", "vec", "limit", F.explode("lists").alias("list"))
    right = right.select("list", F.explode(F.sequence(F.lit(0), F.get(blocks, F.col("list")) - 1)).alias("block"), F.pmod(F.xxhash64("id"), F.get(chunks, F.col("list"))).cast("int").alias("chunk"), "id", "vec", "limit")

    def tile(rows_: pa.Table, asked_: pa.Table) -> pa.Table:
        if not rows_.num_rows or not asked_.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        queries = asked_.column("id").to_numpy()
        pq, ids, score = scan_tile(rows_.column("id").to_numpy(), _matrix(rows_.column("vec"), dim), queries, _matrix(asked_.column("vec"), dim), asked_.column("limit").to_numpy(), norm, turn, k, epsilon, block)
        return pa.table({"query_id": queries[pq], "vec_id": ids, "score": score})

    key = ["list", "block", "chunk"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(tile, result)
    found = found.distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = scratch.stored(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
    scratch.drop(out)
    return out
