"""Ranked lexical search by Fagin's threshold algorithm over shards of documents.

Terms are the maximal runs of ASCII letters and digits and of all characters beyond ASCII,
A-Z lower-cased.  A term's weight in the collection is floor(1000 ln((2N+2)/(2df+1))); its
impact in a document, of tf occurrences among n terms, is 1000000000 tf div (1000 tf + 12 m)
with m = 75 + 25 n N div L.  A score is the sum of weight times impact over the query's terms,
repeats included, in 64-bit integers.

A first pass over the texts writes the forward index: for every document its number of
terms and the counts of those that any query of the block holds.  N, L and df are sums over
it, of all documents.  A task of the second pass reads the forward index a shard at a time,
sorts each term's documents by falling impact, and answers every query: its lists are read
round robin, a step at a time; every new document is looked up in the forward index for its
whole score; what unread documents can reach at most is the sum of the last impacts read, and
reading stops when that falls strictly below the k-th best score (so that ties are all seen).
The k-th score is carried from shard to shard, and what a task has found (at most k documents
a query) meets in two rounds of a window.  No postings are shuffled, so neither a frequent
term nor a large group of copies falls to one task; shards and blocks are bounded.

Defined cases: a null or empty text has no terms, counts in no statistic and is never found;
a document that holds none of a query's terms is not returned, nor one of score 0; rows of one
id are documents each; null ids come last among equal scores; rows of one query id are queries
each; a query without terms finds nothing; texts and queries of any length are taken whole;
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, Scratch, distinct_spans, grouped_sums, ranges, slices, word_spans

NEAREST = 20
#: Queries and their distinct terms that are answered in one pass over the texts; more are
#: answered in as many passes (the terms are held by every task).
QUERIES, TERMS = 1000, 200_000
#: Postings (16 bytes and more each) that a shard holds from which on it is searched.
SHARD = 1 << 20
#: Entries read from each list in the first round; each further round reads twice as many.
STEP = 16
#: Groups of tasks whose results meet in the first round of the window.
MEET = 64

NOT_TERM = np.ones(256, bool)
NOT_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

FORWARD = "doc_id long, n long, terms array<int>, tf array<long>"
RESULT = "item_id long, rank int, doc_id long, score long"


@dataclass(frozen=True)
class Queries:
    """A block of queries: ids, and the numbers and repeats of each one's terms."""

    ids: list[int | None]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]
    known: dict[bytes, int]


def term_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, start and end of every term, and the first term of each text (n+1)."""
    return LOWER[raw], *word_spans(raw, off, NOT_TERM)


def query_blocks(items: DataFrame, id_col: str, text_col: str, queries: int = QUERIES, terms: int = TERMS) -> Iterator[Queries]:
    """The queries, a bounded block at a time (a single query is never cut)."""
    ids, own, repeats, known = [], [], [], {}
    for item, text in items.select(F.col(id_col).cast("long"), F.col(text_col)).toLocalIterator():
        data = (text or "").encode()
        low, start, end, _ = term_spans(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        words = low.tobytes()
        numbers = [known.setdefault(words[a:b], len(known)) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        distinct, times = np.unique(np.array(numbers, np.int64), return_counts=True)
        ids.append(item)
        own.append(distinct)
        repeats.append(times)
        if len(ids) >= queries or len(known) >= terms:
            yield Queries(ids, own, repeats, known)
            ids, own, repeats, known = [], [], [], {}
    if ids:
        yield Queries(ids, own, repeats, known)


def forward_index(docs: DataFrame, known: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms with repeats) and the counts of ``known`` terms of every document that has terms."""
    kinds = max(1, len(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, off in slices(batch, "text"):
                low, start, end, first = term_spans(raw, off)
                n = np.diff(first)
                one, which = distinct_spans(low, start, end)
                data = low.tobytes()
                number = np.array([known.get(data[a:b], -1) for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)], np.int64)[which]
                some = number >= 0
                pair, tf = np.unique(np.repeat(np.arange(len(n)), n)[some] * kinds + number[some], return_counts=True)
                bounds = np.searchsorted(pair, np.arange(len(n) + 1) * kinds).astype(np.int32)
                columns = [rows.column(0), pa.array(n), pa.ListArray.from_arrays(bounds, pa.array((pair % kinds).astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(tf.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tf"]).filter(pa.array(n > 0))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, FORWARD)


def document_frequencies(forward: DataFrame, kinds: int) -> np.ndarray:
    """In how many documents each term occurs: counts of each task, then their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(kinds, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=kinds)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    out = np.zeros(kinds, np.int64)
    found = forward.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return out


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


class Shard:
    """Some documents: their forward index, and each term's list in the order of falling impact."""

    def __init__(self, doc_ids: np.ndarray, null: np.ndarray, size: np.ndarray, term: np.ndarray, impact: np.ndarray, kinds: int):
        self.doc_ids, self.null, self.size, self.term, self.impact = doc_ids, null, size, term, impact
        self.first = np.concatenate([[0], np.cumsum(size)])
        order = np.lexsort((-impact, term))
        self.list_doc = np.repeat(np.arange(len(size)), size)[order]
        self.list_impact = impact[order]
        self.list_at = np.searchsorted(term[order], np.arange(kinds + 1))
        self.weight = np.zeros(kinds, np.int64)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores of documents, looked up in the forward index (``weight`` is the query's)."""
        size = self.size[docs]
        at = np.repeat(self.first[docs], size) + ranges(size)
        return grouped_sums(self.weight[self.term[at]] * self.impact[at], size)

    def order(self, docs: np.ndarray, scores: np.ndarray) -> np.ndarray:
        return np.lexsort((self.doc_ids[docs], self.null[docs], -scores))

    def search(self, terms: np.ndarray, weight: np.ndarray, k: int, floor: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents of score above 0 that can be among the k best, their scores, and how many
        were looked up.  ``floor``: a score that k documents elsewhere are known to reach."""
        self.weight[terms] = weight
        at, stop = self.list_at[terms], self.list_at[terms + 1]
        seen = np.zeros(len(self.size), bool)
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        looked = 0
        bound = int((weight * np.where(at < stop, self.list_impact[np.minimum(at, len(self.list_impact) - 1)], 0)).sum()) if len(self.list_impact) else 0
        while bound > 0 and bound >= floor:
            take = np.minimum(step, stop - at)
            new = np.unique(self.list_doc[np.repeat(at, take) + ranges(take)])
            new = new[~seen[new]]
            seen[new] = True
            looked += len(new)
            docs, scores = np.concatenate([docs, new]), np.concatenate([scores, self.scores(new)])
            best = self.order(docs, scores)[:k]
            docs, scores = docs[best], scores[best]
            if len(scores) == k:
                floor = max(floor, int(scores[-1]))
            at = at + take
            # nothing unread of a list exceeds what was read last; a list that ended adds nothing
            bound = int((weight * np.where(at < stop, self.list_impact[at - 1], 0)).sum())
            step *= 2
        self.weight[terms] = 0
        good = scores > 0
        return docs[good], scores[good], looked


def _search(queries: Queries, weight: np.ndarray, n: int, total: int, k: int, shard: int):
    kinds = max(1, len(queries.known))
    # terms of weight 0 (held by nearly all documents) add nothing
    plans = [(t[weight[t] > 0], (weight[t] * c)[weight[t] > 0]) for t, c in zip(queries.terms, queries.repeats, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        best = [(none, none, none)] * len(plans)  # score, null, id of the best so far

        def answer(parts: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(parts).combine_chunks()
            ids, terms, tf = table.column("doc_id").combine_chunks(), table.column("terms").combine_chunks(), table.column("tf").combine_chunks()
            size = np.diff(terms.offsets.to_numpy()).astype(np.int64)
            m = 100 - 25 + 25 * table.column("n").to_numpy() * n // total
            tf = tf.flatten().to_numpy()
            impact = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, size))
            here = Shard(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), size, terms.flatten().to_numpy(), impact, kinds)
            for q, (term, w) in enumerate(plans):
                score, null, doc = best[q]
                found, s, _ = here.search(term, w, k, int(score[-1]) if len(score) == k else 0)
                if len(found):
                    score, null, doc = np.concatenate([score, s]), np.concatenate([null, here.null[found]]), np.concatenate([doc, here.doc_ids[found]])
                    top = np.lexsort((doc, null, -score))[:k]
                    best[q] = score[top], null[top], doc[top]

        parts, held = [], 0
        for batch in batches:
            parts.append(batch)
            held += len(batch.column(batch.schema.names.index("terms")).flatten())
            if held >= shard:
                answer(parts)
                parts, held = [], 0
        if held:
            answer(parts)
        task = TaskContext.get().partitionId()
        for q, (score, null, doc) in enumerate(best):
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([queries.ids[q]] * len(score), pa.int64()), pa.array(np.full(len(score), q)), pa.array(np.full(len(score), task)), pa.array(doc, mask=null.astype(bool)), pa.array(score)],
                    names=["item_id", "query", "task", "doc_id", "score"],
                )

    return run


def search(docs: DataFrame, items: DataFrame, k: int = NEAREST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score for each item."""
    spark, out = docs.sparkSession, None
    for queries in query_blocks(items, item_col, item_text_col, block):
        scratch = Scratch(spark)
        forward = scratch.stored(forward_index(docs, queries.known, id_col, text_col), "forward")
        size = forward.agg(F.count("*").alias("n"), F.sum("n").alias("total")).first()
        if not size["n"]:
            break
        weight = weights(document_frequencies(forward, max(1, len(queries.known))), size["n"])
        found = forward.mapInArrow(_search(queries, weight, size["n"], size["total"], k, shard), "item_id long, query long, task long, doc_id long, score long")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        for some in (["query", F.pmod("task", F.lit(MEET))], ["query"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*some).orderBy(*order))).where(F.col("rank") <= k)
        found = scratch.stored(found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")
        scratch.drop(found)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], RESULT) if out is None else out
