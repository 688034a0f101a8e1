"""Quality rules: plain limits on a text's counts, then gradient-boosted trees over
its statistics.

All counts and features are of whole texts.  The trees are fitted on at most ``TRAIN_ROWS`` labelled documents (those
whose id has the smallest hashes), held monotonic in the features of ``MONOTONE``,
and travel to the tasks as small node arrays.

Defined cases: a null text has no words and fails the limits; a null id is kept as
it is and has no label; rows of one id are judged each on its own; of labels that
contradict each other for one id the higher counts; without labels of both kinds
the limits alone decide; texts of any length are taken whole; documents of equal score
are judged alike; an empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosted_trees
from .common import slices
from .doc_stats import COUNTS, FEATURES, text_stats

#: Labelled documents that the trees are fitted on, at most (about 60 bytes each on the driver).
TRAIN_ROWS = 20_000
#: A document is kept from this probability of good quality on.
KEEP_FROM = 0.25
#: More symbols, repeated lines or repeated words never raise the score; more distinct words never lower it.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 1}
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, raw, off in slices(batch, "text"):
            counts, features = text_stats(raw, off)
            keep = [i for i, c in enumerate(rows.schema.names) if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [rows.column(i) for i in keep] + [pa.array(counts[c]) for c in COUNTS] + [pa.FixedSizeListArray.from_arrays(pa.array(features.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))],
                names=[rows.schema.names[i] for i in keep] + COUNTS + ["features"],
            )


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> boosted_trees.Trees:
    """Trees for ``labels`` (doc_id, quality) over at most ``rows`` labelled documents;
    if these are all of one kind, a model that gives every document 1."""
    wanted = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("wanted_id")).agg(F.max("quality").cast("int").alias("wanted_quality"))
    wanted = wanted.orderBy(F.xxhash64("wanted_id"), "wanted_id").limit(rows)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    few = base.join(F.broadcast(wanted), F.col("doc_id") == F.col("wanted_id")).select("doc_id", "wanted_quality", "text")
    few = few.mapInArrow(_stats, "doc_id long, wanted_quality int, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<float>")
    sample = few.select("doc_id", "wanted_quality", "features").orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(rows).toArrow()
    x = np.array(sample.column("features").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = (sample.column("wanted_quality").to_numpy() > 0).astype(float)
    if not 0 < y.sum() < len(y):
        return replace(boosted_trees.fit(x[:0], y[:0]), bias=np.inf)
    return boosted_trees.fit(x, y, {FEATURES.index(k): v for k, v in MONOTONE.items()})


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, the counts, base_failed, score (probability of good quality), kept."""
    model = fit_quality(docs, labels, id_col, text_col, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, off in slices(batch, "text"):
                counts, features = text_stats(raw, off)
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(counts[c]) for c in COUNTS), pa.array(model.predict(features))], names=["doc_id", *COUNTS, "score"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return verdict(base.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double"), keep_from)


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts and base_failed, without a model."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = base.mapInArrow(_stats, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<float>")
    return out.select("doc_id", *COUNTS, base_failed().alias("base_failed"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def verdict(scored: DataFrame, keep_from: float) -> DataFrame:
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= keep_from))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that are kept, all their columns as they are.  The
    verdict is made again beside each row, so no text is shuffled."""
    model = fit_quality(docs, labels, id_col, text_col, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, off in slices(batch, text_col):
                counts, x = text_stats(raw, off)
                failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
                yield rows.filter(pa.array(~failed & (model.predict(x) >= keep_from)))

    return docs.mapInArrow(run, docs.schema)
