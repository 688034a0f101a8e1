"""Quality by positive-unlabelled learning.

Trusted positives (labelled good) and unlabelled texts (all training documents, whatever
their labels: a sample of all texts) fit an additive logistic model over binned statistics of
whole texts by the non-negative unbiased risk

    pi E_P[l(z)] + max(0, E_U[l(-z)] - pi E_P[l(-z)]),   l(z) = log(1 + exp(-z)),

plus a ridge.  Bad labels are never used.  The class prior pi is estimated from positives and
unlabelled texts alone: models cross-fitted on two halves score the other half, and pi is the
smallest share of unlabelled texts over the share of positives above a score, with a margin
for the size of both samples (the best bin).

Everything is a sum over all training rows: bin edges come from counts of all values, and
each Newton step is one pass that adds up risks, gradients and curvatures, tasks first.  Where
the estimated risk of the negatives falls clearly below zero (by BETA) the weights are fitted
to noise: the step is halved until it is not, and those of least risk are kept.
The texts are read once; what stays is one byte a statistic for each document.

Defined cases: a null text is the empty one and is scored as such; a null id is no training
label's; rows of one id are documents each; labels that contradict each other for one id count
as the higher; without positives in the training rows every score is 0.5; texts of any length
are taken whole; equal texts get equal scores; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices
from .doc_stats import FEATURES, text_stats

#: Bins of a statistic, at most.
BINS = 12
#: Added to the risk is half of RIDGE + SHRINK / positives times the squares of the weights.
RIDGE, SHRINK = 0.03, 10.0
#: Newton steps of a fit, at most; a fit ends before when no weight moves by SMALL.
STEPS, SMALL = 12, 1e-3
#: No weight moves further in one step.
FARTHEST = 2.0
#: The estimated risk of the negatives may fall this far below zero.
BETA = 0.1
#: The prior of the models that estimate the prior (their scores only order the texts).
FIRST_PRIOR = 0.5
#: Score from which on a text is predicted to be good.
GOOD_FROM = 0.7
#: Confidence of the margin of the prior, and its weight.
DELTA, GAMMA = 0.1, 0.01
#: Places of the histogram of scores, over z from -REACH to REACH.
PLACES, REACH = 4096, 32.0
#: A value is kept as the upper half of its 32-bit float (which orders values of 0 and more), so to 1 %.
KINDS = 1 << 15

STATS = "doc_id long, held_out boolean, bits binary"


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


# --- the risk and its minimum ------------------------------------------------------------------

@dataclass
class Sums:
    """What one pass adds up for a model over unlabelled rows (u) and positives (p)."""

    n_u: float
    n_p: float
    loss_u: float  # l(-z)
    loss_p: float  # l(z)
    back_p: float  # l(-z)
    slope_u: np.ndarray  # of l(-z)
    at_p: np.ndarray  # positives with each weight
    curve: np.ndarray  # of l(-z) over u

    @staticmethod
    def size(d: int) -> int:
        return 5 + 2 * d + d * d

    @staticmethod
    def of(flat: np.ndarray, d: int) -> Sums:
        return Sums(*flat[:5].tolist(), *flat[5:5 + 2 * d].reshape(2, d), flat[5 + 2 * d:].reshape(d, d))


def row_sums(codes: np.ndarray, unlabelled: np.ndarray, positive: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The ``Sums`` of some rows, flat.  ``codes``: the weights that each row adds up."""
    d, (rows, width) = len(w), codes.shape
    z = w[codes].sum(1)
    u, p = unlabelled.astype(float), positive.astype(float)
    s = _sigmoid(z)
    slopes = [np.bincount(codes.ravel(), weights=np.repeat(x, width), minlength=d) for x in (u * s, p)]
    curve = np.zeros(d * d)
    for i in range(width):
        pairs = (codes[:, i:i + 1] * d + codes).ravel()
        curve += np.bincount(pairs, weights=np.repeat(u * s * (1 - s), width), minlength=d * d)
    loss = _softplus(z)
    return np.concatenate([[u.sum(), p.sum(), u @ loss, p @ _softplus(-z), p @ loss], *slopes, curve])


class Fit:
    """Minimises the non-negative risk: one Newton step for each set of sums."""

    def __init__(self, d: int, prior: float):
        self.w, self.prior, self.free = np.zeros(d), prior, np.arange(d) > 0  # the constant is not held
        self.best, self.least, self.done = self.w, math.inf, False

    def ridge(self, s: Sums) -> np.ndarray:
        return np.where(self.free, RIDGE + SHRINK / s.n_p, 1e-6)

    def risk(self, s: Sums) -> tuple[float, float]:
        """The risk with the ridge, and its part that is the estimated risk of the negatives."""
        negative = s.loss_u / s.n_u - self.prior * s.back_p / s.n_p
        return self.prior * s.loss_p / s.n_p + max(0.0, negative) + 0.5 * float(self.ridge(s) @ self.w**2), negative

    def step(self, s: Sums) -> None:
        """Goes on from weights that lower the risk; goes half way back from others, and from
        those at which the risk of the negatives is clearly below zero."""
        risk, negative = self.risk(s)
        if negative >= -BETA and risk < self.least:
            self.best, self.least = self.w, risk
            slope = s.slope_u / s.n_u - self.prior * s.at_p / s.n_p + self.ridge(s) * self.w  # as l(z) - l(-z) = -z
            move = np.linalg.solve(s.curve / s.n_u + np.diag(self.ridge(s)), slope)
            move *= min(1.0, FARTHEST / max(float(np.abs(move).max()), 1e-12))
        else:
            move = 0.5 * (self.w - self.best)
        self.w, self.done = self.w - move, float(np.abs(move).max()) < SMALL


def best_bin(u: np.ndarray, p: np.ndarray, delta: float = DELTA, gamma: float = GAMMA) -> float:
    """The class prior from histograms of scores of unlabelled rows and of positives."""
    n_u, n_p = u.sum(), p.sum()
    share_u, share_p = np.cumsum(u[::-1]) / n_u, np.cumsum(p[::-1]) / n_p
    margin = math.sqrt(math.log(4 / delta) / (2 * n_u)) + math.sqrt(math.log(4 / delta) / (2 * n_p))
    some = share_p > 0
    at = np.argmin((share_u[some] + (1 + gamma) * margin) / share_p[some])
    return float(np.clip(share_u[some][at] / share_p[some][at], 0.01, 0.99))


# --- passes over all rows ------------------------------------------------------------------------

@dataclass(frozen=True)
class Model:
    """Weights of the bins; ``table`` has the weight that each value of a statistic adds."""

    table: np.ndarray  # statistics x KINDS, numbers of weights
    w: np.ndarray
    prior: float

    def codes(self, bits: np.ndarray) -> np.ndarray:
        out = self.table[np.arange(len(self.table)), bits]
        return np.column_stack([np.zeros(len(bits), out.dtype), out])

    def score(self, bits: np.ndarray) -> np.ndarray:
        return _sigmoid(self.w[self.codes(bits)].sum(1))


def feature_bits(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    return (np.ascontiguousarray(text_stats(raw, off)[1]).view(np.uint32) >> np.uint32(16)).astype(np.uint16)


def _bits(column: pa.Array) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint16).reshape(-1, len(FEATURES))


def _added(stats: DataFrame, size: int, part: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part`` (bits, training, positive, fold) over all rows: by task, then by tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(_bits(batch.column(0)), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    rows = stats.select("bits", ~F.col("held_out"), "positive", "fold").mapInArrow(run, "total binary").rdd
    return rows.map(lambda r: np.frombuffer(bytes(r[0]))).treeAggregate(np.zeros(size), np.add, np.add)


def bin_table(stats: DataFrame, bins: int = BINS) -> tuple[np.ndarray, int]:
    """The weight of every value of every statistic (bins hold even shares of the training
    rows), and the number of weights; 0 is the constant's."""
    width = len(FEATURES)

    def part(bits: np.ndarray, training: np.ndarray, *_) -> np.ndarray:
        return np.bincount((bits[training] + np.arange(width) * KINDS).ravel(), minlength=width * KINDS)

    counts = _added(stats, width * KINDS, part).reshape(width, KINDS)
    table, base = np.zeros((width, KINDS), np.int64), 1
    for j, n in enumerate(counts):
        below = np.cumsum(n)
        cuts = np.unique(np.searchsorted(below, below[-1] * np.arange(1, bins) / bins, side="left"))
        table[j] = base + np.searchsorted(cuts, np.arange(KINDS), side="left")
        base += len(cuts) + 1
    return table, base


def _fit(stats: DataFrame, table: np.ndarray, d: int, prior: float, folds: int, steps: int = STEPS) -> list[np.ndarray]:
    """Weights fitted on the rows outside each of the folds (on all rows if ``folds`` is 1)."""
    fits = [Fit(d, prior) for _ in range(folds)]
    for _ in range(steps):
        at = [f.w for f in fits]

        def part(bits: np.ndarray, training: np.ndarray, positive: np.ndarray, fold: np.ndarray, at=at) -> np.ndarray:
            codes = Model(table, at[0], prior).codes(bits)
            mine = [training if folds == 1 else training & (fold != k) for k in range(folds)]
            return np.concatenate([row_sums(codes[m], np.ones(m.sum()), positive[m], w) for m, w in zip(mine, at, strict=True)])

        flat = _added(stats, folds * Sums.size(d), part).reshape(folds, -1)
        sums = [Sums.of(x, d) for x in flat]
        if any(not s.n_p for s in sums):
            break
        for f, s in zip(fits, sums, strict=True):
            f.step(s)
        if all(f.done for f in fits):
            break
    return [f.best for f in fits]


def class_prior(stats: DataFrame, table: np.ndarray, d: int) -> float:
    """Estimated from scores that two models give the half each has not seen."""
    halves = _fit(stats, table, d, FIRST_PRIOR, 2)

    def part(bits: np.ndarray, training: np.ndarray, positive: np.ndarray, fold: np.ndarray) -> np.ndarray:
        codes = Model(table, halves[0], 0).codes(bits)
        z = np.where(fold == 0, halves[0][codes].sum(1), halves[1][codes].sum(1))
        place = np.clip((z + REACH) * (PLACES / (2 * REACH)), 0, PLACES - 1).astype(int)
        return np.concatenate([np.bincount(place[m], minlength=PLACES) for m in (training, training & positive)])

    u, p = _added(stats, 2 * PLACES, part).reshape(2, PLACES)
    return best_bin(u, p) if p.sum() else FIRST_PRIOR


# --- documents -------------------------------------------------------------------------------------

def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, raw, off in slices(batch, "text"):
            bits = feature_bits(raw, off)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([x.tobytes() for x in bits], pa.binary())], names=["doc_id", "held_out", "bits"])


def measured(docs: DataFrame, labels: DataFrame, held_out: Column | None, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, bits (the statistics), positive, fold of every document."""
    out = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), out.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(_measured, STATS)
    good = labels.where("doc_id is not null and quality > 0").select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    both = base.join(good, F.col("doc_id") == F.col("good_id"), "left")
    positive = F.col("good_id").isNotNull() & ~F.col("held_out")
    return scratch.stored(both.select("doc_id", "held_out", "bits", positive.alias("positive"), F.pmod(F.xxhash64("doc_id", "bits"), F.lit(2)).cast("int").alias("fold")), "statistics")


def learn(stats: DataFrame, prior: float | None = None) -> Model:
    """A model of ``measured`` documents; without positives, one that scores everything 0.5."""
    table, d = bin_table(stats)
    if stats.where("positive").isEmpty():
        return Model(table, np.zeros(d), FIRST_PRIOR)
    prior = class_prior(stats, table, d) if prior is None else prior
    return Model(table, _fit(stats, table, d, prior, 1)[0], prior)


def score_documents(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", prior: float | None = None, good_from: float = GOOD_FROM) -> DataFrame:
    """doc_id, held_out, score (that the text is good), predicted.  Labels of ``held_out`` rows are never read."""
    stats = measured(docs, labels, held_out, id_col, text_col, Scratch(docs.sparkSession))
    model = learn(stats, prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = model.score(_bits(batch.column(2)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= good_from).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return stats.select("doc_id", "held_out", "bits").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of other documents by a model that has been learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, off in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.score(feature_bits(raw, off)))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
