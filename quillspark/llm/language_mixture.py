"""Languages of whole texts as a mixture, by expectation-maximisation.

A language is a smoothed distribution of hashed byte trigrams (letters folded to
lower case, all else a gap), counted over all training documents.  A word's likelihood
under a language is the product over its trigrams.  For every document the shares of
the languages are estimated by EM over its words; then the sets of the one, two and three
languages with the largest shares are fitted by EM again, each alone, and compared by
penalised likelihood (half a log of the number of words for each language more); the
set's largest share names the document.

Training rows are chosen by the caller; only their text and language are read.  Defined
cases: a text that is null or holds no letter is ``und`` with score 0, as is every
text if nothing could be learned; a null or empty language is not learned from; rows
of one id are predicted each on its own; ties go to the first language by name; texts
of any length are read whole, whatever stands beside them, in blocks bounded by ``CELLS``; an empty table gives an empty
result; more than ``MOST_LANGUAGES`` learned languages are an error (the model is held
by every task); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, word_spans

BUCKETS = 1 << 15
ROUNDS = 5
#: Added to every count.
SMOOTHING = 0.5
#: Languages in a document's set, at most; a language counts from this share on.
MOST, LEAST_SHARE = 3, 0.05
UNKNOWN = "und"
#: Languages that can be learned (BUCKETS numbers each, on the driver and in the tasks).
MOST_LANGUAGES = 500

#: Bytes times languages that a task works on at once, and bytes of a word that is cut.
CELLS, BLOCK_BYTES = 1 << 22, 1 << 18

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bucket of the trigram around every byte (a gap stands before and after each text)."""
    here = _FOLD[raw].astype(np.uint32)
    before, after = np.full(len(raw), 0x20, np.uint32), np.full(len(raw), 0x20, np.uint32)
    before[1:], after[:-1] = here[:-1], here[1:]
    some = off[1:] > off[:-1]
    before[off[:-1][some]] = after[off[1:][some] - 1] = 0x20
    code = (before << np.uint32(16)) | (here << np.uint32(8)) | after
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for rows, raw, off in slices(batch, "text"):
            grams, letter = trigrams(raw, off), _FOLD[raw] != 0x20
            langs = np.array(rows.column(0).to_pylist(), object)
            owner = np.repeat(np.arange(len(langs)), np.diff(off))
            for lang in sorted(set(langs)):
                mine = (langs == lang)[owner] & letter
                counts[lang] = counts.get(lang, 0) + np.bincount(grams[mine], minlength=BUCKETS)
    for lang, c in counts.items():
        some = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(c[some].astype(np.int64))], names=["lang", "gram", "n"])


def learn(training: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Language names and the log-likelihoods of grams, a column for each language."""
    base = training.where(F.col(text_col).isNotNull() & (F.coalesce(F.col(lang_col), F.lit("")) != "")).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    if base.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = base.mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(table.column("lang").to_pylist()))
    counts = np.full((BUCKETS, len(names)), SMOOTHING)
    at = np.searchsorted(np.array(names, object), np.array(table.column("lang").to_pylist(), object)) if names else np.empty(0, int)
    counts[table.column("gram").to_numpy(), at] += table.column("n").to_numpy()
    return names, np.log(counts / counts.sum(0)).astype(np.float32) if names else counts.astype(np.float32)


def word_scores(raw: np.ndarray, start: np.ndarray, end: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word holds a letter, and the log-likelihoods (words x languages) of those that do."""
    base = start[0]
    if len(start) == 1 and end[0] - base > 2 * BLOCK_BYTES:  # one very long word: its trigrams are counted, a block at a time
        counts, lettered = np.zeros(BUCKETS), False
        for at in range(base, end[0], BLOCK_BYTES):
            lo, hi = max(at - 1, base), min(at + BLOCK_BYTES + 1, end[0])  # a byte of context on either side
            grams = trigrams(raw[lo:hi], np.array([0, hi - lo]))[at - lo:at - lo + BLOCK_BYTES]
            counts += np.bincount(grams, minlength=BUCKETS)
            lettered |= bool((_FOLD[raw[at:at + BLOCK_BYTES]] != 0x20).any())
        return np.array([lettered]), (counts @ logs.astype(np.float64))[None, :][:int(lettered)]
    part = raw[base:end[-1]]
    letters = np.concatenate([[0], np.cumsum(_FOLD[part] != 0x20)])
    some = letters[end - base] > letters[start - base]
    if not some.any():
        return some, np.zeros((0, logs.shape[1]))
    edges = np.column_stack([start[some], end[some]]).ravel() - base
    # a word stands between white space, so its trigrams are the same without what is around
    grams = trigrams(part, np.array([0, len(part)]))
    if edges[-1] == len(part):
        edges = edges[:-1]
    return some, np.add.reduceat(logs[grams], edges, axis=0)[::2].astype(np.float64)


class Words:
    """The words of some texts: their likelihoods under every language, a bounded block of
    bytes at a time.  A single block is kept; several are made again for every round."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, logs: np.ndarray):
        self.raw, self.logs = raw, logs
        self.start, self.end, first = word_spans(raw, off)
        self.text = np.repeat(np.arange(len(off) - 1), np.diff(first))
        most, self.blocks, i = max(1, CELLS // logs.shape[1]), [], 0
        while i < len(self.start):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + most, side="right")))
            self.blocks.append((i, j))
            i = j
        self.kept = [self._block(*self.blocks[0])] if len(self.blocks) == 1 else None

    def _block(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        some, fit = word_scores(self.raw, self.start[i:j], self.end[i:j], self.logs)
        fit -= fit.max(1, keepdims=True) if len(fit) else 0
        return np.exp(np.maximum(fit, -60)), self.text[i:j][some]

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Likelihoods of words, relative to each word's largest, and the text of each."""
        yield from self.kept if self.kept is not None else (self._block(i, j) for i, j in self.blocks)


def expectation(parts: Words, words: np.ndarray, shares: np.ndarray, rounds: int) -> np.ndarray:
    """Shares of every text after some rounds of EM over its words' likelihoods; a share of 0 stays 0."""
    for _ in range(rounds):
        total = np.zeros_like(shares)
        for like, text in parts:
            r = like * shares[text]
            r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
            total += np.column_stack([np.bincount(text, weights=r[:, k], minlength=len(words)) for k in range(r.shape[1])])
        shares = total / np.maximum(words, 1)[:, None]
    return shares


def mixture(raw: np.ndarray, off: np.ndarray, logs: np.ndarray, rounds: int = ROUNDS, most: int = MOST, least: float = LEAST_SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every text: languages by falling share, their shares within the chosen set
    (0 outside it), and how many words with letters it has."""
    n, kinds = len(off) - 1, logs.shape[1]
    parts, words = Words(raw, off, logs), np.zeros(n, np.int64)
    for _, text in parts:
        words += np.bincount(text, minlength=n)
    if not words.any():
        return np.tile(np.arange(kinds), (n, 1)), np.zeros((n, kinds)), words
    shares = np.maximum(expectation(parts, words, np.full((n, kinds), 1 / kinds), rounds), 1e-9)
    order = np.argsort(-shares, axis=1, kind="stable")
    best, chosen = np.full(n, -np.inf), np.zeros((n, kinds))
    for k in range(1, min(most, kinds) + 1):
        part = np.zeros((n, kinds))
        np.put_along_axis(part, order[:, :k], np.take_along_axis(shares, order[:, :k], 1), 1)
        part = expectation(parts, words, part / part.sum(1, keepdims=True), rounds if k > 1 else 0)
        total = -0.5 * k * np.log(np.maximum(words, 2))
        for like, text in parts:
            total = total + np.bincount(text, weights=np.log((like * part[text]).sum(1) + 1e-300), minlength=n)
        better = (total > best) & ((k == 1) | (np.take_along_axis(shares, order[:, k - 1:k], 1)[:, 0] >= least))
        best, chosen = np.where(better, total, best), np.where(better[:, None], part, chosen)
    return order, chosen, words


def _predict(names: list[str], logs: np.ndarray):
    labels = np.array([*names, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, off in slices(batch, "text", max(1, CELLS // max(1, len(names)))):
                n = rows.num_rows
                known = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
                if names:
                    order, shares, _ = mixture(raw, off, logs)
                    top = shares.argmax(1)
                    score = np.where(known, np.clip(shares[np.arange(n), top], 0, 1), 0.0)
                    sets = [[names[j] for j in order[i] if shares[i, j] > 0] if known[i] else [] for i in range(n)]
                    parts = [[float(shares[i, j]) for j in order[i] if shares[i, j] > 0] if known[i] else [] for i in range(n)]
                else:
                    known, top, score, sets, parts = np.zeros(n, bool), np.zeros(n, int), np.zeros(n), [[]] * n, [[]] * n
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(labels[np.where(known, top, len(names))].tolist(), pa.string()), pa.array(score), pa.array(sets, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))],
                    names=["doc_id", "held_out", "lang_pred", "score", "languages", "shares"],
                )
    return run


def identify(docs: DataFrame, names: list[str], logs: np.ndarray, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of lang_pred), languages, shares."""
    out = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), out.alias("held_out"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("known"), F.col(text_col).alias("text"))
    return base.mapInArrow(_predict(names, logs), "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>")
