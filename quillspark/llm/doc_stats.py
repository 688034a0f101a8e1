"""Statistics of whole texts, for many texts at once (numpy over flat bytes).

Words are ``[^\\x20\\x09-\\x0D]+``; lines are cut at ``\\n``.
"""

from __future__ import annotations

import numpy as np

from .common import SPACE, distinct_spans, ranges, word_spans

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER, DIGIT, PUNCT, END = (np.zeros(256, bool) for _ in range(4))
UPPER[65:91] = True
DIGIT[48:58] = True
PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
END[list(b".!?")] = True

#: The columns of ``text_stats``, in order.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features of the quality model, in the order of its columns.
FEATURES = ["log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_share", "end_share", "distinct_share", "mean_line", "long_word_share"]


def _repeated(names: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each item, how often its name occurs in its own text."""
    if not len(names):
        return np.empty(0, np.int64)
    order = np.lexsort((names, text))
    a, t = names[order], text[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (t[1:] != t[:-1])
    group = np.cumsum(new) - 1
    out = np.empty(len(a), np.int64)
    out[order] = np.bincount(group)[group]
    return out


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def text_stats(raw: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of every text, and its features as a matrix."""
    n = len(off) - 1
    start, end, first = word_spans(raw, off)
    words = np.diff(first)
    text = np.repeat(np.arange(n), words)
    name = distinct_spans(raw, start, end)[1]

    letters = (raw & 0xC0) != 0x80  # the first byte of a code point
    in_word = _sums(letters & ~SPACE[raw], off)

    # 3-word windows that their text has twice or more: all words of each are counted once
    windows = np.maximum(words - 2, 0)
    owner = np.repeat(np.arange(n), windows)
    at = first[:-1][owner] + ranges(windows)
    kinds = len(name) + 1
    pair = np.unique(name[at] * kinds + name[at + 1], return_inverse=True)[1]
    twice = at[_repeated(pair * kinds + name[at + 2], owner) > 1]
    covered = np.zeros(len(name), bool)
    for k in range(3):
        covered[twice + k] = True

    # lines
    newline = np.flatnonzero(raw == 10)
    edge = np.unique(np.concatenate([newline + 1, off[:-1]]))
    edge = edge[edge < len(raw)]
    owner_l = np.searchsorted(off, edge, side="right") - 1
    stop = np.minimum(np.append(edge[1:], len(raw)), off[owner_l + 1])
    stop = stop - ((stop > edge) & (raw[np.maximum(stop - 1, 0)] == 10)) if len(edge) else stop
    has_word = np.searchsorted(start, stop) > np.searchsorted(start, edge)
    edge, stop, owner_l = edge[has_word], stop[has_word], owner_l[has_word]
    line = distinct_spans(raw, edge, stop)[1]
    order = np.lexsort((edge, line, owner_l))
    again = np.zeros(len(line), bool)
    again[1:] = (line[order][1:] == line[order][:-1]) & (owner_l[order][1:] == owner_l[order][:-1])
    dup_lines = np.bincount(owner_l[order][again], minlength=n)
    lines = np.bincount(owner_l, minlength=n)

    counts = {
        "n_words": words.astype(np.int64), "word_chars": in_word, "n_symbols": _sums(SYMBOL[raw], off), "n_dup_lines": dup_lines.astype(np.int64),
        "n_repeat_words": np.bincount(text[covered], minlength=n).astype(np.int64),
    }
    w, c = np.maximum(words, 1), np.maximum(in_word, 1)
    size = end - start
    distinct = np.bincount(text, weights=1 / _repeated(name, text), minlength=n) if len(text) else np.zeros(n)
    features = np.column_stack([
        np.log1p(words), in_word / w, counts["n_symbols"] / c, dup_lines / np.maximum(lines, 1), counts["n_repeat_words"] / w, _sums(UPPER[raw], off) / c, _sums(DIGIT[raw], off) / c, _sums(PUNCT[raw], off) / c, _sums(END[raw], off) / w,
        distinct / w, words / np.maximum(lines, 1), np.bincount(text[size > 14], minlength=n) / w,
    ]).astype(np.float32)
    return counts, features
