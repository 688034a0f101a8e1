"""Token ids of whole texts by a public byte-level BPE vocabulary, many texts at once.

A text is handed to the tokenizer whole: natural text has so many different words that
remembering them costs more than encoding them again.  The vocabulary's added tokens
(``<|endoftext|>``) are found first and are parts of their own, as its tokenizer file says.
A long text is handed over in parts, cut before a run of ASCII white space that follows a
visible character: byte-level pre-tokenisation always starts a new word there, so the parts
can be encoded apart.
"""

from __future__ import annotations

import base64
import json
from itertools import pairwise

import numpy as np

from .common import SPACE

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The tokenizer file of the same vocabulary, which names its added tokens.
TOKENIZER = "byte_bpe_50k.json"
#: Bytes of a text after which its next part begins, at the first place where it can be cut.
PART = 1 << 16


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def part_starts(raw: np.ndarray, most: int) -> np.ndarray:
    """Places within a text where its parts begin, but the first: after every ``most`` bytes the next cut."""
    visible = (raw > 0x20) & (raw < 0x7F)
    visible[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80)  # a Latin letter of two bytes
    at = np.flatnonzero(SPACE[raw[1:]] & visible[:-1]) + 1
    k = np.unique(np.searchsorted(at, np.arange(most, len(raw), most)))
    return at[k[k < len(at)]]


class Encoder:
    """Ids of texts as the tokenizer file gives them: its added tokens are matched where
    they stand in a text, and none are put in."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str, tokenizer: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(tokenizer or vocabulary_path(TOKENIZER), encoding="utf-8") as f:
            self.added = {t["content"].encode(): t["id"] for t in json.load(f)["added_tokens"]}

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @classmethod
    def load(cls, path: str) -> Encoder:
        """One for each worker process, kept between tasks."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _places(self, data: bytes, off: np.ndarray) -> list[tuple[int, int]]:
        """Where added tokens stand, from left to right, within single texts."""
        out, at = [], {t: data.find(t) for t in self.added}
        while (some := {t: i for t, i in at.items() if i >= 0}):
            token = min(some, key=lambda t: (some[t], -len(t)))
            a, b = some[token], some[token] + len(token)
            if np.searchsorted(off, a, side="right") == np.searchsorted(off, b, side="left"):
                out.append((a, b))
            else:
                b = a + 1
            at |= {t: data.find(t, b) for t, i in some.items() if i < b}
        return out

    def _ids(self, part: bytes) -> np.ndarray:
        return np.array([self.added[part]] if part in self.added else self.encode(part.decode("utf-8", "replace")), np.int32)

    def encode_flat(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the n+1 places where each begins."""
        if not len(raw):
            return np.empty(0, np.int32), np.zeros(len(off), np.int64)
        data = raw.tobytes()
        edges = [off, *self._places(data, off)]
        edges += [off[i] + part_starts(raw[off[i]:off[i + 1]], PART) for i in np.flatnonzero(np.diff(off) > PART)]
        edge = np.unique(np.concatenate(edges))
        ids = [self._ids(data[a:b]) for a, b in pairwise(edge.tolist())]
        total = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        return np.concatenate(ids), total[np.searchsorted(edge, off)]
