"""SentencePiece-style unigram encoding and decoding.

A text gets a marker before it and for every space; the segmentation with the largest
sum of piece scores is found by Viterbi over a double-array trie of the pieces' bytes.
A character that no piece covers costs ``UNKNOWN_COST`` less than the worst piece and
becomes its bytes' pieces.  Of segmentations with equal sums the one whose last piece
is longest is taken.

No piece holds a marker after another character, so texts are cut before runs of
spaces.  Distinct short parts are segmented once, all new ones of a slice side by side in
numpy; long parts one by one.  (For a vocabulary with such pieces texts are not cut.)

Defined cases: a null or empty text has no pieces and decodes to the empty text; bytes
that form no code point decode to U+FFFD; a marker character in a text comes back as a
space; texts of any length are encoded whole; rows of one id are encoded each on its
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_spans, ranges, slices

MODEL = "piece_bpe_32k.model"
MARK = "▁".encode()
UNKNOWN_COST = 10.0
REMEMBERED = 300_000
#: Bytes (a space counts as one) of a part up to which parts are segmented side by side.
SIDE_BY_SIDE = 64


@dataclass
class Trie:
    """Double array: the child of node s by byte c is base[s] + c if check holds s there."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, words: list[bytes], values: list[int]) -> Trie:
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for word, v in zip(words, values, strict=True):
            node = 0
            for c in word:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                node = nxt
            ends[node] = v
        size = 2 * len(children) + 1024
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, bool)
        free[0] = False
        place = np.zeros(len(children), np.int64)
        low = high = 1
        for node, kids in enumerate(children):  # breadth is not needed: a parent always comes first
            if not kids:
                continue
            codes = np.fromiter(kids, np.int64)
            begin = low if len(codes) == 1 else max(low, high - 4096)  # the start is full of small holes
            at, width = max(1, begin - int(codes.min())), 32
            while True:
                span = np.arange(at, at + width)
                if span[-1] + 256 >= len(base):
                    base, check, value = (np.concatenate([x, np.full(len(x), fill, np.int32)]) for x, fill in ((base, 0), (check, -1), (value, -1)))
                    free = np.concatenate([free, np.ones(len(free), bool)])
                fits = free[span[:, None] + codes].all(1)
                if fits.any():
                    at = int(span[fits.argmax()])
                    break
                at, width = at + width, 4096
            s = place[node]
            base[s], high = at, max(high, at + int(codes.max()))
            for c, kid in kids.items():
                t = at + c
                free[t] = False
                check[t], place[kid] = s, t
                if kid in ends:
                    value[t] = ends[kid]
            while not free[low]:
                low += 1
        return cls(base, check, value)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Children of ``node``; -1 where there is none (or ``node`` is -1)."""
        t = self.base[np.maximum(node, 0)] + byte
        ok = (node >= 0) & (t < len(self.check)) & (self.check[np.minimum(t, len(self.check) - 1)] == node)
        return np.where(ok, t, -1)


@dataclass
class Pieces:
    """A vocabulary: scores of pieces, the ids of the 256 byte pieces, and every id's bytes when decoded."""

    trie: Trie
    score: np.ndarray
    byte_id: np.ndarray
    text: np.ndarray
    first: np.ndarray
    longest: int
    cut: bool

    @classmethod
    def of(cls, pieces: list[tuple[str, float, str]]) -> Pieces:
        """From (piece, score, kind); kind is normal, byte or other (never matched, decodes to nothing)."""
        normal = [i for i, p in enumerate(pieces) if p[2] == "normal"]
        byte_id = np.full(256, -1, np.int64)
        decoded = []
        for i, (piece, _, kind) in enumerate(pieces):
            if kind == "byte":
                byte_id[int(piece[3:5], 16)] = i
                decoded.append(bytes([int(piece[3:5], 16)]))
            else:
                decoded.append(piece.encode().replace(MARK, b" ") if kind == "normal" else b"")
        words = [pieces[i][0].encode() for i in normal]
        mark = MARK.decode()
        inner = any(mark in pieces[i][0].lstrip(mark) or " " in pieces[i][0] for i in normal)
        return cls(Trie.build(words, normal), np.array([p[1] for p in pieces], np.float64), byte_id, np.frombuffer(b"".join(decoded), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in decoded])]), max(map(len, words)), not inner)

    @classmethod
    def read(cls, path: str) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: "byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "normal"
        return cls.of([(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())])

    @cached_property
    def unknown(self) -> float:
        return float(self.score.min()) - UNKNOWN_COST

    @cached_property
    def lists(self) -> tuple[list[int], list[int], list[int], list[float]]:
        return self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.score.tolist()


_WIDTH = np.ones(256, np.int64)  # bytes of a code point by its first byte
_WIDTH[0xC0:0xE0], _WIDTH[0xE0:0xF0], _WIDTH[0xF0:] = 2, 3, 4


def viterbi(p: Pieces, parts: list[bytes]) -> list[np.ndarray]:
    """Ids of the best segmentation of every part (marker bytes in place of spaces)."""
    n, width = len(parts), max(map(len, parts))
    size = np.array([len(x) for x in parts])
    text = np.zeros((n, width + 1), np.int64)
    for i, x in enumerate(parts):
        text[i, :len(x)] = np.frombuffer(x, np.uint8)
    best = np.full((n, width + 1), -np.inf)
    best[:, 0] = 0
    back, piece = np.zeros((n, width + 1), np.int64), np.full((n, width + 1), -1, np.int64)
    for s in range(width):
        rows = np.flatnonzero((best[:, s] > -np.inf) & (size > s))
        if not len(rows):
            continue
        from_here = best[rows, s]
        end = np.minimum(s + _WIDTH[text[rows, s]], size[rows])
        cost = from_here + p.unknown
        better = cost > best[rows, end]
        r, e = rows[better], end[better]
        best[r, e], back[r, e], piece[r, e] = cost[better], s, -1
        node, live = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for d in range(min(p.longest, width - s)):
            node = p.trie.step(node, text[rows[live], s + d])
            ok = (node >= 0) & (s + d < size[rows[live]])
            node, live = node[ok], live[ok]
            if not len(live):
                break
            v = p.trie.value[node]
            hit = np.flatnonzero(v >= 0)
            r, score = rows[live[hit]], from_here[live[hit]] + p.score[v[hit]]
            better = score > best[r, s + d + 1]
            r = r[better]
            best[r, s + d + 1], back[r, s + d + 1], piece[r, s + d + 1] = score[better], s, v[hit][better]
    # all parts' pieces at once, from the last one back; a byte fallback is several ids
    steps, at, live = [], size.copy(), np.flatnonzero(size)
    while len(live):
        end = at[live]
        begin = back[live, end]
        steps.append((live, begin, end, piece[live, end]))
        at[live] = begin
        live = live[begin > 0]
    if not steps:
        return [np.empty(0, np.int32)] * n
    row, begin, end, own = (np.concatenate(x) for x in zip(*reversed(steps), strict=True))
    order = np.argsort(row, kind="stable")
    row, begin, end, own = row[order], begin[order], end[order], own[order]
    count = np.where(own < 0, end - begin, 1)
    k = np.repeat(np.arange(len(row)), count)
    ids = np.where(own[k] < 0, p.byte_id[text[row[k], begin[k] + ranges(count)]], own[k]).astype(np.int32)
    bounds = np.searchsorted(row[k], np.arange(n + 1)).tolist()
    return [ids[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


def viterbi_long(p: Pieces, part: bytes) -> np.ndarray:
    """The same for one long part: place by place over the trie's arrays as lists, as
    numpy has nothing to do side by side."""
    base, check, value, score = p.lists
    n, size, unknown = len(part), len(check), p.unknown
    best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    width = _WIDTH.tolist()
    for s in range(n):
        here = best[s]
        if here == -np.inf:
            continue
        end = min(s + width[part[s]], n)
        if here + unknown > best[end]:
            best[end], back[end], piece[end] = here + unknown, s, -1
        node = 0
        for e in range(s, n):
            t = base[node] + part[e]
            if t >= size or check[t] != node:
                break
            node, v = t, value[t]
            if v >= 0 and here + score[v] > best[e + 1]:
                best[e + 1], back[e + 1], piece[e + 1] = here + score[v], s, v
    out, at = [], n
    while at:
        s = back[at]
        out.append(piece[at]) if piece[at] >= 0 else out.extend(p.byte_id[list(part[s:at])][::-1].tolist())
        at = s
    return np.array(out[::-1], np.int32)


class UnigramEncoder:
    """Encodes slices of texts; remembers the parts it has seen, by their bytes."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, np.ndarray] = {}

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and n+1 bounds."""
        n = len(off) - 1
        some = np.diff(off) > 0
        marked = np.insert(raw, off[:-1][some], 0x20)
        at = off + np.concatenate([[0], np.cumsum(some)])
        if not len(marked):
            return np.empty(0, np.int32), np.zeros(n + 1, np.int64)
        cut = np.zeros(len(marked), bool)
        if self.pieces.cut:
            space = marked == 0x20
            cut[1:] = space[1:] & ~space[:-1]
        cut[at[:-1][some]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(marked))
        one, which = distinct_spans(marked, start, end)
        data = marked.tobytes()
        parts = [data[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)]
        if len(self.known) + len(parts) > REMEMBERED:
            self._forget()
        new = sorted((x for x in parts if x not in self.known), key=len)
        short = [x for x in new if len(x) <= SIDE_BY_SIDE]
        for i in range(0, len(short), 4096):
            group = short[i:i + 4096]
            self.known.update(zip(group, viterbi(self.pieces, [x.replace(b" ", MARK) for x in group]), strict=True))
        own = [self.known[x] if len(x) <= SIDE_BY_SIDE else viterbi_long(self.pieces, x.replace(b" ", MARK)) for x in parts]  # long ones seldom come again
        size = np.array([len(x) for x in own])
        flat, first = np.concatenate(own), np.concatenate([[0], np.cumsum(size)])
        count = size[which]
        ids = flat[np.repeat(first[which], count) + ranges(count)]
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, total[np.searchsorted(start, at)]


def decode(p: Pieces, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Bytes of every text: pieces and byte pieces joined, markers as spaces, the first one taken off."""
    size = p.first[ids + 1] - p.first[ids]
    flat = p.text[np.repeat(p.first[ids], size) + ranges(size)].tobytes()
    total = np.concatenate([[0], np.cumsum(size)])
    at = total[bounds].tolist()
    return [flat[a + (flat[a:a + 1] == b" "):b] if b > a else b"" for a, b in zip(at[:-1], at[1:], strict=True)]


def _encode(pieces: Pieces, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnigramEncoder(pieces)
        is_byte = np.zeros(len(pieces.score), bool)
        is_byte[pieces.byte_id[pieces.byte_id >= 0]] = True
        for batch in batches:
            for rows, raw, off in slices(batch, "text"):
                ids, at = encoder.encode(raw, off)
                back = decode(pieces, ids, at)
                data = raw.tobytes()
                fallback = np.concatenate([[0], np.cumsum(is_byte[ids])])
                own = ids.astype("<u4")
                same = [data[a:b] == x for x, a, b in zip(back, off[:-1].tolist(), off[1:].tolist(), strict=True)]
                columns = [rows.column(0), pa.array(np.diff(at)), pa.array(fallback[at[1:]] - fallback[at[:-1]]), pa.array([zlib.crc32(own[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()), pa.array(same)]
                extra = [pa.ListArray.from_arrays(at.astype(np.int32), ids), pa.array([x.decode("utf-8", "replace") for x in back], pa.string())] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns + extra, names=["doc_id", "n_pieces", "n_fallback", "ids_crc32", "round_trip"] + ["ids", "decoded"] * with_ids)
    return run


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, n_fallback (byte pieces), ids_crc32 (unsigned little-endian 32-bit
    ids), round_trip (whether decoding gives the text back) and, if ``with_ids``, ids and decoded."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(_encode(Pieces.read(path), with_ids), "doc_id long, n_pieces long, n_fallback long, ids_crc32 long, round_trip boolean" + ", ids array<int>, decoded string" * with_ids)
