"""Packing of token ids into sequences of fixed length: by balanced cost (op4)
and by best fit (op5).

Documents are packed where they are read: a task encodes its rows and packs them
in pools of about ``POOL`` tokens, so nothing is shuffled, a pool is bounded, and a
lost task is simply run again.  Sequence ids hold the partition's number.

Defined cases: a null text is empty, so its only id is the end id; documents
longer than a sequence are cut into full ones and a rest; equal rows are packed
each on its own; a null id stays null; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, vocabulary_path
from .common import slices

LENGTH = 2048
END_ID = 1
#: Tokens packed at once in a task.
POOL = 1 << 20
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n (attention over the
#: piece alone), relative to one token's feed-forward work.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
MATRIX = "sequence_id long, ids binary, n_tokens long, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<long>"

Piece = tuple[int, int, int, int, int]  # document in the pool, start, length, sequence, offset


def balance(lengths: np.ndarray, room: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[Piece]:
    """Longest first, each to the sequence of lowest cost that still has room for
    all of it; one that fits nowhere whole is cut over the sequences of lowest cost.

    As few sequences as hold all tokens, so a pool's padding is less than one sequence.
    """
    out: list[Piece] = []
    full = lengths // room
    for doc in np.flatnonzero(full).tolist():
        for i in range(int(full[doc])):
            out.append((doc, i * room, room, len(out), 0))
    base, rest = len(out), lengths - full * room
    order = np.argsort(-rest, kind="stable")
    order = order[rest[order] > 0]
    n = -(-int(rest.sum()) // room)
    free, cost = np.full(n, room, np.int64), np.zeros(n)

    def put(doc: int, start: int, size: int, at: int) -> None:
        out.append((doc, start, size, base + at, int(room - free[at])))
        free[at] -= size
        cost[at] += linear * size + quadratic * size * size

    for doc in order.tolist():
        size, start = int(rest[doc]), int(full[doc]) * room
        fits = np.flatnonzero(free >= size)
        if len(fits):
            put(doc, start, size, int(fits[np.argmin(cost[fits])]))
            continue
        while size:
            some = np.flatnonzero(free)
            at = int(some[np.argmin(cost[some])])
            part = min(size, int(free[at]))
            put(doc, start, part, at)
            start, size = start + part, size - part
    return out


class RoomTree:
    """Segment tree over remaining room 0..room: the smallest room >= n that a sequence has."""

    def __init__(self, room: int):
        self.leaves = 1 << room.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.with_room: list[list[int]] = [[] for _ in range(room + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.with_room[room].append(sequence)
        self._change(room, 1)

    def take(self, room: int) -> int:
        self._change(room, -1)
        return self.with_room[room].pop()

    def _change(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def smallest(self, n: int) -> int | None:
        i = n + self.leaves
        if self.count[i]:
            return n
        while i > 1:  # up to the first right sibling that holds something, then down its left side
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i *= 2
                    i += not self.count[i]
                return i - self.leaves
            i >>= 1
        return None


def best_fit(lengths: np.ndarray, room: int = LENGTH) -> list[Piece]:
    """Best fit decreasing: longest first, each to the fullest sequence with room
    for it, else to a new one.  Only documents longer than a sequence are cut."""
    out: list[Piece] = []
    full = lengths // room
    n = 0
    for doc in np.flatnonzero(full).tolist():
        for i in range(int(full[doc])):
            out.append((doc, i * room, room, n, 0))
            n += 1
    rest = lengths - full * room
    tree = RoomTree(room)
    order = np.argsort(-rest, kind="stable")
    for doc in order[rest[order] > 0].tolist():
        size, start = int(rest[doc]), int(full[doc]) * room
        left = tree.smallest(size)
        if left is None:
            at, left, n = n, room, n + 1
        else:
            at = tree.take(left)
        out.append((doc, start, size, at, room - left))
        if left > size:
            tree.add(left - size, at)
    return out


def _pools(batches: Iterator[pa.RecordBatch], path: str, end_id: int, pool: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids of documents and their document ids, about ``pool`` tokens at a time."""
    encoder, names, ids, held = Encoder.load(path), [], [], 0
    for batch in batches:
        for rows, raw, off in slices(batch, "text"):
            flat, at = encoder.encode_flat(raw, off)
            for doc, a, b in zip(rows.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = np.empty(b - a + 1, np.uint32)
                own[:-1] = flat[a:b]
                own[-1] = end_id
                names.append(doc)
                ids.append(own)
                held += len(own)
                if held >= pool:
                    yield names, ids
                    names, ids, held = [], [], 0
    if names:
        yield names, ids


def _base() -> int:
    return TaskContext.get().partitionId() << 40


def _pieces(path: str, room: int, end_id: int, pool: int, with_ids: bool, linear: float, quadratic: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = _base()
        for names, ids in _pools(batches, path, end_id, pool):
            packed = balance(np.array([len(x) for x in ids]), room, linear, quadratic)
            doc, start, size, seq, offset = (np.array(x, np.int64) for x in zip(*packed, strict=True))
            parts = [ids[d][s:s + n].tobytes() for d, s, n in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)]
            columns = [pa.array(names, pa.int64()).take(pa.array(doc)), pa.array(start), pa.array(size), pa.array([zlib.crc32(x) for x in parts], pa.int64()), pa.array([len(ids[d]) for d in doc], pa.int64()), pa.array(seq + first), pa.array(offset), pa.array(linear * size + quadratic * size * size)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(parts, pa.binary())] * with_ids, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"] + ["ids"] * with_ids)
            first += int(seq.max()) + 1
    return run


def _matrices(path: str, room: int, end_id: int, pool: int, pad_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = _base()
        for names, ids in _pools(batches, path, end_id, pool):
            packed = sorted(best_fit(np.array([len(x) for x in ids]), room), key=lambda p: (p[3], p[4]))
            n = packed[-1][3] + 1
            for low in range(0, n, 256):  # rows of the matrix at a time
                rows = [p for p in packed if low <= p[3] < low + 256] if n > 256 else packed
                count = min(256, n - low)
                matrix, place = np.full((count, room), pad_id, "<u4"), np.zeros((count, room), "<u4")
                bounds, docs, starts = [[0] for _ in range(count)], [[] for _ in range(count)], [[] for _ in range(count)]
                for d, s, size, seq, offset in rows:
                    matrix[seq - low, offset:offset + size] = ids[d][s:s + size]
                    place[seq - low, offset:offset + size] = np.arange(size)
                    bounds[seq - low].append(offset + size)
                    docs[seq - low].append(names[d])
                    starts[seq - low].append(s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(low, low + count) + first), pa.array([x.tobytes() for x in matrix], pa.binary()), pa.array([x[-1] for x in bounds], pa.int64()), pa.array(bounds, pa.list_(pa.int32())), pa.array([x.tobytes() for x in place], pa.binary()), pa.array(docs, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64()))],
                    names=["sequence_id", "ids", "n_tokens", "cu_seqlens", "position_ids", "doc_ids", "starts"],
                )
            first += n
    return run


def pack_by_cost(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, pool: int = POOL, path: str | None = None, linear: float = LINEAR, quadratic: float = QUADRATIC, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, cost and, if ``with_ids``, its ids (unsigned, little-endian, 32 bits)."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(_pieces(path or vocabulary_path(), length, end_id, pool, with_ids, linear, quadratic), PIECES + ", ids binary" * with_ids)


def packed_matrices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, pad_id: int = 0, pool: int = POOL, path: str | None = None) -> DataFrame:
    """One row a sequence: ids (a row of the id matrix, padded), n_tokens, cu_seqlens
    (0 and the end of every segment), position_ids (from 0 in every segment), and
    the document and start of every segment."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(_matrices(path or vocabulary_path(), length, end_id, pool, pad_id), MATRIX)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write ``packed_matrices`` as Parquet: a file is a block of the id matrix."""
    packed_matrices(docs, **options).write.parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """doc_id, start, ids (binary) of every segment: the inverse of packing."""
    seg = packed.select("ids", F.posexplode(F.arrays_zip("doc_ids", "starts")).alias("i", "s"), "cu_seqlens")
    lo, hi = F.get("cu_seqlens", F.col("i")), F.get("cu_seqlens", F.col("i") + 1)
    return seg.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.starts").alias("start"), F.substring("ids", lo * 4 + 1, (hi - lo) * 4).alias("ids"))
