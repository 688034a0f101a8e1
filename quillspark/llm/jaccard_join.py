"""Exact similarity join of documents on word n-gram sets (Jaccard >= a percentage),
and the components of its links.

Candidates, all exact (no link between different texts is lost):

1. Equal sets are one class (name: hash of the sorted set) from here on.
2. Every class has a bitmap of the parities of its grams' hashes; the bit count of two
   bitmaps' difference bounds the symmetric difference from below, so the overlap
   from above.  Bitmaps are compared in *tiles*, classes of neighbouring sizes.
3. First tiles: classes that share a pair of minhashes.  A spanning forest of the pairs
   that look nearest is checked, so that groups of near copies become components
   before pairs are formed in them.  This only saves work.
4. Two linked sets share a gram among the first ``n - ceil(t n) + 1`` of each, in any
   fixed order.  The order used counts grams in a sketch over all documents and puts
   common ones last.  Classes that share such a gram, whose sizes and whose places of
   the gram allow a link, and which are of several components, are a tile; large groups
   are cut into bands of size and blocks of at most ``TILE`` classes.
5. Pairs of a tile that its bitmaps allow are checked on the sorted gram arrays of the
   whole texts: all if they are few, else a spanning forest, until no tile joins
   components any more; then every pair that is left between two components.

Defined cases: a null or empty text, or one without words, has no grams and links
with nothing (it is its own component); fewer than ``words`` words are one gram; texts
of any length are taken whole; rows of one id are documents each, and equal rows link;
a null id is left out of the smallest id of a component, which is null only if no id
is known; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_TABLE, LOWER, TEXT_KEY, Scratch, U64, chain_hashes, free_names, mix, ranges, set_hash, signed, slices, span_hashes, stored, text_key, word_spans
from .components import connected_components

WORDS, PERCENT = 5, 75
#: Slots of the sketch of gram counts, and of a row of it.
SLOTS, ROW = 1 << 22, 1 << 14
#: Grams counted before a task passes its counts on; grams of counts beyond HOT never meet in one task.
FLUSH, HOT = 1 << 24, 1 << 14
#: Pairs of minhashes for the first tiles.
KEYS = 6
#: Classes in a block of a tile.
TILE = 1024
#: Leaders of a large group of the first tiles that all its blocks see.
LEADERS = 16
#: Classes whose texts are fetched with a broadcast list of ids, and linked classes that
#: are broadcast; beyond it by a shuffled join.
BROADCAST_ROWS = 500_000
_SEEDS = np.random.default_rng(5).integers(1, 2**62, 2 * KEYS, dtype=np.uint64) * U64(2) + U64(1)

SET_SCHEMA = f"doc long, th {TEXT_KEY}, n int, name long, twin long, keys array<long>, sig binary, prefix array<long>, hot int"
MEMBER_SCHEMA = "tile long, large boolean, name long, n int, pos int"


def gram_sets(raw: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct gram hashes of every text, one after the other, and n+1 bounds."""
    start, end, first = word_spans(raw, off)
    count = np.diff(first)
    grams = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    at = np.repeat(first[:-1], grams) + ranges(grams)
    stop = np.minimum(at + words, np.repeat(first[1:], grams))
    key = chain_hashes(span_hashes(raw, start, end, BYTE_TABLE[LOWER]), at, stop, words)
    bounds = np.concatenate([[0], np.cumsum(grams)])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        key[a:b].sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    new[bounds[:-1][grams > 0]] = True
    return key[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def _spread(h: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A cheap permutation of hashes."""
    x = h * seed
    x ^= x >> U64(29)
    x *= seed
    return x


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Grams of a set of n of which a linked set must have one."""
    return np.where(n > 0, n - -(-n * percent // 100) + 1, 0)


def signature_bits(n: np.ndarray) -> np.ndarray:
    """A power of two, at least 64 and twice the set."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))


def parity_bitmap(h: np.ndarray, bits: int) -> bytes:
    """Bit i is the parity of how many grams hash to i."""
    odd = np.bincount((h & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> U64(20) & U64(SLOTS - 1)).astype(np.int64)


def gram_ranks(docs: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """For every slot of the sketch a rank by the number of grams of all documents in
    it, and the rank from which on grams are hot (``HOT`` more than the mean of a slot).  A
    slot's count is no less than the count of each gram in it, up to 65,535 a task and
    ``FLUSH`` grams; any ranks give the same links."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = np.zeros(SLOTS, np.int64), 0

        def rows() -> pa.RecordBatch:
            own = np.minimum(held, 65535).astype("<u2").reshape(-1, ROW)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(own), dtype=np.int32)), pa.array([x.tobytes() for x in own], pa.binary())], names=["row", "counts"])

        for batch in batches:
            for _, raw, off in slices(batch, "text"):
                h = gram_sets(raw, off, words)[0]
                np.add.at(held, _slot(h), 1)
                seen += len(h)
            if seen > FLUSH:
                yield rows()
                held[:], seen = 0, 0
        if seen:
            yield rows()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[row] = sums.get(row, 0) + np.frombuffer(own, "<u2").astype(np.int64)
        for row, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([rank(x).tobytes()], pa.binary()), pa.array([int(x.sum())])], names=["row", "ranks", "n"])

    def rank(x: np.ndarray) -> np.ndarray:
        return np.minimum(4 * np.log2(x + 1.0), 255).astype(np.uint8)

    sketch = docs.select("text").mapInArrow(count, "row int, counts binary").repartition("row").mapInArrow(total, "row int, ranks binary, n long").toArrow()
    out = np.zeros((SLOTS // ROW, ROW), np.uint8)
    for row, x in zip(sketch.column(0).to_pylist(), sketch.column(1).to_pylist(), strict=True):
        out[row] = np.frombuffer(x, np.uint8)
    mean = sum(sketch.column(2).to_pylist()) // SLOTS
    return out.ravel(), int(rank(np.array([HOT + mean]))[0])


def _sets(words: int, percent: int, ranks, hot_from: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_of = ranks.value
        seen: set[tuple[int, int]] = set()  # classes of this task, so copies give no more rows
        for batch in batches:
            for rows, raw, off in slices(batch, "text"):
                h, at = gram_sets(raw, off, words)
                n = np.diff(at)
                name, twin = signed(set_hash(h, n, 1)), signed(set_hash(h, n, 2))
                rank = order_of[_slot(h)]
                some = n > 0
                minima = np.empty((len(n), 2 * KEYS), np.uint64)
                for i, seed in enumerate(_SEEDS):
                    if len(h):
                        minima[some, i] = np.minimum.reduceat(_spread(h, seed), at[:-1][some])
                keys = signed(np.ascontiguousarray(mix(minima[:, ::2] + mix(minima[:, 1::2]) * U64(3) + np.arange(KEYS, dtype=np.uint64))))
                bits, length = signature_bits(n).tolist(), prefix_length(n, percent).tolist()
                sig, prefix, key, hot = [None] * len(n), [None] * len(n), [None] * len(n), [0] * len(n)
                for i, v in enumerate(zip(name.tolist(), twin.tolist(), strict=True)):
                    if not n[i] or v in seen:
                        continue
                    seen.add(v)
                    own, r = h[at[i]:at[i + 1]], rank[at[i]:at[i + 1]]
                    first = np.argsort(r, kind="stable")[:length[i]]  # the fixed order: by rank, then hash
                    sig[i], prefix[i], key[i], hot[i] = parity_bitmap(own, bits[i]), signed(own[first]), keys[i], int((r[first] >= hot_from).sum())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(n.astype(np.int32)), pa.array(name), pa.array(twin), pa.array(key, pa.list_(pa.int64())), pa.array(sig, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(hot, pa.int32())],
                    names=["doc", "th", "n", "name", "twin", "keys", "sig", "prefix", "hot"],
                )
    return run


def may_link(na, nb, percent: int):
    """Whether sizes alone allow a link."""
    return 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)


def may_link_at(na, nb, i, j, percent: int):
    """Whether two sets whose first common gram is at places i and j may link: that gram and
    what follows must hold percent / (100 + percent) of both sizes."""
    return (100 + percent) * np.minimum(na - i, nb - j) >= percent * (na + nb)


def _groups(percent: int):
    """Rows (gram, name, n, pos) sorted by gram become members of tiles: runs of one
    gram's classes in the order of size in which every two neighbours may link."""
    def emit(gram: np.ndarray, name: np.ndarray, n: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((name, n, gram))
        gram, name, n, pos = gram[order], name[order], n[order], pos[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (name[1:] != name[:-1])
        gram, name, n, pos = gram[new], name[new], n[new], pos[new]
        joins = np.zeros(len(gram) + 1, bool)
        joins[1:-1] = (gram[1:] == gram[:-1]) & may_link(n[1:], n[:-1], percent)
        first = np.flatnonzero(~joins[:-1])
        size = np.diff(np.append(first, len(gram)))
        # a pair needs a member that holds the gram early enough for a set of its own size
        early = np.add.reduceat(may_link_at(n, n, pos, pos, percent).astype(np.int64), first)
        keep = np.repeat((size > 1) & (early > 0), size)
        tile = signed(mix(gram.view(np.uint64) + np.repeat(n[first], size).astype(np.uint64) * U64(7919)))
        large = np.repeat(size > TILE, size)
        return pa.RecordBatch.from_arrays([pa.array(np.where(large, gram, tile)[keep]), pa.array(large[keep]), pa.array(name[keep]), pa.array(n[keep].astype(np.int32)), pa.array(pos[keep].astype(np.int32))], names=["tile", "large", "name", "n", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last gram's rows: its group may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy().astype(np.int64) for i in range(4)]
            held = [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)] if held else now
            gram = held[0]
            whole = int(np.searchsorted(gram == gram[-1], True)) if gram[0] != gram[-1] else 0
            if whole:
                yield emit(*(x[:whole] for x in held))
                held = [x[whole:].copy() for x in held]
        if held:
            yield emit(*held)
    return run


class Bitmaps:
    """Bitmaps of many classes; wide ones are folded to any narrower width (parities add up)."""

    def __init__(self, sig: pa.Array):
        self.sig = sig.to_pylist()
        self.words = np.array([len(x) // 8 for x in self.sig])
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def folded(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``width`` words, and the row of every class that is as wide at least."""
        if width not in self.at:
            some = np.flatnonzero(self.words >= width)
            row = np.zeros(len(self.words), np.int64)
            row[some] = np.arange(len(some))
            out = np.empty((len(some), width), np.uint64)
            for i, k in enumerate(some.tolist()):
                out[i] = np.bitwise_xor.reduce(np.frombuffer(self.sig[k], np.uint64).reshape(-1, width), axis=0)
            self.at[width] = out, row
        return self.at[width]

    def differences(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits in which the bitmaps of each pair differ."""
        out = np.zeros(len(i), np.int64)
        narrow = np.minimum(self.words[i], self.words[j])
        for width in np.unique(narrow).tolist():
            bits, row = self.folded(width)
            pairs, step = np.flatnonzero(narrow == width), max(1, (1 << 19) // width)
            for k in range(0, len(pairs), step):
                p = pairs[k:k + step]
                out[p] = np.bitwise_count(bits[row[i[p]]] ^ bits[row[j[p]]]).sum(1, dtype=np.int64)
        return out


def tile_pairs(tile: np.ndarray, side: np.ndarray, n: np.ndarray, pos: np.ndarray, part: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within each tile (rows are sorted by it) that sizes, places, sides and components allow."""
    first = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
    size = np.diff(np.append(first, len(tile)))
    two = np.repeat(np.add.reduceat(side, first) > 0, size)

    def allowed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (part[i] != part[j]) & (~two[i] | (side[i] != side[j])) & may_link(n[i], n[j], percent) & may_link_at(n[i], n[j], pos[i], pos[j], percent)

    small = np.repeat(size <= 16, size)
    for gap in range(1, 16):
        i = np.flatnonzero(small[:-gap] & (tile[gap:] == tile[:-gap]))
        i = i[allowed(i, i + gap)]
        if len(i):
            yield i, i + gap
    for a, s in zip(first[size > 16].tolist(), size[size > 16].tolist(), strict=True):
        for k in range(a, a + s - 1, 64):
            i = np.arange(k, min(k + 64, a + s))
            x, y = np.nonzero(allowed(i[:, None], np.arange(k + 1, a + s)[None, :]) & (i[:, None] < np.arange(k + 1, a + s)[None, :]))
            if len(x):
                yield i[x], k + 1 + y


def spanning_forest(u: np.ndarray, v: np.ndarray, nodes: int) -> np.ndarray:
    """Edges (given best first) of the best spanning forest, by rounds of contraction."""
    label, live, chosen = np.arange(nodes), np.arange(len(u)), []
    while True:
        a, b = label[u[live]], label[v[live]]
        live, a, b = live[a != b], a[a != b], b[a != b]
        if not len(live):
            return np.unique(np.concatenate(chosen)) if chosen else live
        best = np.full(nodes, len(u))
        np.minimum.at(best, a, live)
        np.minimum.at(best, b, live)
        own = np.flatnonzero(best < len(u))
        chosen.append(best[own])
        x, y = label[u[best[own]]], label[v[best[own]]]
        to = np.arange(nodes)
        to[own] = np.where(x == own, y, x)
        back = (to[to] == np.arange(nodes)) & (np.arange(nodes) < to)
        to[back] = np.flatnonzero(back)
        while not np.array_equal(to, to[to]):
            to = to[to]
        label = to[label]


def _tiles(percent: int, forest: bool, every: bool):
    """Candidates of tiles.  Rows (tile, side, name, n, pos, component, sig) come sorted by
    tile.  ``forest``: a spanning forest of each tile; ``every``: all pairs; neither: all if
    they are few, else a forest, and the tile is named in ``again``.  ``hub`` is the class
    with most edges of a tile."""
    def compare(table: pa.Table) -> pa.RecordBatch | None:
        tile, side, name, n, pos, part = (table.column(c).to_numpy().astype(np.int64) for c in ("tile", "side", "name", "n", "pos", "component"))
        found = list(tile_pairs(tile, side, n, pos, part, percent))
        if not found:
            return None
        bitmaps, good = Bitmaps(table.column("sig").combine_chunks()), []
        for i, j in found:
            total, differ = n[i] + n[j], bitmaps.differences(i, j)
            ok = (100 + percent) * (total - differ) >= 2 * percent * total  # overlap <= (total - differ) / 2
            good.append((i[ok], j[ok], (differ / total)[ok]))
        i, j, far = (np.concatenate(x) for x in zip(*good, strict=True))
        order = np.argsort(far, kind="stable")
        i, j = i[order], j[order]
        number = np.cumsum(np.append(True, tile[1:] != tile[:-1])) - 1
        pairs, rows = np.bincount(number[i], minlength=number[-1] + 1), np.bincount(number)
        dense = (pairs > 2 * rows) if not (forest or every) else np.full(len(rows), forest)
        wide = dense[number[i]]
        if wide.any():
            node = np.unique(np.column_stack([number, part]), axis=0, return_inverse=True)[1].ravel()
            some = np.flatnonzero(wide)
            some = some[spanning_forest(node[i[some]], node[j[some]], int(node.max()) + 1)]
            take = np.sort(np.concatenate([np.flatnonzero(~wide), some]))
            i, j = i[take], j[take]
        ends = np.bincount(np.concatenate([i, j]), minlength=len(tile))
        top = np.lexsort((-ends, number))
        top = top[np.append(True, number[top][1:] != number[top][:-1])]
        top = top[ends[top] > 1] if forest else top[:0]
        again = np.unique(tile[dense[number]]) if not (forest or every) else tile[:0]
        a, b = np.minimum(name[i], name[j]), np.maximum(name[i], name[j])
        blank, count = pa.nulls, (len(a), len(top), len(again))
        column = lambda *x: pa.concat_arrays([y if isinstance(y, pa.Array) else pa.array(y) for y in x])
        return pa.RecordBatch.from_arrays([
            column(a, blank(count[1] + count[2], pa.int64())), column(b, blank(count[1] + count[2], pa.int64())),
            column(blank(count[0], pa.int64()), tile[top], again), column(blank(count[0], pa.int64()), name[top], blank(count[2], pa.int64())), column(np.zeros(count[0], np.int32), ends[top].astype(np.int32), np.zeros(count[2], np.int32)),
        ], names=["a", "b", "tile", "hub", "edges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            tile = held.column("tile").to_numpy()
            if not len(tile) or tile[0] == tile[-1]:
                continue
            cut = int(np.flatnonzero(tile != tile[-1])[-1]) + 1
            if (out := compare(held.slice(0, cut))) is not None:
                yield out
            held = held.slice(cut)
        if held is not None and held.num_rows and (out := compare(held)) is not None:
            yield out
    return run


CANDIDATE_SCHEMA = "a long, b long, tile long, hub long, edges int"


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (tile, name, n, pos, component) sorted by tile, the tiles of several components."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        tile = held.column("tile").to_numpy()
        if not len(tile) or tile[0] == tile[-1]:
            continue
        cut = int(np.flatnonzero(tile != tile[-1])[-1]) + 1
        yield from _mixed(held.slice(0, cut))
        held = held.slice(cut)
    if held is not None and held.num_rows:
        yield from _mixed(held)


def _mixed(table: pa.Table) -> Iterator[pa.RecordBatch]:
    tile, part = table.column("tile").to_numpy(), table.column("component").to_numpy()
    first = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
    several = np.minimum.reduceat(part, first) != np.maximum.reduceat(part, first)
    keep = np.repeat(several, np.diff(np.append(first, len(tile))))
    yield from table.filter(pa.array(keep)).combine_chunks().to_batches()


def _arrays(words: int):
    """The sorted grams of every text, as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, off in slices(batch, "text"):
                h, at = gram_sets(raw, off, words)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([h[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], names=["name", "grams"])
    return run


def _check(percent: int):
    """Pairs whose sets link: exact intersection of sorted arrays."""
    def links(x: np.ndarray, y: np.ndarray) -> bool:
        if len(x) > len(y):
            x, y = y, x
        both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        return 100 * both >= percent * (len(x) + len(y) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column(2), batch.column(3), strict=True)
            keep = pa.array([links(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in sets], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])
    return run


class _Join:
    def __init__(self, docs: DataFrame, words: int, percent: int):
        self.words, self.percent = words, percent
        self.docs = docs
        self.scratch = Scratch(docs.sparkSession)
        stored = self.scratch.stored
        ranks, hot = gram_ranks(docs, words)
        held = docs.sparkSession.sparkContext.broadcast(ranks)  # SLOTS bytes
        self.sets = stored(docs.mapInArrow(_sets(words, percent, held, hot), SET_SCHEMA), "sets")
        while True:
            full = self.sets.where("prefix is not null")
            self.classes = stored(full.groupBy("name").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.min(F.struct("doc", "th")).alias("at"), F.min("twin").alias("t0"), F.max("twin").alias("t1")), "classes")
            clash = self.classes.where("t0 <> t1").select("name", F.lit(True).alias("clash"))
            if clash.isEmpty():
                break
            # different sets of one 64-bit name: another name for each
            self.sets = stored(self.sets.join(clash, "name", "left").withColumn("name", F.when(F.col("clash"), F.xxhash64("name", "twin")).otherwise(F.col("name"))).drop("clash"), "sets")
        self.links = None
        self.linked = 0

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        own = Scratch(pairs.sparkSession)
        stored = own.stored
        pairs = stored(pairs, "pairs")
        n = pairs.count()
        wanted = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).distinct()
        wanted = stored(wanted.join(self.classes, "name").select("name", F.col("at.doc").alias("d"), F.col("at.th").alias("k")), "wanted", 2 * n)
        same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("th") == F.col("k"))
        few = wanted.count() <= BROADCAST_ROWS
        texts = self.docs.join(F.broadcast(wanted) if few else wanted, same).select("name", "text")
        arrays = stored(texts.mapInArrow(_arrays(self.words), "name long, grams binary"), "arrays").groupBy("name").agg(F.first("grams").alias("grams"))
        a, b = (arrays.select(F.col("name").alias(c), F.col("grams").alias(f"grams_{c}")) for c in "ab")
        both = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "grams_a", "grams_b")
        links = self.scratch.stored(both.mapInArrow(_check(self.percent), "a long, b long"), "links")
        own.drop()
        return links

    def add(self, links: DataFrame) -> None:
        self.links = links if self.links is None else self.links.unionByName(links)
        own = Scratch(links.sparkSession)
        self.parts = self.scratch.stored(connected_components(self.links, own), "components")
        own.drop()
        self.linked = self.parts.count()

    def part_of(self, df: DataFrame, name: str, out: str) -> DataFrame:
        if not self.linked:
            return df.withColumn(out, F.col(name))
        p = self.parts.select(F.col("node").alias(name), F.col("component").alias("__p"))
        p = F.broadcast(p) if self.linked <= BROADCAST_ROWS else p
        return df.join(p, name, "left").withColumn(out, F.coalesce("__p", name)).drop("__p")

    def compared(self, rows: DataFrame, forest: bool = False, every: bool = False) -> DataFrame:
        """Candidates of tiles (tile, side, name, n, pos, sig)."""
        rows = self.part_of(rows, "name", "component").select("tile", "side", "name", "n", "pos", "component", "sig")
        return self.scratch.stored(rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tiles(self.percent, forest, every), CANDIDATE_SCHEMA), "candidates")

    def pairs(self, found: DataFrame) -> DataFrame:
        return found.where("a is not null").select("a", "b").distinct()

    def first_tiles(self) -> None:
        """Links between classes that share keys.  Large groups are cut into blocks; the
        classes with most edges of all blocks are then shown to every block."""
        own = Scratch(self.sets.sparkSession)
        stored = own.stored
        keyed = self.sets.where("keys is not null").select("name", F.explode("keys").alias("key")).distinct()
        shared = stored(keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "shared")
        block = F.pmod(F.xxhash64("name", "key"), F.ceil(F.col("c") / TILE)).cast("int")
        rows = stored(keyed.join(shared, "key").select("key", "name", (F.col("c") > TILE).alias("large"), F.xxhash64("key", block).alias("tile")), "keyed")
        shown = lambda x: x.join(self.classes.select("name", "n", "sig"), "name").select("tile", F.lit(0).alias("side"), "name", "n", F.lit(0).alias("pos"), "sig")
        found = self.compared(shown(rows), forest=True)
        self.add(self.verified(self.pairs(found)))
        blocks = stored(rows.where("large").select("key", "tile").distinct(), "blocks")
        leaders = found.where("hub is not null").join(blocks, "tile").groupBy("key").agg(F.expr(f"slice(sort_array(collect_list(struct(edges, hub)), false), 1, {LEADERS})").alias("l"))
        leaders = stored(leaders.select("key", F.explode("l.hub").alias("name")), "leaders")
        if leaders.isEmpty():
            return own.drop()
        more = leaders.join(blocks, "key").select("key", "name", F.lit(True).alias("large"), "tile")
        again = rows.where("large").unionByName(more).dropDuplicates(["tile", "name"])
        self.add(self.verified(self.pairs(self.compared(shown(again), forest=True))))
        own.drop()

    def members(self) -> DataFrame:
        """tile, side, name, n, pos, sig: classes that share a gram of their prefixes, by tile."""
        own = Scratch(self.sets.sparkSession)
        stored = own.stored
        rows = self.sets.where("prefix is not null").select("name", "n", F.size("prefix").alias("m"), "hot", F.posexplode("prefix").alias("pos", "gram"))
        hot = F.col("pos") >= F.col("m") - F.col("hot")
        cold = rows.where(~hot).select("gram", "name", "n", "pos").repartition("gram").sortWithinPartitions("gram")
        grouped = stored(cold.mapInArrow(_groups(self.percent), MEMBER_SCHEMA), "grouped")
        small = self.part_of(grouped.where("not large"), "name", "component").select("tile", "name", "n", "pos", "component")
        small = small.repartition("tile").sortWithinPartitions("tile").mapInArrow(_several, small.schema)
        small = small.select("tile", F.lit(0).alias("side"), "name", "n", "pos")
        large = grouped.where("large").select(F.col("tile").alias("gram"), "name", "n", "pos").unionByName(rows.where(hot).select("gram", "name", "n", "pos"))
        tiles = stored(small.unionByName(self.blocks(large, own)), "tiles")
        tiles = self.scratch.stored(tiles.join(self.classes.select("name", "sig"), "name").select("tile", "side", "name", "n", "pos", "sig"), "tiles")
        own.drop()
        return tiles

    def blocks(self, rows: DataFrame, scratch: Scratch) -> DataFrame:
        """Tiles of large groups: bands of size, cut to blocks; a block meets those of its own band and of the next."""
        stored = scratch.stored
        rows = stored(self.part_of(rows.distinct(), "name", "component"), "large")
        mixed = stored(rows.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("gram"), "mixed")
        band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / self.percent) + 1e-9)).cast("int")
        rows = stored(rows.join(mixed, "gram", "left_semi").withColumn("band", band), "large")
        counts = stored(rows.groupBy("gram", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("m")), "bands")
        nxt = counts.select("gram", (F.col("band") - 1).alias("band"), F.col("m").alias("m_next"))
        prev = counts.select("gram", (F.col("band") + 1).alias("band"), F.col("m").alias("m_prev"))
        shape = stored(counts.join(nxt, ["gram", "band"], "left").join(prev, ["gram", "band"], "left").na.fill(0), "shape")
        rows = rows.join(shape, ["gram", "band"]).withColumn("own", F.pmod(F.xxhash64("name"), F.col("m")).cast("int"))
        upto = lambda m: F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>"))
        tile = lambda band, i, j, kind, side: F.struct(band.alias("band"), i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"), side.cast("int").alias("side"))
        own, b = F.col("own"), F.col("band")
        inside = F.transform(upto(F.col("m")), lambda j: tile(b, F.least(own, j), F.greatest(own, j), 0, F.when(own > j, 1).otherwise(0)))
        above = F.transform(upto(F.col("m_next")), lambda j: tile(b, own, j, 1, F.lit(0)))
        below = F.transform(upto(F.col("m_prev")), lambda j: tile(b - 1, j, own, 1, F.lit(1)))
        spread = rows.select("gram", "name", "n", "pos", F.explode(F.concat(inside, above, below)).alias("t"))
        return spread.select(F.xxhash64("gram", "t.band", "t.i", "t.j", "t.kind").alias("tile"), "t.side", "name", "n", "pos")

    def run(self) -> None:
        """Finds the components; of the tables only ``sets`` and ``parts`` are left."""
        self.join()
        self.scratch.drop(self.sets, *([self.parts] if self.linked else []))

    def join(self) -> None:
        self.first_tiles()
        tiles = self.members()
        found = self.compared(tiles)
        while True:  # ends: every turn but the last joins components
            links = self.verified(self.pairs(found))
            joined = not links.isEmpty()
            if joined:
                self.add(links)
            again = found.where("tile is not null").select("tile").distinct()
            if again.isEmpty():
                return
            tiles = tiles.join(again, "tile", "left_semi")
            if not joined:
                break
            found = self.compared(tiles)
        rest = self.verified(self.pairs(self.compared(tiles, every=True)))
        if not rest.isEmpty():
            self.add(rest)


def _labelled(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, Scratch]:
    """doc, th (text hash), n_shingles, name (of the set) and label (name of the component) of every row, and the tables that it reads."""
    base = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(text_col).alias("th"), F.col(text_col).alias("text"))
    join = _Join(base, words, percent)
    join.run()
    return join.part_of(join.sets.select("doc", "th", F.col("n").cast("long").alias("n_shingles"), "name"), "name", "label"), join.scratch


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, and th (text hash) and class for joining on."""
    rows, _ = _labelled(docs, id_col, text_col, words, percent)
    smallest = stored(rows.where("n_shingles > 0").groupBy("label").agg(F.min("doc").alias("least")), "smallest")
    out = rows.join(smallest, "label", "left")
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc")).alias("component_id"), "th")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without a component, and one row of each component: of the
    smallest id (nulls last), then text hash, any one of rows that are equal in both;
    all columns as they are."""
    rows, scratch = _labelled(docs, id_col, text_col, words, percent)
    rows = rows.where("n_shingles > 0")
    keys = scratch.stored(rows.groupBy("label", "doc", "th").agg(F.count("*").alias("c")), "keys")
    first = scratch.stored(keys.groupBy("label").agg(F.min(F.struct(F.col("doc").isNull().alias("no_id"), "doc", "th")).alias("first")), "first")
    d, k = free_names(docs, "gone_id", "gone_text")
    kept = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("th") == F.col("first.th"))
    some = keys.join(first, "label").select(F.col("doc").alias(d), F.col("th").alias(k), kept.alias("kept"), "c")
    some = scratch.stored(some.where("not kept or c > 1"), "gone")  # of repeated rows one comes back below
    scratch.drop(some)
    few = some.count() <= BROADCAST_ROWS
    same = F.col(id_col).cast("long").eqNullSafe(F.col(d)) & (text_key(text_col) == F.col(k))
    gone = some.select(d, k)
    out = docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
    repeated = some.where("kept").select(d, k)
    if repeated.isEmpty():
        return out
    return out.union(docs.join(F.broadcast(repeated) if few else repeated, same).dropDuplicates([d, k]).drop(d, k))
