"""Removal of long repeated byte strings (suffix-array dedup), blockwise.

A byte is removed when a string of ``length`` bytes that covers it also starts
anywhere else in the corpus.  All suffixes are never sorted at once:

* Suffix buckets.  The ``length`` bytes at a start hold a smallest ``GRAM``-gram
  (by hash); it is the start's *anchor*.  Equal strings have equal anchors at
  equal distances, so suffixes are compared only inside the bucket of one anchor.
  Runs of starts share an anchor, so a bucket holds one row a run.  Buckets of one row
  are dropped at once, and of runs whose whole extents are equal one is kept.
* A task sorts one bucket at a time: its suffixes by distance to the anchor and their first ``PERIOD``
  bytes.  Long ties are resolved by ranks of a cover sample: the places of the
  extents that fall on a difference cover modulo ``PERIOD``, ranked by prefix doubling.
  For any two places the cover has an offset below ``PERIOD`` at which both are sampled;
  the ranks there, and the last bytes, decide whether the strings are equal.
* A bucket of more than ``BUCKET`` extents (text around a very common passage) would
  not fit a task.  It is cut at every ``PERIOD``-th place before the anchor; blocks whose common
  core occurs once are dropped, and only where sides differ come they down to single starts, all by
  grouping with partial sums and joins that Spark may split.

Defined cases: a null text is the empty text; texts shorter than ``length`` keep
everything; texts of any length are taken whole; a null id is an id of its own; rows
with equal id are told apart by a 128-bit hash of their text, and equal rows count as copies of each
other (both lose the text); an empty table gives an empty result; other columns are
passed by and never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_KEY, Scratch, U64, mix, ranges, rolling_hashes, signed, slices, span_hashes, text_key

LENGTH = 400
GRAM = 64
PERIOD = 32
#: Extents of a bucket that one task sorts, at most, and bytes of whole buckets it takes at a time.
BUCKET, BATCH_BYTES = 512, 1 << 20
#: Rows of the list of documents with open runs that may be broadcast (24 bytes
#: each); beyond it the join is a shuffled one.
BROADCAST_ROWS = 500_000

_LOW = U64((1 << 24) - 1)
RUN_SCHEMA = f"doc long, th {TEXT_KEY}, h long, x long, s int, e int, p int"
EXTENT_SCHEMA = f"h long, doc long, th {TEXT_KEY}, s int, p int, n long, extent binary"
SPAN_SCHEMA = f"doc long, th {TEXT_KEY}, lo int, hi int"
BLOCK_SCHEMA = f"doc long, th {TEXT_KEY}, k1 long, k2 long, lo int, t0 int, cnt int, side binary"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest value of every window of ``w``: block minima from both sides."""
    n = len(x)
    blocks = -(-n // w)
    y = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    y[:n] = x
    y = y.reshape(blocks, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    behind = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    return np.minimum(behind[:m], ahead[w - 1:w - 1 + m])


def anchor_runs(raw: np.ndarray, off: np.ndarray, length: int, gram: int):
    """Runs of starts with one anchor: text number, first and last start, anchor,
    hash of the anchor's gram, hash of the run's extent (bytes in the slice)."""
    n = len(raw)
    if n < length:
        z = np.empty(0, np.int64)
        return z, z, z, z, z.view(np.uint64), z.view(np.uint64)
    name = rolling_hashes(raw, gram)
    out: list[np.ndarray] = []
    step = 1 << 23  # places are 24 bits of the sort key, so a very long text is cut
    starts_total = n - length + 1
    for a in range(0, starts_total, step):
        b = min(a + step, starts_total)
        part = name[a:b + length - gram]
        key = (part & ~_LOW) | np.arange(len(part), dtype=np.uint64)
        out.append((sliding_min(key, length - gram + 1) & _LOW).astype(np.int64) + a)
    pos = np.concatenate(out)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))[:len(pos)]
    whole = np.arange(len(pos)) + length <= off[text + 1]
    new = np.ones(len(pos), bool)
    new[1:] = (pos[1:] != pos[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new & whole)
    breaks = np.append(np.flatnonzero(new | ~whole), len(pos))
    last = breaks[np.searchsorted(breaks, first, side="right")] - 1
    anchor = pos[first]
    extent = mix(span_hashes(raw, first, last + length) + (anchor - first).astype(np.uint64))
    return text[first], first, last, anchor, name[anchor], extent


def _runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, off in slices(batch, "text"):
                t, s, e, p, h, x = anchor_runs(raw, off, length, gram)
                if not len(t):
                    continue
                at = off[:-1][t]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(t)), rows.column(1).take(pa.array(t)), pa.array(signed(h)), pa.array(signed(x)), pa.array((s - at).astype(np.int32)), pa.array((e - at).astype(np.int32)), pa.array((p - at).astype(np.int32))],
                    names=["doc", "th", "h", "x", "s", "e", "p"],
                )
    return run


def _flat_runs(rows: pa.RecordBatch, *names: str) -> tuple[np.ndarray, ...]:
    """The text number of every run of a slice, and the named fields of the runs."""
    runs = rows.column(rows.schema.names.index("runs"))
    flat = runs.flatten()
    fields = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names)
    return np.repeat(np.arange(len(runs)), np.diff(np.asarray(runs.offsets))), *fields


def _extents(length: int):
    """The bytes of runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, off in slices(batch, "text"):
                text, h, s, e, p, n = _flat_runs(rows, "h", "s", "e", "p", "n")
                size, at = e - s + length, off[:-1][text] + s
                for i in range(0, len(h), 4096):
                    k = slice(i, i + 4096)
                    data = raw[np.repeat(at[k], size[k]) + ranges(size[k])]
                    bounds = np.concatenate([[0], np.cumsum(size[k])]).astype(np.int32)
                    t = pa.array(text[k])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[k]), rows.column(0).take(t), rows.column(1).take(t), pa.array(s[k].astype(np.int32)), pa.array(p[k].astype(np.int32)), pa.array(n[k]), pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])],
                        names=["h", "doc", "th", "s", "p", "n", "extent"],
                    )
    return run


@cache
def difference_cover(period: int) -> tuple[np.ndarray, np.ndarray]:
    """Residues of which two differ by every d, found greedily, and for all residues i, j
    the least offset that brings both onto them."""
    cover, missing = [0], set(range(1, period))
    while missing:
        gain = lambda x: len(missing & {d % period for c in cover for d in (x - c, c - x)})
        x = max((x for x in range(period) if x not in cover), key=gain)
        missing -= {d % period for c in cover for d in (x - c, c - x)}
        cover.append(x)
    on = np.zeros(period, bool)
    on[cover] = True
    turned = np.array([np.roll(on, -i) for i in range(period)])  # turned[i, d]: i + d is on the cover
    return on, (turned[:, None, :] & turned[None, :, :]).argmax(2)


def _words(data: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """``width`` bytes from every place, as numbers that sort like the bytes (last first, for lexsort)."""
    out = []
    for i in range(0, width, 8):
        x = np.zeros(len(at), np.uint64)
        for j in range(i, min(i + 8, width)):
            x = (x << U64(8)) | data[at + j]
        out.append(x)
    return out[::-1]


def _dense(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys (last one first), and the rank of each: equal keys have equal ranks."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def cover_ranks(data: np.ndarray, end: np.ndarray, at: np.ndarray, width: int, period: int) -> np.ndarray:
    """For every place ``at`` (or -1 where fewer bytes are left before ``end``) the rank of
    its next ``width`` bytes, a multiple of the period, by prefix doubling: a sample and a
    period add up to a sample again."""
    spot = np.full(len(data) + 1, -1, np.int64)
    rank = np.full(len(at), -1, np.int64)
    some = np.flatnonzero(at + period <= end)
    rank[some] = _dense(_words(data, at[some], period))[1]
    held = period
    while held < width:
        step = min(held, width - held)
        spot[at] = rank
        some = np.flatnonzero(at + held + step <= end)
        nxt = np.full(len(at), -1, np.int64)
        nxt[some] = _dense([spot[at[some] + step], rank[some]])[1]
        rank, held = nxt, held + step
    return rank


def repeated_starts(data: np.ndarray, off: np.ndarray, bucket: np.ndarray, begin: np.ndarray, anchor: np.ndarray, length: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Extent and offset of every start in ``data`` (extents from off to off) whose ``length``
    bytes occur at another start of its bucket.  ``begin``: place of each extent in its text;
    ``anchor``: of its anchor."""
    count = np.diff(off) - length + 1
    ext = np.repeat(np.arange(len(count)), count)
    offset = ranges(count)
    at = off[:-1][ext] + offset
    far = (anchor - begin)[ext] - offset
    group = np.unique(bucket, return_inverse=True)[1][ext] * (length + 1) + far
    # a string whose group, first and last bytes are its own can't repeat
    ends = mix(mix(_words(data, at, min(8, length))[0] + U64(1)) + _words(data, at + max(length - 8, 0), min(8, length))[0] + mix(group.astype(np.uint64)))
    _, which, times = np.unique(ends, return_inverse=True, return_counts=True)
    some = np.flatnonzero(times[which] > 1)
    if not len(some):
        return ext[:0], offset[:0]
    order, tie = _dense([*_words(data, at[some], period), group[some]])
    some, tie = some[order], tie[order]
    size = np.bincount(tie)
    some, tie = some[size[tie] > 1], tie[size[tie] > 1]
    if not len(some):
        return ext[:0], offset[:0]
    # ranks of the cover sample, at places of the texts
    on, meet = difference_cover(period)
    width = (length - period + 1) // period * period
    place = np.arange(len(data)) - np.repeat(off[:-1] - begin, np.diff(off))
    sample = np.flatnonzero(on[place % period])
    rank = np.full(len(data) + 1, -1, np.int64)
    if width:
        rank[sample] = cover_ranks(data, np.repeat(off[1:], np.diff(off))[sample], sample, width, period)
    residue = place[at[some]] % period
    twice = np.zeros(len(some), bool)
    tail = np.arange(min(width, length - 1) if width else 0, length)
    live = np.arange(len(some))
    while len(live):  # every turn settles all strings that are equal to the first of their tie
        t = tie[live]
        first = np.append(True, t[1:] != t[:-1])
        lead = live[np.flatnonzero(first)[np.cumsum(first) - 1]]
        d = meet[residue[lead], residue[live]]
        a, b = at[some[lead]], at[some[live]]
        same = (rank[a + d] == rank[b + d]) if width else np.ones(len(live), bool)
        check = np.flatnonzero(same & (lead != live))
        for k in range(0, len(check), 4096):
            c = check[k:k + 4096]
            same[c] = (data[a[c][:, None] + tail] == data[b[c][:, None] + tail]).all(1)
        pair = same & (lead != live)
        twice[live[pair]] = True
        twice[lead[pair]] = True
        live = live[~same]
    hit = np.sort(some[twice])
    return ext[hit], offset[hit]


def _sorted_buckets(length: int, period: int):
    """Rows of extents, sorted by bucket: spans that repeat within their bucket."""
    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        extent = table.column("extent").combine_chunks()
        off = np.asarray(extent.buffers()[1]).view(np.int32)[extent.offset:extent.offset + len(extent) + 1].astype(np.int64)
        data = np.frombuffer(extent.buffers()[2], np.uint8)[off[0]:off[-1]]
        h, s, p, n = (table.column(c).to_numpy().astype(np.int64) for c in ("h", "s", "p", "n"))
        ext, offset = repeated_starts(data, off - off[0], h, s, p, length, period)
        once = n[ext] == 1  # of others all starts are settled
        ext, offset = ext[once], offset[once]
        if not len(ext):
            return
        new = np.ones(len(ext), bool)
        new[1:] = (ext[1:] != ext[:-1]) | (offset[1:] != offset[:-1] + 1)
        a = np.flatnonzero(new)
        z = np.append(a[1:], len(ext)) - 1
        rows, lo, hi = pa.array(ext[a]), s[ext[a]] + offset[a], s[ext[a]] + offset[z] + length
        doc, th = (table.column(c).take(rows).combine_chunks() for c in ("doc", "th"))
        yield pa.RecordBatch.from_arrays([doc, th, pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["doc", "th", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < BATCH_BYTES:
                continue
            table = pa.Table.from_batches(held)
            h = table.column("h").to_numpy()
            if h[0] == h[-1]:
                continue
            cut = int(np.flatnonzero(h != h[-1])[-1]) + 1
            yield from settle(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held)
        if held and sum(b.num_rows for b in held):
            yield from settle(pa.Table.from_batches(held))
    return run


def _blocks(length: int, period: int):
    """Runs cut at every ``period``-th place before their anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, off in slices(batch, "text"):
                text, h, s, e, p = _flat_runs(rows, "h", "s", "e", "p")
                low, high = (p - e) // period, (p - s) // period
                n = high - low + 1
                k = np.repeat(np.arange(len(n)), n)
                b = low[k] + ranges(n)
                at = off[:-1][text[k]]
                first, last = p[k] - (b * period + period - 1), p[k] - b * period  # starts of the whole block
                lo, hi = np.maximum(first, s[k]), np.minimum(last, e[k])
                own = mix(h[k].view(np.uint64) + b.astype(np.uint64))
                # the core, which all starts of the block share, may begin before the text's first
                # start of the block or end behind the last one's end, but never outside of the extent
                k1, k2 = (mix(span_hashes(raw, at + last, at + first + length, seed=i) ^ own) for i in (1, 2))
                # PERIOD-1 bytes on either side; outside of the starts' own text they are 0
                j = np.arange(period - 1)
                left, right = (at + first)[:, None] + j, (at + first + length)[:, None] + j
                safe = lambda i: raw[np.clip(i, 0, max(len(raw) - 1, 0))]
                ls = np.where(left >= (at + lo)[:, None], safe(left), 0).astype(np.uint8)
                rs = np.where(right < (at + hi + length)[:, None], safe(right), 0).astype(np.uint8)
                side = np.concatenate([ls, rs], axis=1)
                bounds = np.arange(len(side) + 1, dtype=np.int32) * (2 * (period - 1))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(text[k])), rows.column(1).take(pa.array(text[k])), pa.array(signed(k1)), pa.array(signed(k2)), pa.array(lo.astype(np.int32)), pa.array((lo - first).astype(np.int32)), pa.array((hi - lo + 1).astype(np.int32)),
                     pa.Array.from_buffers(pa.binary(), len(side), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(side))])],
                    names=["doc", "th", "k1", "k2", "lo", "t0", "cnt", "side"],
                )
    return run


def merge_spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [first, last); touching spans are one run."""
    if not len(first):
        return first, last
    o = np.argsort(first, kind="stable")
    a, z = first[o], np.maximum.accumulate(last[o])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > z[:-1]
    at = np.flatnonzero(new)
    return a[at], z[np.append(at[1:], len(a)) - 1]


def _cut(with_text: bool):
    """n_bytes, n_removed, n_spans, hash of what is kept; the kept text itself only if asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, off in slices(batch, "text"):
                yield one(rows, raw, off)

    def one(rows: pa.RecordBatch, raw: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        spans = rows.column(rows.schema.names.index("spans"))
        bounds, flat = np.asarray(spans.offsets) - spans.offsets[0].as_py(), spans.flatten()
        lo, hi = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
        size, removed, pieces, digest, kept = [], [], [], [], []
        for i in range(rows.num_rows):
            text = raw[off[i]:off[i + 1]]
            a, z = merge_spans(lo[bounds[i]:bounds[i + 1]], hi[bounds[i]:bounds[i + 1]])
            cuts = [0, *np.ravel(np.column_stack([a, z])).tolist(), len(text)]
            left = b"".join(text[cuts[j]:cuts[j + 1]].tobytes() for j in range(0, len(cuts), 2))
            size.append(len(text))
            removed.append(int(z.sum() - a.sum()))
            pieces.append(len(a))
            digest.append(hashlib.sha256(left).hexdigest())
            if with_text:
                kept.append(left.decode("utf-8", "ignore"))
        names = rows.schema.names
        keep = [i for i, c in enumerate(names) if c not in ("text", "spans")]
        columns = [rows.column(i) for i in keep] + [pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(pieces, pa.int64()), pa.array(digest, pa.string())]
        return pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.string())] if with_text else []), names=[names[i] for i in keep] + ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)
    return run


def _with_texts(base: DataFrame, runs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc, th, text, runs of the documents that have runs (doc, th, h, s, e, p, n)."""
    wanted = scratch.stored(runs.groupBy("doc", "th").agg(F.collect_list(F.struct("h", "s", "e", "p", "n")).alias("runs")), "open")
    w = wanted.select(F.col("doc").alias("d"), F.col("th").alias("k"), "runs")
    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("th") == F.col("k"))
    if wanted.count() <= BROADCAST_ROWS:
        base = base.join(F.broadcast(w.select("d", "k")), same, "left_semi")
    return base.join(w, same).select("doc", "th", "text", "runs")


def _block_spans(base: DataFrame, extents: DataFrame, length: int, period: int, scratch: Scratch) -> DataFrame:
    """Spans of the extents of buckets too large for a task."""
    stored = scratch.stored
    blocks = stored(_with_texts(base, extents, scratch).mapInArrow(_blocks(length, period), BLOCK_SCHEMA).withColumn("side_name", F.struct(F.xxhash64("side", "t0", "cnt").alias("a"), F.xxhash64(F.lit(1), "side", "t0", "cnt").alias("b"))), "blocks")
    key = ["k1", "k2"]
    core = blocks.groupBy(*key).agg(F.count("*").alias("c"), F.min("side_name").alias("a"), F.max("side_name").alias("z")).where("c > 1").select(*key, (F.col("a") != F.col("z")).alias("open"))
    shared_core = stored(blocks.join(stored(core, "core"), key), "cores")
    by_side = stored(shared_core.where("open").groupBy(*key, "side_name").agg(F.count("*").alias("n")), "sides")
    sided = shared_core.where("open").join(by_side, [*key, "side_name"])
    whole = shared_core.where("not open").select("doc", "th", "lo", "cnt").unionByName(sided.where("n > 1").select("doc", "th", "lo", "cnt"))
    spans = whole.select("doc", "th", "lo", (F.col("lo") + F.col("cnt") - 1 + length).alias("hi"))
    # Single starts of blocks whose sides differ: (core, side bytes) is the name.
    one = sided.groupBy(*key, "side_name").agg(F.first(F.struct("doc", "th", "lo", "t0", "cnt", "side", "n")).alias("r")).select(*key, "r.*")
    starts = one.select("doc", "th", "n", *key, "lo", "t0", "side", F.explode(F.sequence(F.lit(0), F.col("cnt") - 1)).alias("i"))
    t = F.col("t0") + F.col("i")
    own = F.substring("side", t + 1, F.lit(period - 1))
    starts = stored(starts.select("doc", "th", "n", (F.col("lo") + F.col("i")).alias("lo"), F.xxhash64(*key, t, own).alias("a"), F.xxhash64(F.lit(1), *key, t, own).alias("b")), "starts")
    twice = stored(starts.groupBy("a", "b").agg(F.count("*").alias("c")).where("c > 1").select("a", "b"), "twice")
    single = starts.where("n = 1").join(twice, ["a", "b"], "left_semi").select("doc", "th", "lo", (F.col("lo") + length).alias("hi"))
    return spans.unionByName(single)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, period: int = PERIOD, bucket: int = BUCKET) -> DataFrame:
    """Spans of repeated text: doc, th (text hashes), spans array<struct<lo,hi>> of
    bytes, overlapping as they were found; only of texts that have any."""
    scratch = Scratch(docs.sparkSession)
    stored = scratch.stored
    base = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(text_col).alias("th"), F.col(text_col).alias("text"))
    long_enough = base.where(F.octet_length("text") >= length)
    runs = stored(long_enough.mapInArrow(_runs(length, gram), RUN_SCHEMA), "runs")

    # Buckets of one row can't repeat; in buckets with one extent every row does.
    # (Sums are stored before they are joined back: only then are both sides of the
    # join plain exchanges, which Spark splits where a name is hot.)
    buckets = runs.groupBy("h").agg(F.count("*").alias("c"), F.min("x").alias("x0"), F.max("x").alias("x1")).where("c > 1").select("h", (F.col("x0") != F.col("x1")).alias("open"))
    shared = stored(runs.join(stored(buckets, "buckets"), "h"), "shared")
    several = shared.where("open")
    extent = several.groupBy("h", "x").agg(F.count("*").alias("n"), F.min(F.struct("doc", "th", "s", "e", "p")).alias("r"))
    extent = stored(extent.select("h", "x", "n", "r.*"), "extents")
    closed = shared.where("not open").select("doc", "th", "s", "e").unionByName(
        several.join(extent.where("n > 1").select("h", "x"), ["h", "x"], "left_semi").select("doc", "th", "s", "e"))
    spans = closed.select("doc", "th", F.col("s").alias("lo"), (F.col("e") + length).alias("hi"))

    # One row of every extent in a bucket of several is compared with the others.
    large = stored(extent.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > bucket).select("h"), "large")
    rows = _with_texts(base, extent.join(large, "h", "left_anti"), scratch).mapInArrow(_extents(length), EXTENT_SCHEMA)
    rows = rows.repartition("h").sortWithinPartitions("h")
    spans = spans.unionByName(stored(rows.mapInArrow(_sorted_buckets(length, period), SPAN_SCHEMA), "sorted"))
    if not large.isEmpty():
        spans = spans.unionByName(_block_spans(base, extent.join(large, "h", "left_semi"), length, period, scratch))
    found = stored(spans.groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    scratch.drop(found)
    return found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, carry: bool = False, with_text: bool = False) -> DataFrame:
    """One row a document: its id, carried (a struct of all columns but the text, if
    ``carry``), n_bytes, n_removed, n_spans, kept_sha256 and, if ``with_text``, kept
    (what is left; bytes of a code point that a cut has broken are left out of it)."""
    spans = repeated_spans(docs, id_col, text_col, length, gram).select(F.col("doc").alias("d"), F.col("th").alias("k"), "spans")
    rest = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("carried")] * carry
    names = ["doc_id"] + ["carried"] * carry
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), *rest, F.col(text_col).alias("text"))
    joined = base.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (text_key("text") == F.col("k")), "left")
    joined = joined.select(*names, "text", F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int>>")).alias("spans"))
    kinds = [f"{c} {joined.schema[c].dataType.simpleString()}" for c in names]
    return joined.mapInArrow(_cut(with_text), ", ".join(kinds + ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string"] + ["kept string"] * with_text))
