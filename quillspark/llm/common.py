"""Helpers shared by the llm operators: Arrow text columns as flat byte arrays,
vectorised hashes and word finding, and places for intermediate tables.

Texts are handled as UTF-8 bytes in flat numpy arrays, a bounded slice of rows
at a time, so a task holds a few times ``SLICE_BYTES`` whatever its partition.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text a kernel handles at once (a longer text is handled alone).
SLICE_BYTES = 1 << 19

U64 = np.uint64


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table, under ``spark.checkpoint.dir``.

    That setting is the shared folder of a cluster.  Where it is unset, a local session
    (as in tests) gets a temporary folder; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, rows: int | None = None, each: int = 100_000) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and
    survives the loss of any executor.  If at most ``rows`` rows are known to come, the
    last stage has a task for every ``each`` of them, so small tables are few files."""
    return Scratch(df.sparkSession).stored(df, name, rows, each)


class Scratch:
    """Intermediate tables of one piece of work, which go when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def stored(self, df: DataFrame, name: str, rows: int | None = None, each: int = 100_000) -> DataFrame:
        """As ``stored``, and remembered."""
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // each)))
        path = scratch_dir(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((path, out))
        return out

    def drop(self, *keep: DataFrame) -> None:
        """Deletes all tables but ``keep``."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path, df in self.tables:
            if not any(df is k for k in keep):
                at = hadoop(path)
                at.getFileSystem(conf).delete(at, True)
        self.tables = [(path, df) for path, df in self.tables if any(df is k for k in keep)]


#: Settings of a session that runs these operators: bytes and rows of an Arrow batch (texts
#: are long, and a task holds a few batches), and shuffle files go when their query has ended.
SETTINGS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's folder.  Also makes the ``SETTINGS`` of the session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


# --------------------------------------------------------------------------
# Arrow text columns as flat bytes
# --------------------------------------------------------------------------

def flat_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets of its values.

    A null counts as the empty text.  No copy is made of the bytes.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) else b"")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if large else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    raw = raw[offsets[0]:offsets[-1]]
    return raw, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows holding at most ``most`` bytes of text."""
    if not batch.num_rows:
        return
    raw, off = flat_bytes(batch.column(batch.schema.names.index(column)))
    i, n = 0, batch.num_rows
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield batch.slice(i, j - i), raw[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


# --------------------------------------------------------------------------
# Hashes
# --------------------------------------------------------------------------

_ODD = U64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240607)
#: A random 64-bit value for each byte.
BYTE_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the result."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(31)
    x *= U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


def grouped_sums(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``x`` of the given sizes (0 for an empty run)."""
    out = np.zeros(len(size), x.dtype)
    some = size > 0
    if some.any():
        out[some] = np.add.reduceat(x, (np.cumsum(size) - size)[some])
    return out


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = BYTE_TABLE, seed: int = 0) -> np.ndarray:
    """A hash of the bytes of every span, the same wherever it lies.

    Byte and place are mixed before they are summed, so unlike a polynomial modulo
    2**64 it has no texts that collide by construction.
    """
    size = end - start
    place = ranges(size)
    x = table[raw[np.repeat(start, size) + place]]
    x += (place.astype(np.uint64) + U64(seed * 0x1000003 + 1)) * _ODD
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    return mix(grouped_sums(x, size) + size.astype(np.uint64) * _ODD)


def chain_hashes(names: np.ndarray, at: np.ndarray, stop: np.ndarray, most: int) -> np.ndarray:
    """A hash of the sequence names[at:stop] of at most ``most`` names."""
    x = (stop - at).astype(np.uint64)
    for i in range(most):
        inside = at + i < stop
        if inside.all():
            x = mix(x * _ODD + names[at + i])
        else:
            x[inside] = mix(x[inside] * _ODD + names[at[inside] + i])
    return x


def set_hash(values: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """A hash of every set, given as consecutive runs of distinct values."""
    return mix(grouped_sums(mix(values ^ mix(np.array([seed], np.uint64))), size) + size.astype(np.uint64) * _ODD)


def distinct_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One span for each distinct byte string, and the number of its string for every
    span.  Exact: hashes group the spans, then their bytes are compared."""
    _, one, which = np.unique(span_hashes(raw, start, end), return_index=True, return_inverse=True)
    first, size = one[which], end - start
    same = bool((size == size[first]).all())
    if same:
        place = ranges(size)
        same = bool((raw[np.repeat(start, size) + place] == raw[np.repeat(start[first], size) + place]).all())
    if not same:
        data, known = raw.tobytes(), {}
        which = np.array([known.setdefault(data[a:b], len(known)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
        _, one = np.unique(which, return_index=True)
    return one, which


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int = int(_ODD)):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([[U64(1)], np.cumprod(np.full(size - 1, self.base, np.uint64))])
                self.down = np.concatenate([[U64(1)], np.cumprod(np.full(size - 1, self.inverse, np.uint64))])
        return self.up[:n], self.down[:n]


POWERS = Powers()


def rolling_hashes(raw: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` bytes from every place on.  A polynomial modulo 2**64: it may
    choose places to look at, but equal hashes are no proof of equal bytes."""
    up, down = POWERS.get(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.multiply(BYTE_TABLE[raw], up[:-1], out=prefix[1:])
    np.cumsum(prefix[1:], out=prefix[1:])
    return mix((prefix[n:] - prefix[:-n]) * down[:len(raw) - n + 1])


def text_key(column: str | Column) -> Column:
    """Two 64-bit hashes of a text, which beside an id tell rows apart."""
    return F.struct(F.xxhash64(column).alias("a"), F.xxhash64(F.lit(1), column).alias("b"))


TEXT_KEY = "struct<a:bigint,b:bigint>"


# --------------------------------------------------------------------------
# Words: [^\x20\x09-\x0D]+
# --------------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(raw: np.ndarray, off: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the index of its first word (n+1).
    A word is a maximal run of bytes that are not ``outside``."""
    inside = ~outside[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = off[1:-1]
    bounds = bounds[bounds < len(raw)]
    first[bounds] = inside[bounds]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = bounds[bounds > 0] - 1
    last[ends] = inside[ends]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)

