"""Merkle manifest of a dataset: a tree for each language, a tree over their roots, and
a proof for every document, by supersteps over RDDs as in Pregel.

A digest is ``H``, the lowercase hex SHA-256 of its inputs' text put together.  A leaf is
H of a document's fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value.
The leaves of a tree ascend by id; while it has several nodes, every two consecutive ones
(the last alone, if they are odd in number) become their H.  The trees' roots, by name
bytewise, null first, are the leaves of the last tree.

A vertex of the computation is a run of ``2**LEVELS`` nodes that stand side by side.
Upward, nodes send their digests to the vertex above; a vertex that has heard from all its
children hashes them, level by level, and forwards one digest.  Downward, a vertex hears the
siblings on the way from itself to the root and tells every child its own way.  Messages
between nodes of one vertex never leave its task, so a tree of n leaves takes
log2(n) / LEVELS shuffles each way, and no task holds more than its vertices, whatever share
of all documents a language has.  The vertices of a superstep are a table in the shared
folder: a lost executor costs a rerun of its tasks alone.

Defined cases: null fields are ``-``; a null id comes first in its tree; a null language is
a tree of its own; rows of one id are leaves each, ordered by their digests (equal ones may
change places, which no digest shows); texts of any length are hashed whole (in the JVM);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Levels that a superstep climbs: a vertex has up to 2**LEVELS children.
LEVELS = 8
RUN = 1 << LEVELS
#: What stands beside a node on its way up: nothing, a left or a right sibling.
ALONE, LEFT, RIGHT = b"-", b"<", b">"
_STEP = 33

VERTEX = "tree long, block long, nodes long, digests binary, ids array<long>, claims array<binary>"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
NUMBER_BITS = 33  # of monotonically_increasing_id: the row within its partition


def joined(*digests: bytes) -> bytes:
    """H of digests, as hex text."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def leaf_digest(fields: list[Column]) -> Column:
    """H of a record's fields, as 32 bytes."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256))


def levels_of(nodes: list[bytes], height: int) -> list[list[bytes]]:
    """The nodes and the ``height`` levels above them."""
    out = [nodes]
    for _ in range(height):
        below = out[-1]
        out.append([joined(*below[i:i + 2]) for i in range(0, len(below), 2)])
    return out


def height_of(nodes: int) -> int:
    """Levels from ``nodes`` nodes side by side up to a single one, or to the next vertices."""
    return min(LEVELS, (nodes - 1).bit_length())


def ways(levels: list[list[bytes]]) -> Iterator[bytes]:
    """For every node of the lowest level, the siblings on its way to the highest."""
    for i in range(len(levels[0])):
        steps = []
        for nodes in levels[:-1]:
            j = i ^ 1
            steps.append((RIGHT if j > i else LEFT) + nodes[j] if j < len(nodes) else ALONE + bytes(32))
            i >>= 1
        yield b"".join(steps)


def fold(digest: bytes, way: bytes) -> bytes:
    """The root that a digest leads to, given its siblings."""
    for at in range(0, len(way), _STEP):
        side, other = way[at:at + 1], way[at + 1:at + _STEP]
        digest = joined(other, digest) if side == LEFT else joined(digest, other) if side == RIGHT else joined(digest)
    return digest


def proof_digest(way: bytes) -> str:
    """H of the siblings of a way, in its order."""
    steps = (way[at:at + _STEP] for at in range(0, len(way), _STEP))
    return sha256("".join(s[1:].hex() for s in steps if s[:1] != ALONE).encode()).hexdigest()


# --- numbering ----------------------------------------------------------------------------------

def numbered(table: DataFrame, keys: list[Column], number: str, scratch: Scratch, name: str) -> DataFrame:
    """``table`` (a stored one) with the place of each row in the order of ``keys``, from 0.

    Rows are sorted over all tasks; a row's place is its partition's first place and its own
    within it.  Only a count for each partition comes to the driver.
    """
    at = scratch.stored(table.orderBy(*keys).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", NUMBER_BITS)
    sizes, first, total = {r["p"]: r["n"] for r in at.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}, [], 0
    for p in range(max(sizes, default=-1) + 1):
        first.append(total)
        total += sizes.get(p, 0)
    starts = F.array(*map(F.lit, first or [0])).cast("array<long>")
    return at.withColumn(number, F.get(starts, part.cast("int")) + F.col("_at") - F.shiftleft(part, NUMBER_BITS)).drop("_at")


# --- supersteps -----------------------------------------------------------------------------------

Child = tuple[int, bytes, int | None, bytes | None]  # place within the vertex, digest, id, claim


def _messages(nodes: Iterator[tuple]) -> Iterator[tuple[tuple[int, int], tuple[int, list[Child]]]]:
    """Nodes (tree, nodes of its level, place, digest, id, claim) to the vertex above; those that
    come side by side go as one message."""
    for (tree, block), run in groupby(nodes, key=lambda r: (r[0], r[2] >> LEVELS)):
        run = list(run)
        yield (tree, block), (run[0][1], [(r[2] & RUN - 1, bytes(r[3]), r[4], r[5]) for r in run])


def _complete(message: tuple) -> tuple:
    """A vertex once all its children have been heard."""
    (tree, block), heard = message
    heard = list(heard)
    nodes, children = heard[0][0], sorted((c for _, part in heard for c in part), key=lambda c: c[0])
    expected = min(RUN, nodes - block * RUN)
    if [c[0] for c in children] != list(range(expected)):
        raise ValueError(f"vertex {block} of tree {tree} heard from {len(children)} of {expected} children")
    own = any(c[2] is not None or c[3] is not None for c in children)
    return tree, block, nodes, b"".join(c[1] for c in children), [c[2] for c in children] if own else None, [c[3] for c in children] if own else None


def _digests(vertex) -> list[bytes]:
    raw = bytes(vertex["digests"])
    return [raw[i:i + 32] for i in range(0, len(raw), 32)]


def _forward(vertex) -> tuple:
    """What a vertex tells the one above it."""
    top = levels_of(_digests(vertex), height_of(vertex["nodes"]))[-1][0]
    return vertex["tree"], -(-vertex["nodes"] // RUN), vertex["block"], top, None, None


def climb(spark: SparkSession, nodes: RDD, most: int, tasks: int, scratch: Scratch) -> list[DataFrame]:
    """Upward supersteps; the vertices of each, lowest first.  ``most``: leaves of the largest tree."""
    out: list[DataFrame] = []
    while True:
        vertices = nodes.mapPartitions(_messages).groupByKey(tasks).map(_complete)
        out.append(scratch.stored(spark.createDataFrame(vertices, VERTEX, verifySchema=False), f"vertices{len(out)}"))
        if most <= RUN:
            return out
        most = -(-most // RUN)
        nodes = out[-1].where(F.col("nodes") > RUN).rdd.map(_forward)


def tops(vertices: list[DataFrame]) -> RDD:
    """(tree, (superstep of its highest vertex, root)) of every tree."""
    found = [v.where(F.col("nodes") <= RUN).rdd.map(lambda r, s=s: (r["tree"], (s, _forward(r)[3]))) for s, v in enumerate(vertices)]
    return found[0].context.union(found)


def _tell(heard: tuple) -> Iterator[tuple[tuple[int, int], tuple[bytes, bytes]]]:
    """A vertex that knows its way to the root tells its children theirs."""
    vertex, (way, root) = heard
    own = ways(levels_of(_digests(vertex), height_of(vertex["nodes"])))
    for i, steps in enumerate(own):
        yield (vertex["tree"], vertex["block"] * RUN + i), (steps + way, root)


def descend(vertices: list[DataFrame], entry: RDD, tasks: int) -> RDD:
    """Downward supersteps: (vertex, (way, subroot)) of every lowest vertex.  ``entry`` has
    (tree, (superstep, (way, subroot))) of the trees' highest vertices."""
    told = None
    for s in reversed(range(len(vertices))):
        above = entry.filter(lambda e, s=s: e[1][0] == s).map(lambda e: ((e[0], 0), e[1][1]))
        told = above if told is None else above.union(told)
        heard = vertices[s].rdd.map(lambda r: ((r["tree"], r["block"]), r)).join(told, tasks).values()
        told = heard if s == 0 else heard.flatMap(_tell)
    return told


# --- the manifest ----------------------------------------------------------------------------------

def manifest(docs: DataFrame, claimed: dict[str, Column] | None = None, where: Column | None = None, tree_col: str = "lang", id_col: str = "doc_id", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A verifier folds a document's leaf with its stored siblings.  Where ``where`` holds, the
    document it has before it differs in the fields of ``claimed``, so its leaf is made anew.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    claim = F.lit(None).cast("binary")
    if claimed:
        claim = F.when(F.lit(True) if where is None else where, leaf_digest([claimed.get(f, F.col(f)) for f in fields]))
    leaves = docs.select(F.col(id_col).cast("long").alias("id"), F.col(tree_col).cast("string").alias("name"), leaf_digest([F.col(f) for f in fields]).alias("leaf"), claim.alias("claim"))
    # equal rows are told apart by where they stand, so that a large group of them can be split
    leaves = scratch.stored(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    placed = numbered(leaves, [F.asc_nulls_first("name"), F.asc_nulls_first("id"), F.col("leaf"), F.col("row")], "place", scratch, "placed")
    trees = scratch.stored(placed.groupBy("name").agg(F.min("place").alias("first"), F.count("*").alias("nodes")), "trees")
    ordered = numbered(trees, [F.asc_nulls_first("name")], "tree", scratch, "ordered")
    size = trees.agg(F.count("*").alias("n"), F.max("nodes").alias("most")).first()
    if not size["n"]:
        return spark.createDataFrame([], RESULT)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mine = placed.join(ordered.select(F.col("name").alias("own"), "first", "nodes", "tree"), F.col("name").eqNullSafe(F.col("own")))
    low = climb(spark, mine.select("tree", "nodes", F.col("place") - F.col("first"), "leaf", "id", "claim").rdd.map(tuple), size["most"], tasks, scratch)
    above = tops(low)
    high = climb(spark, above.map(lambda t: (0, size["n"], t[0], t[1][1], None, None)), size["n"], tasks, scratch)
    scratch.drop(*low, *high)
    root = tops(high).first()[1][1]
    path = descend(high, spark.sparkContext.parallelize([(0, (len(high) - 1, (b"", root)))], 1), tasks).flatMap(_tell)
    entry = above.join(path.map(lambda t: (t[0][1], t[1][0])), tasks).mapValues(lambda v: (v[0][0], (v[1], v[0][1])))

    def proofs(heard: tuple) -> Iterator[tuple]:
        vertex, (_, subroot) = heard
        ids, claims = vertex["ids"], vertex["claims"]
        for i, (leaf, (_, (way, _))) in enumerate(zip(_digests(vertex), _tell(heard), strict=True)):
            folded = fold(bytes(claims[i]) if claims and claims[i] is not None else leaf, way)
            yield ids[i] if ids else None, leaf.hex(), subroot.hex(), root.hex(), proof_digest(way), folded.hex(), folded == root

    return spark.createDataFrame(descend(low, entry, tasks).flatMap(proofs), RESULT, verifySchema=False)
