"""Entities in texts, and the graph of entities that occur together."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce
from hashlib import blake2b
from itertools import combinations
from math import ceil, comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import checkpointed, discard
from .graph import roots

# Kinds of entities and their patterns, in the order in which they are tried.
PATTERNS = [
    ("person", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"),
    ("person", r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b"),
    ("organization", r"\b[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\s+(?:Inc|Corp|LLC|Ltd|Company|Co)\b"),
    ("organization", r"\b(?:The\s+)?[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\s+(?:University|Institute|College|Foundation)\b"),
    ("location", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,\s+[A-Z]{2}\b"),
    ("location", r"\b(?:New|Old|North|South|East|West)\s+[A-Z][a-z]+\b"),
    ("date", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"),
    ("date", r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b"),
    ("number", r"\b\d+(?:,\d{3})*(?:\.\d+)?\b"),
    ("number", r"\$\d+(?:,\d{3})*(?:\.\d{2})?\b"),
    ("acronym", r"\b[A-Z]{2,}\b"),
]
CONFIDENCE = 0.7
SAME_FROM = 0.85


def mentions(docs: DataFrame, key: str = "doc_id", text: str = "text", kinds: list[str] | None = None) -> DataFrame:
    """key, pattern_no, match_no, entity, entity_type of every match; letters, digits and
    blanks of any script count as such at word bounds.  Every text is read once."""
    wanted = [(no, kind, "(?U)" + pattern) for no, (kind, pattern) in enumerate(PATTERNS) if not kinds or kind in kinds]

    def found(no: int, kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m, i: F.struct(
            F.lit(no).alias("pattern_no"), i.alias("match_no"), F.regexp_replace(m, r"(?U)^\s+|\s+$", "").alias("entity"), F.lit(kind).alias("entity_type")))

    return docs.select(key, F.inline(F.concat(*(found(*w) for w in wanted))))


def entities(docs: DataFrame, key: str = "doc_id", text: str = "text", kinds: list[str] | None = None) -> DataFrame:
    """Distinct entities of every text (by lower case and type, first form kept), with a confidence."""
    found = mentions(docs, key, text, kinds).withColumn("name", F.lower("entity"))
    first = F.min(F.struct("pattern_no", "match_no", "entity"))
    return found.groupBy(key, "name", "entity_type").agg(first.alias("f")).select(key, "name", "entity_type", F.col("f.entity").alias("entity"), F.lit(CONFIDENCE).alias("confidence"))


def merged(regex: DataFrame, model: DataFrame, key: str = "doc_id") -> DataFrame:
    """Entities of both extractions; of one (name, type) the more confident, regex first on a tie."""
    both = regex.withColumn("__o", F.lit(0)).unionByName(model.withColumn("__o", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key, "name", "entity_type").orderBy(F.desc("confidence"), "__o")
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__o")


def occurrence_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("name", "entity_type").agg(F.count("*").alias("n"))


def pair_counts(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """src, dst, weight: names that occur in one text, each unordered pair once a text.
    A text gives the pairs of its own distinct names only, made inside its row."""
    names = found.groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("names")).where(F.size("names") > 1)
    left = names.select(F.posexplode("names").alias("i", "src"), "names")
    pairs = left.select("src", F.explode(F.slice("names", F.col("i") + 2, F.size("names"))).alias("dst"))
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def similarity(a: str, b: str) -> float:
    """Ratcliff/Obershelp ratio."""
    return SequenceMatcher(None, a, b).ratio()


def _letters(names: list[str]) -> np.ndarray:
    """How often each of 64 character classes occurs in every name."""
    out = np.zeros((len(names), 64), np.int16)
    for i, name in enumerate(names):
        np.add.at(out[i], np.frombuffer(name.encode("utf-32-le"), np.uint32) % 64, 1)
    return out


#: Ratios from which on matches are looked for, one after the other: names that have one go on no more.
BANDS = (0.94, 0.89)
#: Places of the counts that tell frequent pairs of characters from rare ones.
SLOTS = 1 << 16


def shared_pairs(n: int, m: int, ratio: float) -> int | None:
    """How many pairs of neighbouring characters two different names of n and m characters have
    in common at least if their ratio is ``ratio`` or more; None if it cannot be.

    With u unmatched characters in both, (n + m - u) / 2 are matched, in u + 1 blocks at most,
    and a block of k characters holds k - 1 pairs.
    """
    total = n + m
    most = int((1 - ratio) * total + 1e-9)
    most -= (most - total) % 2
    if most < max(1, abs(n - m)):
        return None
    if (shared := (total - most) // 2 - most - 1) < 1:
        raise ValueError(f"names as little alike as {ratio} need not share a pair of characters")
    return shared


def prefix_size(n: int, ratio: float) -> int:
    """So many of a name's rarest pairs hold one at least that it shares with any name as similar as ``ratio``."""
    least = [x for m in range(int(n * ratio / 2), int(n * 2 / ratio) + 2) if (x := shared_pairs(n, m, ratio)) is not None]
    return n - 1 - min(least) + 1 if least else 0


def _pairs_of(name: str) -> list[tuple[str, int]]:
    """Pairs of neighbouring characters, each with how often it has come before."""
    seen: dict[str, int] = {}
    out = []
    for i in range(len(name) - 1):
        pair = name[i:i + 2]
        out.append((pair, seen.get(pair, 0)))
        seen[pair] = seen.get(pair, 0) + 1
    return out


def _hashed(pair: tuple[str, int]) -> int:
    return int.from_bytes(blake2b(f"{pair[1]} {pair[0]}".encode("utf-32-le"), digest_size=8).digest(), "little", signed=True)


def _signatures(names: DataFrame, ratio: float, counts: np.ndarray) -> DataFrame:
    """entity_type, name, seq, n, tokens: the rarest pairs of every name, in one order for all."""

    def run(frames):
        for f in frames:
            tokens = []
            for name in f["name"]:
                own = sorted((int(counts[h % SLOTS]), h) for h in map(_hashed, _pairs_of(name)))
                tokens.append([h for _, h in own[:prefix_size(len(name), ratio)]])
            yield f.assign(n=f["name"].str.len(), tokens=tokens)

    return names.select("entity_type", "name", "seq").mapInPandas(run, "entity_type string, name string, seq long, n int, tokens array<long>").where("size(tokens) > 0")


def _pair_counts(names: DataFrame) -> np.ndarray:
    """How often pairs of characters occur in all names, by slots of their hashes."""

    def run(frames):
        total = np.zeros(SLOTS, np.int64)
        for f in frames:
            for name in f["name"]:
                for pair in _pairs_of(name):
                    total[_hashed(pair) % SLOTS] += 1
        some = np.flatnonzero(total)
        yield pd.DataFrame({"slot": some, "c": total[some]})

    counted = names.select("name").mapInPandas(run, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()  # SLOTS rows at most
    out = np.zeros(SLOTS, np.int64)
    out[counted.column("slot").to_numpy()] = counted.column("c").to_numpy()
    return out


def _compared(frames):
    """Pairs (name, earlier) to those as similar as their ``least``, the best of each name in a batch."""
    for f in frames:
        if len(f):
            a, b = f["name"].tolist(), f["earlier"].tolist()
            x, y = _letters(a), _letters(b)
            reach = 2 * np.minimum(x, y).sum(1) / np.maximum(x.sum(1) + y.sum(1), 1)  # no ratio is larger
            f = f[reach >= f["least"] - 1e-9]
            f = f.assign(less=[-similarity(a, b) for a, b in zip(f["name"], f["earlier"], strict=True)])
            f = f[f["less"] <= -f["least"]].sort_values(["less", "at", "earlier"]).drop_duplicates(["entity_type", "name"])
            yield f[["entity_type", "name", "earlier", "at", "less"]]


_FOUND = "entity_type string, name string, earlier string, at long, less double"


def _best(pairs: DataFrame) -> DataFrame:
    found = pairs.mapInPandas(_compared, _FOUND)
    return found.groupBy("entity_type", "name").agg(F.min(F.struct("less", "at", "earlier"))["earlier"].alias("earlier"))


#: Names that have a match as near as so many changed characters, one after the other, are looked for by what is left when characters are taken out.
CHANGED = (1, 2)
#: So many rests of one name at most; names with more are looked for by pairs of characters.
RESTS = 256


def near_lengths(lengths: list[int], changed: int, same_from: float) -> dict[int, dict[int, tuple[int, int]]]:
    """For a name of n characters that has no match as near as ``changed - 1`` changed characters:
    the lengths m of names that can be as near as ``changed``, each with the least and the most
    characters that such a match holds."""
    out: dict[int, dict[int, tuple[int, int]]] = {}
    for n in lengths:
        out[n] = {}
        for m in lengths if n > changed else []:
            most = min(((n - changed + 1) * (n + m) - 1) // (2 * n), n, m)
            least = max(-((changed - n) * (n + m) // (2 * n)), 1)
            while least <= most and 2.0 * least / (n + m) < same_from:
                least += 1
            if least <= most:
                out[n][m] = (least, most)
    return out


def _rests(names: DataFrame, wanted: dict[int, list[tuple[int, int, float, float]]]) -> DataFrame:
    """entity_type, name, seq, key, least, bound: a row for every text of some characters of a name in
    their order.  ``wanted``: by a name's length, for every length it may meet: how many characters
    are kept, what tells the two lengths apart in the key, the least and the largest ratio."""

    def run(frames):
        for f in frames:
            rows = []
            for kind, name, seq in zip(f["entity_type"], f["name"], f["seq"], strict=True):
                kept: dict[int, list[str]] = {}
                for size, lengths, least, bound in wanted.get(len(name), ()):
                    if size not in kept:
                        kept[size] = list({"".join(c) for c in combinations(name, size)})
                    rows.append((kind, name, seq, lengths, least, bound, kept[size]))
            yield pd.DataFrame(rows, columns=["entity_type", "name", "seq", "lengths", "least", "bound", "rests"])

    made = names.select("entity_type", "name", "seq").mapInPandas(run, "entity_type string, name string, seq long, lengths long, least double, bound double, rests array<string>")
    return made.select("entity_type", "name", "seq", "least", "bound", "lengths", F.explode("rests").alias("rest")).withColumn("key", F.xxhash64("rest", "lengths")).drop("rest", "lengths")


def _nearest(names: DataFrame, asked: DataFrame, near: dict[int, dict[int, tuple[int, int]]]) -> DataFrame:
    """entity_type, name, earlier: the most similar earlier name of those of ``asked`` that have one within ``near``.

    Names with so many characters matched have a text of so many characters in common.  The
    earliest name of each such text and pair of lengths is enough if its ratio is the largest there
    can be; only where it is not, the name is compared with all that it has a text in common with.
    """
    new, old = {}, {}
    for n, lengths in near.items():
        for m, (least, most) in lengths.items():
            new.setdefault(n, []).append((least, n << 32 | m, 2.0 * least / (n + m), 2.0 * most / (n + m)))
            old.setdefault(m, []).append((least, n << 32 | m, 0.0, 0.0))
    old = _rests(names, old).select("entity_type", "key", F.struct(F.col("seq").alias("at"), F.col("name").alias("earlier")).alias("old"))
    before = F.col("old") < F.struct(F.col("seq").alias("at"), F.col("name").alias("earlier"))
    first = _rests(asked, new).join(old.groupBy("entity_type", "key").agg(F.min("old").alias("old")), ["entity_type", "key"]).where(before)
    first = first.groupBy("entity_type", "name").agg(F.min(F.struct((-F.col("bound")).alias("less"), "old")).alias("b"), F.min("seq").alias("seq"))

    def run(frames):
        for f in frames:
            yield f.assign(sure=[-similarity(a, b) <= less for a, b, less in zip(f["name"], f["earlier"], f["less"], strict=True)])

    tried = first.select("entity_type", "name", "seq", "b.old.earlier", "b.less").mapInPandas(run, "entity_type string, name string, seq long, earlier string, less double, sure boolean")
    tried = checkpointed(tried, "tried")
    pairs = _rests(tried.where("not sure"), new).join(old, ["entity_type", "key"]).where(before).select("entity_type", "name", "old.earlier", "old.at", "least").distinct()
    found = checkpointed(tried.where("sure").select("entity_type", "name", "earlier").unionByName(_best(pairs)), "similar")
    discard(tried)
    return found


def most_similar(names: DataFrame, same_from: float = SAME_FROM) -> DataFrame:
    """entity_type, name, earlier: for every name (entity_type, name, seq; each name once) the most
    similar one before it in its type, from ``same_from`` on, the earlier of equals.

    Names of nearly the same characters are looked for first (see ``_nearest``), where that
    takes few rests of a name.  All others can only be as similar if they share one of their rarest
    pairs of characters, so they meet by an equi-join on those.  Close matches are looked for
    first here too, where few pairs have to be shared; only names without one are looked up
    again at the next ratio.
    """
    first = names.groupBy("entity_type").agg(F.min(F.struct("seq", "name"))["name"].alias("name"))
    open_, found = checkpointed(names.join(first, ["entity_type", "name"], "left_anti"), "open"), []
    lengths = sorted(r.n for r in names.select(F.length("name").alias("n")).distinct().collect())  # no more than the longest has characters
    skipped: set[int] = set()
    for changed in CHANGED:
        near = near_lengths(lengths, changed, same_from)
        skipped |= {n for n, x in near.items() if n <= changed or any(max(comb(n, least), comb(m, least)) > RESTS for m, (least, _) in x.items())}
        near = {n: x for n, x in near.items() if x and n not in skipped}
        if near and not (asked := open_.where(F.length("name").isin(list(near)))).isEmpty():
            found.append(_nearest(names, asked, near))
        # names are done that have a match, and those that nothing less near can be similar enough to
        fails = [n for n in lengths if n not in skipped and all(ceil(same_from * (n + m) / 2 - 1e-6) > min(((n - changed) * (n + m) - 1) // (2 * n), n, m) for m in lengths)]
        rest = open_.where(~F.length("name").isin(fails))
        old, open_ = open_, checkpointed(rest.join(found[-1], ["entity_type", "name"], "left_anti") if found else rest, "open")
        discard(old)
    if open_.isEmpty():
        return reduce(DataFrame.unionByName, found) if found else open_.select("entity_type", "name", F.col("name").alias("earlier"))
    counts = _pair_counts(names)
    for ratio in [*(r for r in BANDS if r > same_from), same_from]:
        every = checkpointed(_signatures(names, ratio, counts), "signatures")
        asked = every.join(open_.select("entity_type", "name"), ["entity_type", "name"], "left_semi")
        old = every.select("entity_type", F.col("name").alias("earlier"), F.col("seq").alias("at"), F.col("n").alias("m"), F.col("tokens").alias("theirs"), F.explode("tokens").alias("token"))
        new = asked.withColumn("token", F.explode("tokens"))
        fits = (2 * F.least("n", "m") >= ratio * (F.col("n") + F.col("m")) - 1e-9) & (F.struct("at", "earlier") < F.struct("seq", "name"))
        once = F.get(F.array_intersect("tokens", "theirs"), F.lit(0)) == F.col("token")  # a pair meets at its first common token alone
        pairs = new.join(old, ["entity_type", "token"]).where(fits & once).select("entity_type", "name", "earlier", "at", F.lit(ratio).alias("least"))
        found.append(checkpointed(_best(pairs), "similar"))
        discard(every)
        open_ = open_.join(found[-1], ["entity_type", "name"], "left_anti")
    return reduce(DataFrame.unionByName, found)


def canonical(names: DataFrame, same_from: float = SAME_FROM) -> DataFrame:
    """name, entity_type, seq -> canonical: in order of seq inside a type, a name (in lower case)
    has the canonical name of the most similar one before it, from ``same_from`` on, else its own.

    The most similar earlier name of each is found by itself (``most_similar``); the canonical
    name is the root of the chain of such names, found by pointer doubling.
    """
    low = F.lower("name")
    state = checkpointed(names.groupBy("entity_type", low.alias("name")).agg(F.min(F.col("seq").cast("long")).alias("seq")).where("name is not null"), "names")
    links = most_similar(state, same_from).select(F.struct("entity_type", "name").alias("node"), F.struct("entity_type", F.col("earlier").alias("name")).alias("to"))
    root = roots(links).select("node.entity_type", F.col("node.name").alias("low"), F.col("root.name").alias("canonical"))
    every = names.select("name", "entity_type", F.col("seq").cast("long").alias("seq"), low.alias("low"))
    return every.join(root, ["entity_type", "low"], "left").select("name", "entity_type", "seq", F.coalesce("canonical", "low").alias("canonical"))


def clusters(canon: DataFrame) -> DataFrame:
    return canon.groupBy("canonical", "entity_type").agg(F.array_sort(F.collect_set("name")).alias("members"))
