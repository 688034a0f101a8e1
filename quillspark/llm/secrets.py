"""Secret scans: base patterns, and weak candidates that count only beside their
complement.  DataFrame functions only.

Base spans are assignments of secrets, access identifiers and long hex runs.  Weak
candidates are parts that alone mean little: bare 40-character keys (``key``), user
or client names (``user``) and service endpoints (``endpoint``).  All parts of a
text are joined by interval: a bare key is reported if an identifier or endpoint lies
within ``SCOPE`` characters, a user or endpoint if a secret does.

Places are code points, ends exclusive.  Defined cases: a null text is empty and has
no spans; texts of any length are read whole; rows of one id are told apart by their
text, equal rows get equal results; a null id is an id of its own; an empty table gives
an empty result; other columns are passed by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, stored, text_key

#: Characters between two parts that belong together, at most.
SCOPE = 300
#: Elements that running totals are summed by, so that long lists stay cheap.
_CHUNK = 256

#: Kinds in the order in which spans of one start are listed, with
#: their pattern, the group that must be long enough (0: all) and its least length.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Weak parts of a credential.
WEAK = {
    "key": (r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", 0, 40),
    "user": (r"""(?<![A-Za-z0-9_])(?i:user(?:name)?|login|client_?id|account(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", 0, 6),
    "endpoint": (r"""(?:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9.-]+(?::[0-9]+)?""", 0, 8),
}
KINDS = [*BASE, *WEAK]
#: Which parts make a weak one count.
COMPLEMENT = {"key": ["access", "user", "endpoint"], "user": ["assign", "hex", "key"], "endpoint": ["assign", "access", "hex", "key"]}
#: What a text must hold for its costly pattern to be tried; every match of the pattern holds it.
_HINT = {"assign": r"(?i:passw|secret|token|api_?key)", "access": "AKIA", "key": r"[A-Za-z0-9+/]{40}", "user": r"(?i:user|login|client_?id|account)", "endpoint": "://"}


def totals_before(x: Column) -> Column:
    """For each element of an integer array, the sum of all before it."""
    def run(a: Column, first: Column) -> Column:
        return F.slice(F.aggregate(a, F.array(first), lambda out, y: F.array_append(out, F.element_at(out, -1) + y)), F.lit(1), F.size(a))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _CHUNK).cast("int")), lambda i: F.slice(x, i * _CHUNK + 1, F.lit(_CHUNK)))
    sums = F.transform(chunks, lambda a: F.aggregate(a, F.lit(0), lambda s, y: s + y))
    return F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(F.flatten(F.zip_with(chunks, run(sums, F.lit(0)), lambda a, s: run(a, s))))


def spans_of(text: Column, pattern: str, group: int, least: int, hint: str | None = None) -> Column:
    """array<struct<s,e>> of leftmost matches that don't overlap; short ones are dropped.

    Regex functions give no places, so lengths of what lies between matches (split)
    and of the matches are summed.
    """
    empty = F.array().cast("array<struct<s:int,e:int>>")
    between, whole, part = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gap, size = F.transform(F.slice(between, F.lit(1), F.size(whole)), F.length), F.transform(whole, F.length)
    before = totals_before(F.zip_with(gap, size, lambda a, b: a + b))
    rows = F.zip_with(F.arrays_zip(before.alias("b"), gap.alias("g")), F.arrays_zip(size.alias("n"), F.transform(part, F.length).alias("p")), lambda x, y: F.struct((x["b"] + x["g"]).alias("s"), (x["b"] + x["g"] + y["n"]).alias("e"), y["p"].alias("p")))
    good = F.transform(F.filter(rows, lambda r: r["p"] >= least), lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e")))
    found = text.rlike(pattern) if hint is None else F.when(text.rlike(hint), text.rlike(pattern)).otherwise(F.lit(False))
    return F.when(found, good).otherwise(empty)


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (text hash) and an array of spans for every kind, base or weak."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("th"), *(spans_of(text, *spec, _HINT.get(k)).alias(k) for k, spec in (BASE | WEAK).items()))


def _tag(spans: Column, value: Column, name: str) -> Column:
    return F.transform(spans, lambda x: F.struct(value.alias(name), x["s"].alias("s"), x["e"].alias("e")))


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, th, kind, s, e of weak parts with a complement within ``scope``.

    Parts are laid out by (text, block of the text); a weak part looks into the
    blocks that its reach touches, so the join is an equi-join however long a text is.
    """
    some = parts.where(F.greatest(*(F.size(k) for k in WEAK)) > 0).where(F.aggregate(F.array(*(F.size(k) for k in KINDS)), F.lit(0), lambda n, x: n + F.when(x > 0, 1).otherwise(0)) > 1)
    tagged = F.flatten(F.array(*(_tag(F.col(k), F.lit(k), "kind") for k in KINDS)))
    rows = some.select("doc_id", "th", F.explode(tagged).alias("p")).select("doc_id", "th", "p.*").distinct()
    block = lambda x: F.floor(x / scope)
    left = rows.where(F.col("kind").isin(*WEAK)).withColumn("block", F.explode(F.sequence(block(F.col("s") - scope), block(F.col("e") + scope))))
    right = rows.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), F.col("kind").alias("k"), F.col("s").alias("a"), F.col("e").alias("z"), F.explode(F.sequence(block(F.col("s")), block(F.col("e")))).alias("o"))
    fits = F.lit(False)
    for kind, others in COMPLEMENT.items():
        fits = fits | ((F.col("kind") == kind) & F.col("k").isin(others))
    near = (F.col("a") <= F.col("e") + scope) & (F.col("z") >= F.col("s") - scope)
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")) & (F.col("block") == F.col("o"))
    return left.join(right, same & near & fits, "left_semi").select("doc_id", "th", "kind", "s", "e").distinct()


def _ordered(kinds: dict[str, Column]) -> Column:
    """Spans of several kinds as one array<struct<s,o,e>>, by start, then kind as listed."""
    return F.array_sort(F.flatten(F.array(*(F.transform(_tag(c, F.lit(KINDS.index(k)), "o"), lambda x: F.struct(x["s"].alias("s"), x["o"].alias("o"), x["e"].alias("e"))) for k, c in kinds.items()))))


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["o"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _with_links(parts: DataFrame, scope: int) -> DataFrame:
    found = linked(parts, scope).groupBy(F.col("doc_id").alias("d"), F.col("th").alias("h")).agg(F.collect_set(F.struct("s", F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int").alias("o"), "e")).alias("more"))
    found = found.select("d", "h", F.transform("more", lambda x: F.struct(x["s"].alias("s"), (x["o"] - 1).alias("o"), x["e"].alias("e"))).alias("more"))
    out = parts.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left").drop("d", "h")
    base = _ordered({k: F.col(k) for k in BASE})
    return out.withColumn("base", base).withColumn("all", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    parts = stored(find_parts(docs, id_col, text_col), "parts")
    out = _with_links(parts, scope)
    return out.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("all")).alias("spans"), F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_linked"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every span in the text replaced by ``mask`` (overlapping spans by one)."""
    parts = stored(find_parts(docs, id_col, text_col), "parts")
    d, h, found, runs = free_names(docs, "found_id", "found_text", "found", "runs")
    spans = _with_links(parts, scope).where(F.size("all") > 0).select(F.col("doc_id").alias(d), F.col("th").alias(h), F.col("all").alias(found)).dropDuplicates([d, h])
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.join(spans, F.col(id_col).eqNullSafe(F.col(d)) & (text_key(text) == F.col(h)), "left")

    def union(out: Column, x: Column) -> Column:
        last, before = F.element_at(out, -1), F.slice(out, F.lit(1), F.size(out) - 1)
        span = lambda s, e: F.struct(s.alias("s"), e.alias("e"))
        return F.when((F.size(out) > 0) & (last["e"] >= x["s"]), F.array_append(before, span(last["s"], F.greatest(last["e"], x["e"])))).otherwise(F.array_append(out, span(x["s"], x["e"])))

    edges = F.concat(F.array(F.lit(0)), F.transform(runs, lambda x: x["e"]))
    stops = F.concat(F.transform(runs, lambda x: x["s"]), F.array(F.length(text_col)))
    pieces = F.zip_with(edges, stops, lambda a, b: F.substring(F.col(text_col), a + 1, b - a))
    masked = F.when(F.col(found).isNull(), F.col(text_col)).otherwise(F.array_join(pieces, mask))
    merged = F.aggregate(found, F.array().cast("array<struct<s:int,e:int>>"), union)
    return joined.withColumn(runs, F.when(F.col(found).isNotNull(), merged)).withColumn(text_col, masked).select(*docs.columns)
