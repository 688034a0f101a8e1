"""Queries of the llm operators, each over its whole intended table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adaptive_scan, jaccard_join, language_mixture, merkle, packing, pu_quality, quality_rules, ranked_search, secrets, suffix_dedup, unigram, url_filter
from .common import read_table


def op1_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_scan.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"), url_filter.RULES)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns and the text that is left."""
    # rows of a batch read from Parquet: 4,096 texts (Spark's default) are large arrays on the heap
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")
    cut = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), with_text=True)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept").alias("text"))


def op4_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_by_cost(read_table(spark, sf_dir, "documents"))


def op5_packed_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id matrix by digests of its rows; packing.write_packed writes the matrix."""
    packed = packing.packed_matrices(read_table(spark, sf_dir, "documents"))
    return packed.select("sequence_id", "n_tokens", F.expr("int(size(doc_ids))").alias("n_segments"), "cu_seqlens", F.crc32("ids").alias("ids_crc32"), F.crc32("position_ids").alias("position_ids_crc32"), "doc_ids", "starts")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts and limits of op6 alone, which SQL can say."""
    return quality_rules.base_counts(read_table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode_texts(read_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def _crc32_of_id() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = _crc32_of_id() % 4 == 2
    names, logs = language_mixture.learn(docs.where(~held_out))
    return language_mixture.identify(docs, names, logs, held_out=held_out)


def op11_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), _crc32_of_id() % 4 == 2)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides the id's crc32 the verifier has a document of one more character in n_chars."""
    return merkle.manifest(read_table(spark, sf_dir, "documents"), {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}, _crc32_of_id() % 7 == 0)


def op13_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_adaptive_scan": op1_adaptive_scan,
        "op2_url_filter": op2_url_filter,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_cost_packing": op4_cost_packing,
        "op5_packed_matrices": op5_packed_matrices,
        "op6_quality_rules": op6_quality_rules,
        "quality_counts": quality_counts,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_unigram_pieces": op8_unigram_pieces,
        "op9_secret_scan": op9_secret_scan,
        "op10_language_mixture": op10_language_mixture,
        "op11_pu_quality": op11_pu_quality,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_threshold_search": op13_threshold_search,
    }


# --- SQL: what op2 returns, step by step ------------------------------------------------------

def _attribute(name: str) -> str:
    pattern = r"""(?is)(?:^|[\s\"''/])""" + name + r"""\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
    value = " || ".join(f"regexp_extract(tag, '{pattern}', {i})" for i in (1, 2, 3))
    for entity, sign in url_filter.ENTITIES:
        value = f"replace({value}, '{entity}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return value


def _address(name: str, source: str, url: str, keep: str) -> str:
    """Tables that add host, path and plain (the path without dot segments) to ``source``."""
    return f"""{name}_r AS (SELECT {keep}, CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END AS rest FROM {source}),
{name}_p AS (SELECT {keep}, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\\?[^#]*)?', 1) AS query FROM {name}_r),
{name}_l AS (SELECT *, string_split(path, '/')[2:] AS parts FROM {name}_p),
{name} AS (SELECT * EXCLUDE (parts), CASE WHEN path = '' THEN '/' WHEN NOT regexp_matches(path, '/\\.\\.?(/|$)') THEN path ELSE '/' || array_to_string(
  list_reduce(list_prepend([]::VARCHAR[], list_transform(parts, lambda s: [s])), lambda a, x: CASE x[1] WHEN '.' THEN a WHEN '..' THEN a[1:len(a) - 1] ELSE list_concat(a, x) END) || CASE WHEN parts[-1] IN ('.', '..') THEN [''] ELSE []::VARCHAR[] END, '/') END AS plain FROM {name}_l)"""


def _rule(host: str, path: str) -> str:
    cases = (f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN '{r}'" for r in sorted(url_filter.RULES, key=lambda r: -len(str(r))))
    return "CASE " + " ".join(cases) + " END"


_BLOCKS = ", ".join(f"'{r}'" for r in url_filter.RULES if not r.allow)

OP2 = f"""WITH RECURSIVE {_address("own", "pages", "url", "page_id, url, html")},
tags AS (SELECT url, host, path, plain, query, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM own WHERE host <> ''),
attributes AS (SELECT * EXCLUDE (tag), {_attribute("rel")} AS rel, {_attribute("href")} AS href, {_attribute("http-equiv")} AS equiv, {_attribute("content")} AS content FROM tags),
named AS (SELECT *, trim(CASE WHEN regexp_matches(lower(rel), '(^|\\s)canonical(\\s|$)') THEN href WHEN lower(trim(equiv)) = 'refresh' THEN regexp_extract(content, '(?i)url\\s*=\\s*["'']?([^"'';]+)', 1) END) AS target, regexp_extract(url, '^([^:/?#]*):', 1) AS scheme, CASE WHEN path = '' THEN '/' ELSE path END AS base FROM attributes),
seen AS (SELECT host AS a_host, path AS a_path, host || plain || query AS a, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') OR target[1] = '#' THEN NULL WHEN target[1:2] = '//' THEN scheme || ':' || target
  WHEN target[1] = '/' THEN scheme || '://' || host || target WHEN target[1] = '?' THEN scheme || '://' || host || base || target ELSE scheme || '://' || host || regexp_replace(base, '[^/]*$', '') || target END AS url FROM named WHERE target <> ''),
{_address("aim", "seen", "url", "a, a_host, a_path")},
links AS (SELECT DISTINCT a, a_host, a_path, host || plain || query AS b, host AS b_host, CASE WHEN path = '' THEN '' ELSE plain END AS b_path FROM aim WHERE host <> ''),
ends AS (SELECT a AS node, a_host AS host, a_path AS path FROM links UNION SELECT b, b_host, b_path FROM links),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
hit(node) AS (SELECT node FROM ends WHERE {_rule("host", "path")} IN ({_BLOCKS}) UNION SELECT ways.b FROM hit JOIN ways ON hit.node = ways.a),
judged AS (SELECT page_id, host, path, {_rule("host", "path")} AS rule, CASE WHEN host <> '' THEN host || plain || query END AS address FROM own)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({_BLOCKS}) OR (rule IS NULL AND hit.node IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict, rule IS NULL AND hit.node IS NOT NULL AS by_alias FROM judged LEFT JOIN hit ON address = hit.node"""


# --- SQL: what op9 returns; a pattern's places are sums of lengths, parts meet by a plain interval join ---

def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _found(order: int, pattern: str, lead: int | None, part: int, least: int, also: str = "true") -> str:
    """Matches of one kind; ``lead`` is a group that comes before the match proper."""
    p = _quoted(pattern)
    before = f"regexp_extract_all(t, '{p}', {lead})" if lead else "NULL::VARCHAR[]"
    return f"""SELECT rid, {order} AS o, s, e FROM (SELECT rid, list_sum(list_transform(b[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) + coalesce(length(l[i]), 0) AS s,
 list_sum(list_transform(b[:i], lambda x: length(x))) + list_sum(list_transform(m[:i], lambda x: length(x))) AS e, g[i] AS g, m[i] AS m FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM
 (SELECT rid, regexp_extract_all(t, '{p}', 0) AS m, {before} AS l, regexp_extract_all(t, '{p}', {part}) AS g, regexp_split_to_array(t, '{p}') AS b FROM d WHERE regexp_matches(t, '{p}')))) WHERE length(g) >= {least} AND {also}"""


# SQL's patterns can't look around: a bare key is a whole run of key characters, and a user's name takes the character before it along.
_KEY = r"[A-Za-z0-9+/=_-]{40,}"
_USER = r"(^|[^A-Za-z0-9_])(" + secrets.WEAK["user"][0].removeprefix("(?<![A-Za-z0-9_])") + ")"
_FITS = " OR ".join(f"(w.o = {secrets.KINDS.index(k)} AND p.o IN ({', '.join(str(secrets.KINDS.index(x)) for x in others)}))" for k, others in secrets.COMPLEMENT.items())
_NAMES = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
_LIST = f"string_agg({_NAMES}[o + 1] || ':' || s || ':' || e, ',' ORDER BY s, o, e)"
OP9 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
parts AS ({" UNION ALL ".join([
    *(_found(i, *spec[:1], None, *spec[1:]) for i, spec in enumerate(secrets.BASE.values())),
    _found(3, _KEY, None, 0, 40, "length(m) = 40 AND regexp_full_match(m, '[A-Za-z0-9+/]+') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')"),
    _found(4, _USER, 1, 2, 6),
    _found(5, *secrets.WEAK["endpoint"][:1], None, *secrets.WEAK["endpoint"][1:]),
])}),
linked AS (SELECT w.* FROM parts w WHERE w.o > 2 AND EXISTS (SELECT 1 FROM parts p WHERE p.rid = w.rid AND p.s <= w.e + {secrets.SCOPE} AND p.e >= w.s - {secrets.SCOPE} AND ({_FITS}))),
base AS (SELECT rid, count(*) FILTER (o = 0) AS a, count(*) FILTER (o = 1) AS k, count(*) FILTER (o = 2) AS h, {_LIST} AS l FROM parts WHERE o < 3 GROUP BY rid),
every AS (SELECT rid, count(*) FILTER (o > 2) AS n, {_LIST} AS l FROM (SELECT * FROM parts WHERE o < 3 UNION ALL SELECT * FROM linked) GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base.l, '')) AS base_sha256, coalesce(every.l, '') AS spans, coalesce(n, 0) AS n_linked FROM d LEFT JOIN base USING (rid) LEFT JOIN every USING (rid)"""


COUNTS = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(l) AS w, unnest(generate_series(1, len(l))) AS i FROM (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS l FROM d)),
windows AS (SELECT rid, i, w, lead(w) OVER p AS b, lead(w, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w, b, c) AS n FROM windows WHERE c IS NOT NULL) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(0, 3) r(k) GROUP BY rid),
lines AS (SELECT rid, sum(n - 1)::BIGINT AS n FROM (SELECT rid, line, count(*) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line) GROUP BY rid),
words AS (SELECT rid, count(*) AS n, sum(length(w))::BIGINT AS c FROM w GROUP BY rid),
found AS (SELECT doc_id, coalesce(words.n, 0) AS n_words, coalesce(words.c, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN words USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM found"""


# --- SQL: what op12 returns; levels of all trees by recursion, ids' crc32 bit by bit -----------

def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


_CRC32 = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, c: list_reduce(list_prepend(xor(a, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""
OP12 = f"""WITH RECURSIVE d AS (SELECT doc_id, lang, sha256({_field("doc_id")} || {_field("source")} || {_field("lang")} || {_field("n_chars")} || {_field("text")}) AS leaf,
  CASE WHEN doc_id IS NOT NULL AND xor({_CRC32}, 4294967295) % 7 = 0 THEN sha256({_field("doc_id")} || {_field("source")} || {_field("lang")} || {_field("(n_chars + 1)")} || {_field("text")}) END AS claim FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t FROM d),
low(t, level, i, n, h) AS (SELECT t, 0, i, n, leaf FROM leaves UNION ALL SELECT t, any_value(level) + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY t, i // 2),
roots AS (SELECT t AS i, h, level AS height, count(*) OVER () AS n FROM low WHERE n = 1),
high(level, i, n, h) AS (SELECT 0, i, n, h FROM roots UNION ALL SELECT any_value(level) + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY i // 2),
step AS (SELECT l.t, l.i, s.level AS k, l.i // (1 << s.level) % 2 AS side, o.h FROM leaves l JOIN roots r ON r.i = l.t JOIN (SELECT DISTINCT level FROM low) s ON s.level < r.height LEFT JOIN low o ON o.t = l.t AND o.level = s.level AND o.i = xor(l.i // (1 << s.level), 1)
  UNION ALL SELECT l.t, l.i, 100 + s.level, l.t // (1 << s.level) % 2, o.h FROM leaves l JOIN (SELECT DISTINCT level FROM high WHERE n > 1) s ON true LEFT JOIN high o ON o.level = s.level AND o.i = xor(l.t // (1 << s.level), 1)),
way AS (SELECT t, i, list({{'side': side, 'h': h}} ORDER BY k) AS steps, coalesce(string_agg(h, '' ORDER BY k), '') AS proof FROM step GROUP BY t, i)
SELECT doc_id, leaf, roots.h AS subroot, top.h AS root, sha256(coalesce(proof, '')) AS proof_sha256,
  list_reduce(list_prepend({{'side': 0::BIGINT, 'h': coalesce(claim, leaf)}}, coalesce(steps, [])), lambda a, s: {{'side': 0::BIGINT, 'h': CASE WHEN s.h IS NULL THEN sha256(a.h) WHEN s.side = 1 THEN sha256(s.h || a.h) ELSE sha256(a.h || s.h) END}}).h AS folded_root,
  folded_root = top.h AS verified FROM leaves JOIN roots ON roots.i = leaves.t LEFT JOIN way ON way.t = leaves.t AND way.i = leaves.i, (SELECT h FROM high WHERE n = 1) top"""


# --- SQL: what op13 returns, from the scores of all documents ------------------------------------

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13 = f"""WITH w AS (SELECT rid, doc_id, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS rid, * FROM documents)),
size AS (SELECT rid, any_value(doc_id) AS doc_id, count(*) AS n FROM w GROUP BY rid),
total AS (SELECT count(*) AS n, sum(n)::BIGINT AS l FROM size),
asked AS (SELECT q, item_id, term, count(*) AS c FROM (SELECT q, item_id, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS q, * FROM benchmark)) GROUP BY ALL),
tf AS (SELECT rid, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM asked) GROUP BY rid, term),
weight AS (SELECT term, floor(1000 * ln((2 * total.n + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
impact AS (SELECT rid, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * size.n * total.n) // total.l)) AS i FROM tf JOIN size USING (rid), total),
scored AS (SELECT q, item_id, rid, sum(c * w * i)::BIGINT AS score FROM asked JOIN weight USING (term) JOIN impact USING (term) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score FROM scored JOIN size USING (rid) WHERE score > 0 QUALIFY rank <= 20"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2, "op9_secret_scan": OP9, "op12_merkle_manifest": OP12, "op13_threshold_search": OP13, "quality_counts": COUNTS}
