"""Allow and block rules for URLs, with decisions that follow redirects and
canonical links.  DataFrame functions only.

A rule is a host and a path prefix; it fits the host and its subdomains, and the
longest fitting rule decides.  A page that no rule fits takes over a block from its
aliases: pages and their targets (``<link rel=canonical>``, ``<meta
http-equiv=refresh>``) are joined into components, and one blocked address blocks
the component.  A page's own rule always comes first, so an explicit allow is never
overruled by an alias.

Targets are resolved as RFC 3986 says: a bare query or fragment keeps the page's path,
dot segments go, and the five named entities of HTML are decoded first.  An address is
host, path without dot segments, and query.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no
rule, has no aliases and is allowed; null or empty html has no links, html of any length
is read whole; a target of another kind of address (``mailto:``) is none; repeated rows
get equal verdicts; other columns, whatever their names, are passed by; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @classmethod
    def of(cls, allow: bool, text: str) -> Rule:
        host, _, path = text.partition("/")
        return cls(host, "/" + path, allow)

    def __str__(self) -> str:
        return self.host + self.path


#: The rules that the registered query applies.
RULES = [
    Rule.of(True, "com/"),
    Rule.of(False, "example.com/en/"),
    Rule.of(True, "www.example.com/en/"),
    Rule.of(False, "net/es/"),
    Rule.of(False, "net/fr/"),
]


def without_dots(path: Column) -> Column:
    """A path that begins with a slash without its ``.`` and ``..`` segments."""
    parts = F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/")))
    up = lambda out: F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, x: F.when(x == ".", out).when(x == "..", up(out)).otherwise(F.array_append(out, x)))
    open_end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(F.concat(kept, open_end), "/"))).otherwise(path)


def with_address(df: DataFrame, url: str) -> DataFrame:
    """Adds host, path, and address: host, path without dot segments and query, which name
    a page whatever its scheme and fragment (null without a host).  One step builds on
    another's columns, so no expression is evaluated twice."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(F.col(url), F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    df = df.withColumn("__rest", F.coalesce(rest, F.lit("")))
    df = df.withColumns({
        "host": F.translate(F.regexp_extract("__rest", r"^([^/?#]*)", 1), _UPPER, _LOWER),
        "path": F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1),
        "__query": F.regexp_extract("__rest", r"^[^?#]*(\?[^#]*)?", 1),
    })
    plain = F.when(F.col("path") == "", "/").otherwise(without_dots(F.col("path")))
    return df.withColumn("address", F.when(F.col("host") != "", F.concat("host", plain, "__query"))).drop("__rest", "__query")


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct<rule, allow>; null if none does."""
    out = F.lit(None)
    for r in sorted(rules, key=lambda r: (len(str(r)), str(r))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(str(r)).alias("rule"), F.lit(r.allow).alias("allow"))).otherwise(out)
    return out


_ATTR = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?is)(?:^|[\s\"'/])" + name + _ATTR
    return F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)))


#: Entities of HTML that are decoded in attributes, in this order.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]


def decoded(text: Column) -> Column:
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def _absolute() -> Column:
    """``target`` as seen from the page of columns scheme, host, path; its dot segments stay."""
    target, scheme = F.col("target"), F.col("scheme")
    root = F.concat(scheme, F.lit("://"), "host")
    path = F.when(F.col("path") == "", "/").otherwise(F.col("path"))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | target.startswith("#"), None)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(root, path, target))
        .otherwise(F.concat(root, F.regexp_replace(path, r"[^/]*$", ""), target))
    )


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, a_host, a_path, b, b_host, b_path): pages and the addresses that they name
    as canonical or redirect to."""
    linked = pages.select(F.col(url_col).alias("u"), F.col(html_col).alias("h")).where(F.col("h").rlike(r"(?i)canonical|refresh"))
    tags = linked.select("u", F.explode(F.regexp_extract_all("h", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"))
    tags = stored(tags.where(F.col("tag").rlike(r"(?i)canonical|refresh")), "tags")
    tags = stored(tags.select("u", *(decoded(_attribute(F.col("tag"), a)).alias(a.replace("-", "_")) for a in ("rel", "href", "http-equiv", "content"))), "attributes")
    canonical = F.when(F.lower("rel").rlike(r"(^|\s)canonical(\s|$)"), F.col("href"))
    refresh = F.when(F.lower(F.trim("http_equiv")) == "refresh", F.regexp_extract("content", r"(?i)url\s*=\s*[\"']?([^\"';]+)", 1))
    found = tags.select("u", F.trim(F.coalesce(canonical, refresh)).alias("target")).where("target <> ''").distinct()
    found = with_address(found, "u").where("address is not null").withColumn("scheme", F.regexp_extract("u", r"^([^:/?#]*):", 1))
    source = found.select(F.col("address").alias("a"), F.col("host").alias("a_host"), F.col("path").alias("a_path"), _absolute().alias("url"))
    out = with_address(source, "url").where("address is not null").withColumn("path", without_dots(F.col("path")))
    return stored(out.select("a", "a_host", "a_path", F.col("address").alias("b"), F.col("host").alias("b_host"), F.col("path").alias("b_path")).distinct(), "links")


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), by_alias (whether the block came from an alias)."""
    links = alias_edges(pages, url_col, html_col)
    parts = connected_components(links.select(F.md5("a").alias("a"), F.md5("b").alias("b")))
    ends = links.select("a", "a_host", "a_path").unionByName(links.select(F.col("b").alias("a"), F.col("b_host").alias("a_host"), F.col("b_path").alias("a_path")))
    blocked_node = ends.withColumn("r", rule_of(F.col("a_host"), F.col("a_path"), rules)).where("not r.allow").select(F.md5("a").alias("node")).distinct()
    blocked = parts.join(blocked_node, "node", "left_semi").select("component").distinct()
    aliases = parts.join(blocked, "component", "left_semi").select(F.col("node").alias("alias"), F.lit(True).alias("hit"))
    aliases = stored(aliases, "aliases")
    own = with_address(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), "url")
    own = own.select("page_id", "host", "path", F.md5("address").alias("node"), rule_of(F.col("host"), F.col("path"), rules).alias("r"))
    # only addresses without a rule of their own can take a verdict over
    joined = own.join(aliases, F.col("node") == F.col("alias"), "left")
    by_alias = F.col("r").isNull() & F.coalesce("hit", F.lit(False))
    verdict = F.when(F.col("r").isNotNull(), F.when(F.col("r.allow"), "allow").otherwise("block")).when(by_alias, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), by_alias.alias("by_alias"))
