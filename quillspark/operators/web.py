"""Pages: which addresses may be read, their links, tables, and an offline crawl."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from ..sources.tables import checkpointed, discard

# Hosts of cloud metadata services, and address blocks that are not public (first address, prefix length).
METADATA_HOSTS = ["169.254.169.254", "metadata.google.internal", "metadata"]
NOT_PUBLIC = [("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4)]


def matches_glob(url: Column, pattern: Column) -> Column:
    """``*`` stands for anything; found anywhere in the url; other characters are a regex."""
    return F.regexp(url, F.replace(pattern, F.lit("*"), F.lit(".*")))


def wanted(url: Column, include: Column, exclude: Column) -> Column:
    """Not excluded, and included if there is any inclusion at all."""
    out = F.exists(F.coalesce(exclude, F.array().cast("array<string>")), lambda p: matches_glob(url, p))
    some = F.coalesce(F.size(include), F.lit(0)) > 0
    return ~out & (~some | F.exists(include, lambda p: matches_glob(url, p)))


# Blocks of IPv6 addresses that are not public (first group pattern).
LOCAL6 = r"^(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|fec[0-9a-f]:.*|2001:db8:.*|2001:0*[0-9a-f]{0,2}:.*|100::.*|64:ff9b:1:.*)$"


def _number(ip: str) -> int:
    return reduce(lambda n, x: n * 256 + int(x), ip.split("."), 0)


def ipv4_number(host: Column) -> Column:
    """The address that a literal IPv4 host names, in any spelling that resolvers take: one to
    four parts, each decimal, octal (0..) or hexadecimal (0x..), the last one filling
    what is left; null for anything else."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    part = lambda x: F.when(x.rlike(r"^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(x, F.lit(3), F.length(x)), 16, 10)).when(x.rlike(r"^0[0-7]*$"), F.conv(x, 8, 10)).when(x.rlike(r"^[1-9][0-9]*$"), x).try_cast("decimal(20,0)").try_cast("long")
    values = F.transform(parts, part)
    head = F.aggregate(F.slice(values, F.lit(1), n - 1), F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    last = F.element_at(values, -1)
    room = F.pow(F.lit(256), 5 - n).cast("long")
    fine = (n <= 4) & F.forall(values, lambda x: x.isNotNull()) & F.forall(F.slice(values, F.lit(1), n - 1), lambda x: x < 256) & (last < room)
    return F.when(fine, head * room + last)


def _mapped(host: Column) -> Column:
    """The IPv4 number inside an IPv6 host (mapped, compatible or translated), or null."""
    dotted = F.regexp_extract(host, r"^(?:::ffff:(?:0+:)?|::|64:ff9b::|(?:0+:){5}ffff:)(\d+\.\d+\.\d+\.\d+)$", 1)
    group = lambda i: F.regexp_extract(host, r"^(?:::ffff:(?:0+:)?|64:ff9b::|(?:0+:){5}ffff:)([0-9a-f]{1,4}):([0-9a-f]{1,4})$", i)
    hexed = F.when(group(1) != "", F.conv(group(1), 16, 10).cast("long") * 65536 + F.conv(group(2), 16, 10).cast("long"))
    return F.coalesce(F.when(dotted != "", ipv4_number(dotted)), hexed)


def is_safe(url: Column, known_names: bool = False) -> Column:
    """http(s) with a host that is neither a metadata service nor a literal address outside
    the public blocks, however it is spelled.  Names are not resolved: ``known_names`` says
    whether they pass (a name that can't be resolved does not)."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    host = F.regexp_replace(host, r"\.+$", "")
    six = F.when(host.startswith("["), F.regexp_replace(host, r"^\[|%.*$|\]$", ""))
    number = F.coalesce(_mapped(six), F.when(six.isNull(), ipv4_number(host)))
    outside = reduce(lambda a, b: a & b, (F.shiftright(number, 32 - bits) != _number(first) >> (32 - bits) for first, bits in NOT_PUBLIC))
    public6 = six.rlike(r"^[0-9a-f:.]+$") & ~six.rlike(LOCAL6)
    named = host.rlike(r"[a-z]") & ~host.rlike(r"^(.*\.)?localhost$") & F.lit(known_names)
    ok = F.when(number.isNotNull(), outside).when(six.isNotNull(), public6).otherwise(named)
    return F.coalesce(scheme.isin("http", "https") & (host != "") & ~host.isin(*METADATA_HOSTS) & ok, F.lit(False))


def normalised(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def joined(base: Column, link: Column) -> Column:
    """``link`` as seen from ``base`` (absolute, from the host, from the root, or from the folder)."""
    root, scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^:/])/[^/]*$", "")
    return F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(folder, F.lit("/"), link))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def tables(html: Column) -> Column:
    """HTML of every table that holds no other."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<table\b(?:(?!<table\b).)*?</table>"), F.lit(0))


def table_rows(table: Column) -> Column:
    """array<array<string>>: the cells' texts, row by row; a cell's pieces of text are stripped and joined."""
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr\b.*?(?:</tr>|(?=<tr\b)|$)"), F.lit(0))
    plain = lambda c: F.array_join(F.transform(F.split(F.regexp_replace(c, r"(?is)^<t[hd]\b[^>]*>", ""), r"(?s)<[^>]+>"), strip), "")
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[hd]\b[^>]*>.*?(?=</t[hd]>|<t[hd]\b|</tr>|$)"), F.lit(0)), plain)
    return F.filter(F.transform(rows, cells), lambda r: F.size(r) > 0)


def table_markdown(table: Column) -> Column:
    """``| a | b |`` lines; if there are more than one, ``|---|---|`` after the first, a part for each of its columns (as its pipes count them)."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    lines = F.transform(table_rows(table), line)
    columns = F.size(F.split(F.get(lines, F.lit(0)), r"\|")) - 2
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), columns))
    return F.when(F.size(lines) > 1, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines))), "\n")).when(F.size(lines) == 1, F.array_join(lines, "\n")).otherwise(F.lit(""))


def markdown_rows(x: Column) -> Column:
    """Cells of the lines that begin with a pipe, without the rule."""
    lines = F.filter(F.transform(F.split(x, "\n"), strip), lambda s: s.startswith("|") & ~s.rlike(r"^\|[\s:|-]+\|?$"))
    return F.transform(lines, lambda s: F.transform(F.split(F.regexp_replace(s, r"^\||\|$", ""), r"\|"), strip))


def table_records(html: Column, strategy: str = "markdown") -> Column:
    """array<struct<index,html,markdown,needs_summary>> of a page's tables: ``raw_html`` has no
    markdown, ``summary_and_html`` has it and asks for a summary."""
    found = tables(html)
    return F.transform(found, lambda t, i: F.struct(
        i.alias("index"), t.alias("html"),
        (table_markdown(t) if strategy != "raw_html" else F.lit(None).cast("string")).alias("markdown"),
        F.lit(strategy == "summary_and_html").alias("needs_summary"),
    ))


def crawl(seeds: DataFrame, edges: DataFrame, depth: int, max_pages: int | None = None, include: list[str] | None = None, exclude: list[str] | None = None, safe: bool = False) -> DataFrame:
    """url, depth (and, with ``max_pages``, place) of pages reached from ``seeds`` (url) over
    ``edges`` (src, dst and, if there is one, pos: the link's place on its page) in at most
    ``depth`` steps, breadth first.

    With ``max_pages`` a level that would pass it is cut by arrival: links of earlier pages come
    first, and those of a page in their order (by pos, else by dst; seeds by pos or url).  Pages that the patterns or
    (``safe``) the address rules refuse are neither taken nor followed; an unsafe seed is an error."""
    array = lambda x: F.array(*map(F.lit, x or [])).cast("array<string>")
    fine = lambda df: df.where(wanted(F.col("url"), array(include), array(exclude)) & (is_safe(F.col("url"), known_names=True) if safe else F.lit(True)))
    if safe and not seeds.where(~is_safe(F.col("url"), known_names=True)).isEmpty():
        raise ValueError("unsafe start address")
    pos = lambda df: F.col("pos").cast("long") if "pos" in df.columns else F.lit(0).cast("long")
    arrival = F.min(F.struct("place", "pos", "url"))
    e = checkpointed(edges.select(normalised(F.col("src")).alias("src"), normalised(F.col("dst")).alias("dst"), pos(edges).alias("pos")).groupBy("src", "dst").agg(F.min("pos").alias("pos")))

    def level_of(arrived: DataFrame, level: int, held: int) -> DataFrame:
        """url, depth, place of what has arrived (url, came: its first arrival)."""
        if max_pages is None:
            return checkpointed(arrived.select("url", F.lit(level).alias("depth"), F.lit(0).cast("long").alias("place")))
        first = arrived.orderBy("came", "url").limit(max_pages - held)  # so many rows at most are numbered
        return checkpointed(first.select("url", F.lit(level).alias("depth"), (F.row_number().over(Window.orderBy("came", "url")) - 1 + held).cast("long").alias("place")))

    start = fine(seeds.select(normalised(F.col("url")).alias("url"), F.lit(0).cast("long").alias("place"), pos(seeds).alias("pos")))
    seen = front = level_of(start.groupBy("url").agg(arrival.alias("came")), 0, 0)
    held = front.count()
    for level in range(1, depth + 1):
        if max_pages is not None and held >= max_pages:
            break
        reached = fine(front.join(e, F.col("url") == F.col("src")).select(F.col("dst").alias("url"), "place", "pos"))
        arrived = reached.groupBy("url").agg(arrival.alias("came")).join(seen.select("url"), "url", "left_anti")
        front = level_of(arrived, level, held)
        found = front.count()
        if not found:
            break
        held += found
        old, seen = seen, checkpointed(seen.unionByName(front))
        discard(old)
    return seen.drop(*(["place"] if max_pages is None else []))


#: Pages at the head of the stack whose links are looked up by one job.
AHEAD = 16


def crawl_deep(seeds: list[str], edges: DataFrame, depth: int, max_pages: int, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """url, depth, place of at most ``max_pages`` pages, depth first: the link found last is
    followed first.  ``edges`` has src, dst and pos (the link's place on its page).

    Which page follows is known only when the one before has been taken, so the walk is the
    driver's; the links are looked up for several pages at the head of the stack at once.  Of
    a page's links the last ``max_pages`` different ones are all that can be taken: each is
    either taken from here or has been by then.  So the driver holds max_pages squared urls at most.
    """
    spark = edges.sparkSession
    array = lambda x: F.array(*map(F.lit, x or [])).cast("array<string>")
    fine = wanted(F.col("dst"), array(include), array(exclude))
    e = checkpointed(edges.select(normalised(F.col("src")).alias("src"), normalised(F.col("dst")).alias("dst"), "pos").where(fine).groupBy("src", "dst").agg(F.max("pos").alias("pos")))
    start = spark.createDataFrame([(s,) for s in seeds], "dst string").select(normalised(F.col("dst")).alias("dst")).where(fine).toArrow().column(0).to_pylist()
    stack, seen, known = [(u, 0) for u in start], {}, {}
    while stack and len(seen) < max_pages:
        url, d = stack.pop()
        if url in seen or d > depth:
            continue
        seen[url] = (d, len(seen))
        if d == depth:
            continue
        if url not in known:
            ahead = dict.fromkeys([url, *(u for u, at in reversed(stack[-AHEAD:]) if at < depth and u not in seen)])
            last = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("pos"), F.desc("dst")))
            known = {u: [] for u in ahead}
            for r in e.where(F.col("src").isin(list(ahead))).withColumn("n", last).where(F.col("n") <= max_pages).orderBy("src", F.desc("n")).toLocalIterator():
                known[r["src"]].append(r["dst"])
        stack += [(u, d + 1) for u in known.pop(url) if u not in seen]
    return spark.createDataFrame([(u, d, i) for u, (d, i) in seen.items()], "url string, depth int, place int")
