"""String functions as column expressions (built-in functions only).

``(?U)`` makes Java's ``\\s`` cover all Unicode white space; Spark's ``trim`` takes off
blanks only, so ``strip`` is a regular expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EMBED_LIMIT = 1024

# What marks the start of an answer, what gives away a line of reasoning
# or a sentence of it, the tags around answers, and the ids of models that are not for chat.
ANSWER_MARKERS = ["assistantfinal", "translation:", "The translation is:", "Here is the translation:", "Final translation:"]
REASONING_LINES = ["we need to translate", "the user wrote", "the user says", "so translation", "provide only", "that is", "but we", "so we", "we can", "we must", "the instruction says", "but the", "however,", "note:", "important:"]
REASONING_SENTENCES = ["we need", "the user", "so translation", "but we", "provide only", "the instruction"]
WRAPPER_TAGS = ["<answer>", "</answer>", "<summary>", "</summary>"]
NOT_CHAT_MODELS = ["embedding", "embed-", "bge-", "e5-", "nomic-embed", "text-embedding", "docling", "granite-docling", "rerank", "reranker", "bge-reranker", "tts", "stt", "whisper", "asr", "kokoro"]
# Layout labels and the kind of text that each stands for, first match wins.
TEXT_TYPES = [(["heading", "title", "section_header"], "header"), (["caption"], "caption"), (["footnote"], "footnote"), (["list"], "list_item"), (["table"], "table"), (["picture", "figure"], "picture")]


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapse(x: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.regexp_replace(strip(x), r"(?U)\s+", " ")


def contains_any(x: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(x, F.lit(p)) for p in parts))


def non_blank(x: Column) -> Column:
    return F.coalesce(x.rlike(r"(?U)\S"), F.lit(False))


def truncate_for_embedding(x: Column, limit: int = EMBED_LIMIT) -> Column:
    """At most ``limit`` characters, cut back to the last white space; a text without
    any inside the limit is cut hard, leading white space counts as none."""
    part = F.substring(x, 1, limit)
    body = F.regexp_replace(part, r"(?U)\s+$", "")
    return (
        F.when(F.length(x) <= limit, x)
        .when(body == "", part)
        .when(body.rlike(r"(?U)\S\s+\S+$"), F.regexp_replace(body, r"(?U)\s+\S+$", ""))
        .otherwise(F.regexp_replace(body, r"(?U)^\s+", ""))
    )


def paragraphs(x: Column, separator: str = "\n\n") -> Column:
    """Stripped parts between separators, blank ones left out."""
    return F.filter(F.transform(F.split(x, separator), strip), lambda p: p != "")


def snippet(x: Column, limit: int = 200) -> Column:
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit), F.lit("..."))).otherwise(x)


def file_extension(name: Column) -> Column:
    """Lower-case part after the last dot, empty without one."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.regexp_extract(name, r"(?s)\.([^.]*)$", 1))).otherwise(F.lit(""))


def text_type(label: Column) -> Column:
    low, out = F.lower(F.coalesce(label, F.lit(""))), F.lit("body")
    for parts, kind in reversed(TEXT_TYPES):
        out = F.when(contains_any(low, parts), kind).otherwise(out)
    return out


def is_chat_model(model_id: Column) -> Column:
    return ~contains_any(F.lower(F.coalesce(model_id, F.lit(""))), NOT_CHAT_MODELS)


# The markup of titles, each with its text in the first group.
TITLE_MARKUP = [r"\*\*([^*]+)\*\*", r"\*([^*]+)\*", r"__([^_]+)__", r"_([^_]+)_", r"`([^`]+)`", r"\[([^\]]+)\]\([^\)]+\)"]


def clean_title(raw: Column, limit: int = 60) -> Column:
    """A model's title without quotes, prefix and markdown, at most ``limit`` characters."""
    t = strip(F.regexp_replace(F.regexp_replace(strip(raw), r'^"+|"+$', ""), r"^'+|'+$", ""))
    t = F.when(F.lower(t).startswith("title:"), strip(F.substring(t, 7, 1 << 20))).otherwise(t)
    for pattern in TITLE_MARKUP:
        t = F.regexp_replace(t, pattern, "$1")
    t = F.substring(collapse(F.regexp_replace(t, "#", "")), 1, limit)
    return F.when(F.coalesce(t, F.lit("")) == "", "Untitled").otherwise(t)


def is_default_title(x: Column) -> Column:
    return F.coalesce(x, F.lit("")).isin("", "Untitled") | F.coalesce(x.startswith("Chat with"), F.lit(False))


def after_marker(x: Column) -> Column:
    """What follows the first of the listed markers that the text holds, in any case."""
    out = x
    for marker in reversed(ANSWER_MARKERS):
        at = F.locate(marker.lower(), F.lower(x))
        out = F.when(at > 0, strip(F.substr(x, at + len(marker)))).otherwise(out)
    return out


def clean_translation(x: Column, srt: bool = False) -> Column:
    """A model's translation without preamble and reasoning; subtitles keep their lines."""
    text = after_marker(x)
    if srt:
        return strip(text)
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda s: (s != "") & ~contains_any(F.lower(s), REASONING_LINES))
    body = F.array_join(F.filter(F.transform(lines, after_marker), lambda s: s != ""), "\n")
    sentences = F.filter(F.split(body, r"\. "), lambda s: ~contains_any(F.lower(s), REASONING_SENTENCES))
    joined = strip(F.array_join(sentences, ". "))
    dotted = F.when((F.size(sentences) > 1) & ~joined.endswith("."), F.concat(joined, F.lit("."))).otherwise(joined)
    long = F.when((F.length(body) > 300) & (F.size(sentences) > 0), dotted).otherwise(body)
    return F.when(x == "", x).otherwise(F.regexp_replace(long, r"^[.,!?;: \n\t]+|[.,!?;: \n\t]+$", ""))


def strip_wrappers(x: Column) -> Column:
    return strip(reduce(lambda s, tag: F.replace(s, F.lit(tag), F.lit("")), WRAPPER_TAGS, x))


def think_block(x: Column) -> Column:
    """struct<reasoning, caption>; caption is null if there is no think tag at all."""
    opens, closes = F.locate("<think>", x), F.locate("</think>", x)
    close_after = F.when(opens > 0, F.locate("</think>", F.substr(x, opens + 7)))  # counted from the end of the opening tag
    both = (opens > 0) & (close_after > 0)
    reasoning = (
        F.when(both, strip(F.substr(x, opens + 7, close_after - 1)))
        .when(opens > 0, strip(F.substr(x, opens + 7)))
        .when(closes > 0, strip(F.substr(x, F.lit(1), closes - 1)))
        .otherwise(F.lit(""))
    )
    caption = (
        F.when(both, strip_wrappers(F.substr(x, opens + close_after + 14)))
        .when(opens > 0, strip_wrappers(F.replace(F.substr(x, F.lit(1), opens - 1), F.lit("</think>"), F.lit(""))))
        .when(closes > 0, strip_wrappers(F.substr(x, closes + 8)))
    )
    return F.struct(reasoning.alias("reasoning"), caption.alias("caption"))


def drop_repeated_sentences(x: Column, least: int = 20) -> Column:
    """Sentences of ``least`` characters or more are kept once, at their first place."""
    sentences = F.split(strip(x), r"(?U)(?<=[.!?])\s+")
    key = lambda s: F.regexp_replace(F.lower(strip(s)), r"(?U)\s+", " ")
    keys = F.transform(sentences, key)
    keep = F.filter(F.transform(sentences, lambda s, i: F.struct(s.alias("s"), ((F.length(key(s)) < least) | (F.array_position(keys, key(s)) == i + 1)).alias("k"))), lambda r: r["k"])
    return F.array_join(F.transform(keep, lambda r: r["s"]), " ")


def salvaged_caption(json: Column) -> Column:
    """The caption of a JSON object that may be cut off."""
    whole, cut = r'"caption"\s*:\s*"((?:[^"\\]|\\.)*)"', r'(?s)"caption"\s*:\s*"(.*)$'
    plain = lambda c: F.replace(c, F.lit('\\"'), F.lit('"'))
    return F.when(json.rlike(whole), plain(F.regexp_extract(json, whole, 1))).otherwise(strip(plain(F.regexp_extract(json, cut, 1))))


def strip_code_fence(x: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(x), r"^```(?:json)?", ""), r"```$", ""))


def segment_replies(x: Column) -> Column:
    """map<id, text> of lines ``[id]: text``; a text runs to the next ``[`` at a line start, the last of an id wins."""
    found = F.regexp_extract_all(x, F.lit(r"(?s)\[[^\]]+\]: ?.*?(?=\n\[|\z)"), F.lit(0))
    return F.map_from_entries(F.transform(found, lambda s: F.struct(F.regexp_extract(s, r"^\[([^\]]+)\]", 1), strip(F.regexp_replace(s, r"(?s)^\[[^\]]+\]: ?", "")))))


def error_kind(x: Column) -> Column:
    low = F.lower(x)
    return F.when(contains_any(low, ["connection", "timeout"]), "unavailable").when(F.contains(x, F.lit("404")), "not_found").when(F.contains(x, F.lit("401")), "unauthorised").otherwise("other")


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """``{name}`` placeholders filled; a template with an unknown one stays as it is."""
    import string

    try:
        names = {n for _, n, _, _ in string.Formatter().parse(template) if n is not None}
    except ValueError:
        return F.lit(template)
    if not names <= set(values):
        return F.lit(template)
    return reduce(lambda s, n: F.replace(s, F.lit("{" + n + "}"), values[n].cast("string")), sorted(names), F.lit(template))


def video_prompt(library: dict[str, dict[str, str]], mode: Column, values: dict[str, Column], tracks: Column, model_id: Column, instructions: dict[str, str] | None = None) -> Column:
    """struct<prompt,id>: the template of a mode (template, id, tracks_append, tracks_append_empty), of
    ``procedure`` for unknown ones; what it says with or without tracks is added, then the
    instruction of a model whose id holds one of the names."""
    def of(m: dict[str, str]) -> Column:
        base = library.get("procedure", {}).get("template", "") if not m.get("template") else m["template"]
        filled = fill_template(base, {**values, "tracks_json": F.coalesce(tracks, F.lit(""))})
        more = F.when(non_blank(tracks), fill_template(m.get("tracks_append", ""), {"tracks_json": tracks})).otherwise(F.lit(m.get("tracks_append_empty", "")))
        return F.struct(F.concat(filled, more).alias("prompt"), F.lit(m.get("id", "procedure_v1")).alias("id"))

    out = of(library.get("procedure", {}))
    for name, m in library.items():
        out = F.when(mode == name, of(m)).otherwise(out)
    extra = F.lit("")
    for name, text in (instructions or {}).items():
        extra = F.when(F.contains(F.lower(F.coalesce(model_id, F.lit(""))), F.lit(name)), F.lit(text)).otherwise(extra)
    return F.struct(F.concat(out["prompt"], extra).alias("prompt"), out["id"].alias("id"))
