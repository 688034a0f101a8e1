"""Joining what models and extractors return with the rows it belongs to."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from typing import Protocol
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import salvaged_caption, strip, think_block

BATCH = 200


# --- translations ---------------------------------------------------------------------------

def translation_prompts(segments: DataFrame, size: int = BATCH) -> DataFrame:
    """doc_id, batch, prompt: ``[id]: text`` lines of at most ``size`` segments (doc_id, seq, id, text) that are not blank."""
    some = segments.where(F.col("text").rlike(r"(?U)\S"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1
    line = F.concat(F.lit("["), "id", F.lit("]: "), "text")
    rows = some.select("doc_id", F.floor(n / size).cast("int").alias("batch"), "seq", line.alias("line"))
    return rows.groupBy("doc_id", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("prompt"))


def translated(segments: DataFrame, replies: DataFrame) -> DataFrame:
    """Segments with the reply of their (doc_id, id) in place of the text, where there is one."""
    new = replies.select("doc_id", "id", F.col("text").alias("__new"))
    return segments.join(new, ["doc_id", "id"], "left").withColumn("text", F.coalesce("__new", "text")).drop("__new")


def zipped(left: Column, right: Column) -> Column:
    """Pairs by position, as many as the shorter array has."""
    n = F.least(F.size(left), F.size(right))
    return F.arrays_zip(F.slice(left, F.lit(1), n).alias("left"), F.slice(right, F.lit(1), n).alias("right"))


# --- relations between entities ---------------------------------------------------------------

def resolved(relations: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Relations (key, subject, predicate, object) with the types of their ends: of
    entities of that name in the same text the last one's, else 'unknown'."""
    last = found.groupBy(key, F.lower("name").alias("__n")).agg(F.max_by("entity_type", "pos").alias("__t"))
    out = relations
    for end in ("subject", "object"):
        side = last.select(F.col(key).alias("__k"), F.col("__n").alias("__e"), F.col("__t").alias(f"{end}_type"))
        out = out.join(side, (F.col(key) == F.col("__k")) & (F.lower(end) == F.col("__e")), "left").drop("__k", "__e").withColumn(f"{end}_type", F.coalesce(f"{end}_type", F.lit("unknown")))
    return out


def relation_counts(relations: DataFrame) -> DataFrame:
    return relations.groupBy(F.lower("subject").alias("subject"), "predicate", F.lower("object").alias("object")).agg(F.count("*").alias("n"))


def parsed_entities(reply: Column, confidence: float = 0.8) -> Column:
    """array<struct<entity,type,confidence>> of a JSON reply; items without a name or type go."""
    items = F.from_json(reply, "array<struct<entity:string,type:string,confidence:double>>")
    whole = F.filter(items, lambda x: x["entity"].isNotNull() & x["type"].isNotNull())
    return F.coalesce(F.transform(whole, lambda x: F.struct(x["entity"].alias("entity"), x["type"].alias("type"), F.coalesce(x["confidence"], F.lit(confidence)).alias("confidence"))), F.array().cast("array<struct<entity:string,type:string,confidence:double>>"))


# --- replies of a vision model -----------------------------------------------------------------

_BRACE = re.compile("[{}]")


def braced(text: str | None) -> str | None:
    """The first object in braces, of a fenced block if there is one (braces are only
    counted); one that a fence leaves open runs to the end, a bare open one is none."""
    def first(t: str) -> tuple[str | None, bool]:
        begin = t.find("{")
        if begin < 0:
            return None, False
        depth = 0
        for brace in _BRACE.finditer(t, begin):
            depth += 1 if brace[0] == "{" else -1
            if not depth:
                return t[begin:brace.end()], True
        return t[begin:], False

    t = (text or "").strip()
    for fence in ("```json", "```"):
        if fence in t:
            found, _ = first(t.split(fence, 1)[1])
            if found is not None:
                return found
    found, closed = first(t)
    return found if closed else None


@F.pandas_udf(T.StringType())
def json_object(x: pd.Series) -> pd.Series:
    return x.map(braced)


def vision_replies(rows: DataFrame, column: str = "reply") -> DataFrame:
    """Adds caption, events, entities, notes and reasoning, read from a model's reply:
    its thinking is taken off, then an object is parsed, a cut one is salvaged, and
    anything else is the caption.  events and entities are arrays of JSON strings.

    The object is a VARIANT, parsed once; whatever has another type than a field should
    have counts as missing."""
    out = rows.withColumn("__t", think_block(strip(F.coalesce(F.col(column), F.lit("")))))
    out = out.withColumn("__body", F.coalesce("__t.caption", strip(F.coalesce(F.col(column), F.lit("")))))
    out = out.withColumn("__json", json_object("__body")).withColumn("__v", F.try_parse_json("__json"))
    ok = F.coalesce(F.schema_of_variant("__v").startswith("OBJECT"), F.lit(False))
    strings = lambda path: F.coalesce(F.when(ok, F.try_variant_get("__v", path, "array<string>")), F.array().cast("array<string>"))
    salvaged = F.when(F.col("__json").isNotNull() & ~ok, F.nullif(salvaged_caption(F.col("__json")), F.lit("")))
    caption = F.when(ok, F.coalesce(F.try_variant_get("__v", "$.caption", "string"), F.lit(""))).otherwise(F.coalesce(salvaged, "__body"))
    notes = F.when(salvaged.isNotNull(), F.array(F.lit("Response truncated (max_tokens)."))).otherwise(strings("$.notes"))
    return out.withColumns({"caption": caption, "events": strings("$.events"), "entities": strings("$.entities"), "notes": notes, "reasoning": F.col("__t.reasoning")}).drop("__t", "__body", "__json", "__v")


# --- office documents ---------------------------------------------------------------------------

_W, _A, _P = ("{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/drawingml/2006/main}", "{http://schemas.openxmlformats.org/presentationml/2006/main}")


def _texts(run: ElementTree.Element, tag: str) -> str:
    return "".join(t.text or "" for t in run.iter(tag))


def docx_runs(content: bytes) -> Iterator[tuple[str, str]]:
    """(id, text) of runs that are not blank: p<paragraph>_r<run>, then t<table>_r<row>_c<cell>_p<paragraph>_r<run>."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    for p, par in enumerate(body.findall(f"{_W}p")):
        for r, run in enumerate(par.findall(f"{_W}r")):
            if (t := _texts(run, f"{_W}t")).strip():
                yield f"p{p}_r{r}", t
    for t_no, table in enumerate(body.findall(f"{_W}tbl")):
        for row_no, row in enumerate(table.findall(f"{_W}tr")):
            for c, cell in enumerate(row.findall(f"{_W}tc")):
                for p, par in enumerate(cell.findall(f"{_W}p")):
                    for r, run in enumerate(par.findall(f"{_W}r")):
                        if (t := _texts(run, f"{_W}t")).strip():
                            yield f"t{t_no}_r{row_no}_c{c}_p{p}_r{r}", t


def pptx_runs(content: bytes) -> Iterator[tuple[str, str]]:
    """(id, text) of runs that are not blank: s<slide>_sh<shape>_p<paragraph>_r<run>."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((n for n in z.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml")), key=lambda n: int("".join(filter(str.isdigit, n)) or 0))
        for s, name in enumerate(slides):
            tree = ElementTree.fromstring(z.read(name)).find(f"{_P}cSld/{_P}spTree")
            for sh, shape in enumerate(x for x in tree if x.tag in (f"{_P}sp", f"{_P}pic", f"{_P}graphicFrame", f"{_P}grpSp", f"{_P}cxnSp")):
                for p, par in enumerate(shape.findall(f"{_P}txBody/{_A}p")):
                    for r, run in enumerate(par.findall(f"{_A}r")):
                        if (t := _texts(run, f"{_A}t")).strip():
                            yield f"s{s}_sh{sh}_p{p}_r{r}", t


def office_runs(files: DataFrame) -> DataFrame:
    """path, seq, id, text of binaryFile rows (path, content) of .docx and .pptx; files that can't be read give nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = list((pptx_runs if path.lower().endswith("pptx") else docx_runs)(content))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError, TypeError):
                    rows = []
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["path", "seq", "id", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, seq int, id string, text string")


def docx_paragraphs(content: bytes) -> str:
    """Paragraphs, blank ones too, joined by a blank line."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    return "\n\n".join("".join(_texts(run, f"{_W}t") for run in par.findall(f"{_W}r")) for par in body.findall(f"{_W}p"))


class PdfReader(Protocol):
    """Pages' texts and the information of a PDF; a library or service stands behind it."""

    def pages(self, content: bytes) -> list[str]: ...

    def information(self, content: bytes) -> dict[str, str]: ...


class PlainPdf:
    """Offline stand-in: literal strings of uncompressed content streams, a page for each, and the plain entries of the information."""

    def pages(self, content: bytes) -> list[str]:
        streams = re.findall(rb"stream\r?\n(.*?)endstream", content, re.S)
        shown = (re.findall(rb"\(((?:[^()\\]|\\.)*)\)\s*Tj", s) for s in streams)
        return [" ".join(re.sub(rb"\\(.)", rb"\1", x).decode("latin-1") for x in page) for page in shown]

    def information(self, content: bytes) -> dict[str, str]:
        return {k.decode(): v.decode("latin-1") for k, v in re.findall(rb"/(Author|Title|CreationDate|ModDate)\s*\(((?:[^()\\]|\\.)*)\)", content)}


def pdf_text(content: bytes, reader: PdfReader | None = None) -> str:
    """Pages that are not empty, joined by a blank line; the empty text if it can't be read."""
    try:
        return "\n\n".join(p for p in (reader or PlainPdf()).pages(content) if p.strip())
    except Exception:
        return ""


def extracted(files: DataFrame, pdf: PdfReader | None = None) -> DataFrame:
    """path, file_type, text, error of binaryFile rows (path, content), by the file's ending:
    pdf, text and markdown (strict UTF-8) and docx; anything else, or a file that can't be read, is an error."""
    def one(path: str, content: bytes) -> tuple[str, str | None, str | None]:
        kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
        try:
            if kind == "pdf":
                return kind, pdf_text(content, pdf), None
            if kind in ("txt", "md", "markdown"):
                return kind, content.decode("utf-8"), None
            if kind == "docx":
                return kind, docx_paragraphs(content), None
        except (UnicodeDecodeError, zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError) as e:
            return kind, None, str(e)
        return kind, None, f"Unsupported file type: {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            rows = [one(p, c or b"") for p, c in zip(paths, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *(pa.array([r[i] for r in rows], pa.string()) for i in range(3))], names=["path", "file_type", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, file_type string, text string, error string")


def pdf_information(files: DataFrame, reader: PdfReader | None = None) -> DataFrame:
    """path, information (map of Author, Title, CreationDate, ModDate, stripped; missing ones left out)."""
    reader = reader or PlainPdf()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [[(k, v.strip()) for k, v in reader.information(c or b"").items() if v.strip()] for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.map_(pa.string(), pa.string()))], names=["path", "information"])

    return files.select("path", "content").mapInArrow(run, "path string, information map<string,string>")


def table_embed_text(caption: Column, markdown: Column) -> Column:
    """Caption, a blank line and the table; the table alone without a caption."""
    return F.when(F.coalesce(strip(caption), F.lit("")) != "", F.concat(caption, F.lit("\n\n"), F.coalesce(markdown, F.lit("")))).otherwise(F.coalesce(markdown, F.lit("")))


def tracks_json(tracks: Column) -> Column:
    """JSON of an array of tracks; ``[]`` for none."""
    return F.when(F.coalesce(F.size(tracks), F.lit(0)) > 0, F.to_json(tracks)).otherwise(F.lit("[]"))


def frame_detections(detections: DataFrame) -> DataFrame:
    """video_id, t, detections: JSON of the boxes (track_id, x, y, w, h) of every frame, by track."""
    box = F.struct("track_id", "x", "y", "w", "h")
    return detections.groupBy("video_id", "t").agg(F.to_json(F.array_sort(F.collect_list(box))).alias("detections"))


# --- small figures -------------------------------------------------------------------------------

def pipeline_summary(segments: DataFrame) -> DataFrame:
    """segments, avg_frames (one decimal, 0 without segments), tracks in all, and elapsed
    seconds from the first start to the last end where segments have started and ended."""
    timed = {"started", "ended"} <= set(segments.columns)
    elapsed = [F.round(F.unix_micros(F.max("ended")) / 1e6 - F.unix_micros(F.min("started")) / 1e6, 3).alias("elapsed")] if timed else []
    return segments.agg(*elapsed, F.count("*").alias("segments"), F.coalesce(F.round(F.avg(F.size("frame_times")), 1), F.lit(0.0)).alias("avg_frames"), F.coalesce(F.sum(F.size("tracks")), F.lit(0)).alias("tracks"))


def every_nth(rows: DataFrame, n: int, index: str = "segment_idx") -> DataFrame:
    return rows.where(F.col(index) % n == 0)


def mean_level(bins: Column) -> Column:
    return F.aggregate(bins, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(bins), F.lit(0))


def path_inside(path: Column, folder: str) -> Column:
    """Whether a path without ``..`` lies in a folder."""
    base = folder.rstrip("/")
    return (path.startswith(base + "/") | (path == base)) & ~path.rlike(r"(^|/)\.\.(/|$)")


def bounded(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def best_of(*texts: Column) -> Column:
    """The first text of several converters that is not null."""
    return F.coalesce(*texts)
