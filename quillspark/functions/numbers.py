"""Arithmetic of boxes, times and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou_corners(a: Column, b: Column) -> Column:
    """Overlap share of boxes struct<x1,y1,x2,y2>; 0 if the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda r: F.greatest(F.lit(0.0), r["x2"] - r["x1"]) * F.greatest(F.lit(0.0), r["y2"] - r["y1"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def corners(box: Column) -> Column:
    """struct<x1,y1,x2,y2> of struct<x,y,w,h>."""
    return F.struct(box["x"].cast("double").alias("x1"), box["y"].cast("double").alias("y1"), (box["x"] + box["w"]).cast("double").alias("x2"), (box["y"] + box["h"]).cast("double").alias("y2"))


def iou_sized(a: Column, b: Column) -> Column:
    return iou_corners(corners(a), corners(b))


def around(polygon: Column) -> Column:
    """The upright box around array<array<double>> points."""
    at = lambda i: F.transform(polygon, lambda p: p[i])
    return F.struct(F.array_min(at(0)).alias("x1"), F.array_min(at(1)).alias("y1"), F.array_max(at(0)).alias("x2"), F.array_max(at(1)).alias("y2"))


def page_fractions(l: Column, t: Column, r: Column, b: Column, width: Column, height: Column) -> Column:  # noqa: E741
    """A box as shares of its page, clamped, whichever way round its sides come; 595 x 842 without a page size."""
    w, h = F.coalesce(F.nullif(width, F.lit(0.0)), F.lit(595.0)), F.coalesce(F.nullif(height, F.lit(0.0)), F.lit(842.0))
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.struct(clamp(F.least(l, r) / w).alias("left"), clamp(F.least(t, b) / h).alias("top"), clamp(F.abs(r - l) / w).alias("width"), clamp(F.abs(b - t) / h).alias("height"))


#: Growth of a text from which its font shrinks, the most that is kept, and the smallest size.
FONT_RULES = {"docx": (1.3, 0.85, 8.0), "table": (1.2, 0.8, 7.0), "pptx": (1.15, 0.75, 10.0)}


def scaled_font(size: Column, old: Column, new: Column, kind: str) -> Column:
    ratio, cap, floor = FONT_RULES[kind]
    smaller = F.greatest(size * F.least(F.length(old) / F.greatest(F.length(new), F.lit(1)), F.lit(cap)), F.lit(floor))
    return F.when((F.length(old) > 0) & (F.length(new) > ratio * F.length(old)), smaller).otherwise(size)


def progress(done: Column, total: Column, base: int = 40, span: int = 30) -> Column:
    return F.when(total > 0, base + (done / total * span).cast("int")).otherwise(F.lit(base))


def k_per_collection(k: int, collections: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.lit(k) / collections)).cast("int")


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def srt_time(seconds: Column) -> Column:
    ms = F.bround(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def biased_times(start: Column, end: Column, n: int) -> Column:
    """n sorted instants of [start, end]: up to two each in the first and last quarter, the rest between."""
    edge = min(2, n // 4)
    middle = n - 2 * edge
    span = end - start
    spread = lambda k, lo, hi: [lo + (hi - lo) * (i + 1) / (k + 1) for i in range(k)]
    shares = spread(edge, 0.0, 0.25) + spread(middle, 0.25, 0.75) + spread(edge, 0.75, 1.0)
    return F.when(span > 0, F.array_sort(F.array(*(start + span * F.lit(s) for s in shares)))).otherwise(F.array().cast("array<double>"))


def chunk_hash(video: Column, start: Column, end: Column, policy: Column, frames: Column, model: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("|", video, F.format_string("%.6f", start), F.format_string("%.6f", end), policy, frames.cast("string"), model, prompt), 256)


def uuid5(name: Column, namespace: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """Version 5 UUID of a name (the DNS namespace unless told otherwise)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*(F.lit(x) for x in "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null if a vector is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def frame_index(t: Column, fps: Column) -> Column:
    """The frame at a time, halves to even."""
    return F.bround(t * fps).cast("long")


def frame_duration(frames: Column, fps: Column) -> Column:
    """Seconds of a video; 0 without a rate."""
    return F.when(fps > 0, frames / fps).otherwise(F.lit(0.0))
