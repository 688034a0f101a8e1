"""Time windows of videos, tracks of boxes and text found in frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import biased_times, iou_corners, iou_sized
from ..functions.text import collapse
from ..sources.tables import numbered
from .graph import roots

SEGMENT, OVERLAP, FRAMES = 4.0, 1.0, 10
IOU_FROM = 0.4


def windows(videos: DataFrame, segment: float = SEGMENT, overlap: float = OVERLAP) -> DataFrame:
    """segment_idx, t_start, t_end of overlapping windows over (video_id, duration)."""
    step = segment - overlap
    count = F.when(F.col("duration") > 0, F.ceil(F.col("duration") / step).cast("int")).otherwise(F.lit(0))
    rows = videos.select("video_id", "duration", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))).alias("segment_idx"))
    return rows.select("video_id", "segment_idx", (F.col("segment_idx") * step).alias("t_start"), F.least(F.col("segment_idx") * step + segment, "duration").alias("t_end"))


def sampled(segments: DataFrame, frames: int = FRAMES) -> DataFrame:
    """Adds frame_times; 8 to 12 of them."""
    return segments.withColumn("frame_times", biased_times(F.col("t_start"), F.col("t_end"), max(8, min(12, frames))))


def track_summary(tracks: DataFrame) -> DataFrame:
    """first_seen, last_seen, frames and the first and last box of tracks with boxes array<struct<t,x,y,w,h>>."""
    t = F.transform("boxes", lambda b: b["t"])
    keyed = F.transform("boxes", lambda b, i: F.struct(b["t"].alias("t"), i.alias("i"), b.alias("b")))
    late = F.transform("boxes", lambda b, i: F.struct(b["t"].alias("t"), (-i).alias("i"), b.alias("b")))
    return tracks.withColumns({"first_seen": F.array_min(t), "last_seen": F.array_max(t), "frames": F.size("boxes"), "first_box": F.array_min(keyed)["b"], "last_box": F.array_max(late)["b"]})


def matches(tracks: DataFrame, threshold: float = IOU_FROM) -> DataFrame:
    """video_id, segment_idx, seq, old_seq: which track of the segment before a track goes on.

    In the order of ``seq``, a track takes the still unclaimed track of the segment before whose
    last box overlaps its first the most, from ``threshold`` on.  Only the two segments count,
    so every pair of segments is settled by itself: a fold over the offers within one row.
    """
    ends = track_summary(tracks).select("video_id", "segment_idx", F.col("seq").cast("long").alias("seq"), "first_box", "last_box")
    before = ends.select("video_id", (F.col("segment_idx") + 1).alias("segment_idx"), F.col("seq").alias("old_seq"), F.col("last_box").alias("old_box"))
    near = ends.join(before, ["video_id", "segment_idx"]).select("video_id", "segment_idx", "seq", "old_seq", iou_sized(F.col("first_box"), F.col("old_box")).alias("iou")).where(F.col("iou") >= threshold)
    offers = F.array_sort(F.collect_list(F.struct("seq", (-F.col("iou")).alias("less"), "old_seq")))  # by track, the best offer first
    taken = near.groupBy("video_id", "segment_idx").agg(offers.alias("offers"))

    def claim(done: Column, offer: Column) -> Column:
        late = F.exists(done, lambda d: (d["seq"] == offer["seq"]) | (d["old_seq"] == offer["old_seq"]))
        return F.when(late, done).otherwise(F.array_append(done, F.struct(offer["seq"].alias("seq"), offer["old_seq"].alias("old_seq"))))

    pairs = F.aggregate("offers", F.array().cast("array<struct<seq:bigint,old_seq:bigint>>"), claim)
    return taken.select("video_id", "segment_idx", F.inline(pairs))


def fused(tracks: DataFrame, threshold: float = IOU_FROM) -> DataFrame:
    """Adds global_id (G001, …) to tracks (video_id, segment_idx, seq, track_id, boxes), which
    are known by video, segment and seq.

    A track that goes on one of the segment before (see ``matches``) has its id; the others are
    heads of chains and are numbered in each video by segment and seq.  Chains are followed by pointer doubling
    (see ``graph.roots``), so no video needs a task of its own.
    """
    key = ["video_id", "segment_idx", "seq"]
    node = F.struct(*key)
    found = matches(tracks, threshold)
    ends = roots(found.select(node.alias("node"), F.struct("video_id", (F.col("segment_idx") - 1).alias("segment_idx"), F.col("old_seq").alias("seq")).alias("to")))
    every = tracks.select("video_id", "segment_idx", F.col("seq").cast("long").alias("seq"), "track_id")
    placed = every.join(ends.select("node.*", "root"), key, "left")
    heads = numbered(placed.where("root is null").select(*key), ["video_id"], ["segment_idx", "seq"], "number")
    number = heads.select(node.alias("root"), "number")
    return placed.withColumn("root", F.coalesce("root", node)).join(number, "root").select(*key, "track_id", F.format_string("G%03d", "number").alias("global_id"))


def kept_hits(hits: Column, merge: float = 0.35, least: float = 0.0) -> Column:
    """array<struct<text,conf,x1,y1,x2,y2>> after suppression: the most confident first,
    one goes if a kept one overlaps it by ``merge``, or by 0.6 of it with the same text."""
    good = F.filter(hits, lambda h: h["text"].isNotNull() & (collapse(h["text"]) != "") & (h["conf"] >= least))
    ordered = F.array_sort(F.transform(good, lambda h, i: F.struct((-h["conf"]).alias("less"), i.alias("i"), h.alias("h"))))
    same = lambda a, b: F.lower(collapse(a["text"])) == F.lower(collapse(b["text"]))

    def fold(kept: Column, e: Column) -> Column:
        clash = F.exists(kept, lambda k: (iou_corners(k, e["h"]) >= merge) | (same(k, e["h"]) & (iou_corners(k, e["h"]) >= 0.6 * merge)))
        return F.when(clash, kept).otherwise(F.array_append(kept, e["h"]))

    return F.aggregate(ordered, F.filter(hits, lambda h: F.lit(False)), fold)


def read_order(hits: Column, most: int = 200) -> Column:
    """The ``most`` confident hits, from top to bottom and left to right."""
    top = F.slice(F.array_sort(F.transform(hits, lambda h, i: F.struct((-h["conf"]).alias("less"), i.alias("i"), h.alias("h")))), 1, most)
    placed = F.array_sort(F.transform(top, lambda r: F.struct(((r["h"]["y1"] + r["h"]["y2"]) / 2).alias("y"), ((r["h"]["x1"] + r["h"]["x2"]) / 2).alias("x"), r["i"].alias("i"), r["h"].alias("h"))))
    return F.transform(placed, lambda r: r["h"])


def blob_tracks(blobs: DataFrame, most: int = 5, least: int = 500) -> DataFrame:
    """T01, … for the ``most`` largest boxes (w * h >= ``least``) of every frame (video_id, t, x, y, w, h)."""
    area = F.col("w") * F.col("h")
    boxes = F.slice(F.array_sort(F.collect_list(F.struct((-area).alias("less"), "x", "y", "w", "h"))), 1, most)
    ranked = blobs.where(area >= least).groupBy("video_id", "t").agg(boxes.alias("b")).select("video_id", "t", F.posexplode("b").alias("i", "b"))
    return ranked.select("video_id", "t", F.format_string("T%02d", F.col("i") + 1).alias("track_id"), "b.x", "b.y", "b.w", "b.h")


def tracks_of(detections: DataFrame) -> DataFrame:
    """Detections (video_id, track_id, frame, t, label, cx, cy, w, h) to tracks: the last
    box of an instant counts, boxes in order of time, the last label."""
    box = F.struct("t", F.greatest(F.lit(0), (F.col("cx") - F.col("w") / 2).cast("int")).alias("x"), F.greatest(F.lit(0), (F.col("cy") - F.col("h") / 2).cast("int")).alias("y"), F.greatest(F.lit(1), F.col("w").cast("int")).alias("w"), F.greatest(F.lit(1), F.col("h").cast("int")).alias("h"))
    each = detections.withColumn("box", box).groupBy("video_id", "track_id", "t").agg(F.max(F.struct("frame", "box", "label")).alias("m"))
    return each.groupBy("video_id", "track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", F.col("m.box").alias("b")))), lambda x: x["b"]).alias("boxes"), F.max(F.struct("m.frame", "m.label"))["label"].alias("label"))


def boxes_at(frames: DataFrame, boxes: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """The first box of every track within ``tolerance`` seconds of every frame: an
    equi-join on time slots twice as wide, then the exact band."""
    slot = lambda t: F.floor(t / (2 * tolerance))
    left = frames.withColumn("slot", F.explode(F.array(slot(F.col("frame_t")) - 1, slot(F.col("frame_t")), slot(F.col("frame_t")) + 1)))
    both = left.join(boxes.withColumn("slot", slot(F.col("t"))), ["video_id", "slot"]).where(F.abs(F.col("t") - F.col("frame_t")) <= tolerance + 1e-9)
    return both.groupBy("video_id", "frame_t", "track_id").agg(F.min(F.struct("t", "x", "y", "w", "h")).alias("b")).select("video_id", "frame_t", "track_id", "b.*")


def index_text(caption: Column, events: Column, entities: Column, transcript: Column, ocr: Column) -> Column:
    """The parts that are not blank, a line each (events and entities are arrays of JSON strings)."""
    lines = F.filter(F.split(F.coalesce(ocr, F.lit("")), "\n"), lambda s: ~F.contains(s, F.lit("(none)")) & ~F.contains(s, F.lit("(error:")))
    parts = F.concat(F.array(caption), F.coalesce(events, F.array().cast("array<string>")), F.coalesce(entities, F.array().cast("array<string>")), F.array(transcript, F.array_join(lines, "\n")))
    joined = F.array_join(F.filter(parts, lambda s: s.isNotNull() & s.rlike(r"(?U)\S")), "\n")
    return F.when(joined == "", "(no content)").otherwise(joined)


def stub_caption(video: Column, start: Column, end: Column, frames: Column) -> Column:
    """What the offline vision model says of a segment."""
    return F.format_string("Segment of %s from %.1fs to %.1fs in %d frames.", video, start, end, frames)
