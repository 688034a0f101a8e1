"""Small rules over rows: which are taken, and how settings and sizes come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def is_video(processing_type: Column, file_type: Column) -> Column:
    return F.coalesce((processing_type == "video") | (F.lower(file_type) == "mp4"), F.lit(False))


def large_enough(width: Column, height: Column, least: int = 50) -> Column:
    """Images small on either side are left out."""
    return F.coalesce((width >= least) & (height >= least), F.lit(False))


def clip_range(start: Column, end: Column) -> Column:
    return F.coalesce(start < end, F.lit(False))


def clip_key(video_id: Column, index: Column) -> Column:
    return F.concat(video_id, F.lit("/"), index.cast("string"), F.lit(".mp4"))


def present(frames: Column) -> Column:
    """Frames that are there."""
    return F.filter(frames, lambda f: f.isNotNull())


def distinct_scales(scales: Column) -> Column:
    """Scale factors without repeats, in their order."""
    return F.array_distinct(scales)


def resized(width: Column, height: Column, longest: int, truncated: bool = False) -> Column:
    """struct<width,height> with the longer side at most ``longest``, sides rounded half to
    even (as for text recognition) or ``truncated`` (as for the vision model)."""
    scale = F.least(F.lit(1.0), F.lit(longest) / F.greatest(width, height))
    whole = lambda x: (x if truncated else F.bround(x)).cast("int")
    return F.struct(whole(width * scale).alias("width"), whole(height * scale).alias("height"))


def minute_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmm")


def reply_text(plain: Column, parts: Column) -> Column:
    """A reply's text: the plain one, else its parts joined."""
    return F.coalesce(plain, F.array_join(parts, ""), F.lit(""))


def with_fallback_agent(jobs: DataFrame, agents: DataFrame, kind: str = "translation") -> DataFrame:
    """Jobs (user_id, agent_id) with chosen_agent: the given one of the user's, else the first of ``kind``."""
    own = agents.select(F.col("id").alias("__a"), F.col("owner_id").alias("__o"))
    first = agents.where(F.col("agent_type") == kind).withColumn("r", F.row_number().over(Window.partitionBy("owner_id").orderBy("id"))).where("r = 1").select(F.col("owner_id").alias("user_id"), F.col("id").alias("__first"))
    out = jobs.join(own, (F.col("agent_id") == F.col("__a")) & (F.col("user_id") == F.col("__o")), "left").join(first, "user_id", "left")
    return out.withColumn("chosen_agent", F.coalesce("__a", "__first")).select(*jobs.columns, "chosen_agent")


def merged_settings(defaults: dict, given: dict) -> dict:
    """Nested settings: given values replace defaults, dictionaries are merged."""
    out = dict(defaults)
    for k, v in given.items():
        out[k] = merged_settings(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def prompt_library(given: dict, defaults: dict[str, str]) -> dict[str, str]:
    """The given prompts if all are strings, else the defaults."""
    return dict(given) if given and all(isinstance(v, str) for v in given.values()) else dict(defaults)


def handler_of(name: str, known: dict[str, Callable], fallback: Callable) -> Callable:
    """The registered handler, or one that does nothing in its place."""
    return known.get(name, fallback)
