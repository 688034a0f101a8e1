from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import rules


def test_rules(spark):
    rows = spark.createDataFrame([("document", "MP4", 49, 100, 2.0, 1.0, None, ["a", "b"])], "p string, f string, w int, h int, s double, e double, t string, parts array<string>")
    got = rows.select(
        rules.is_video(F.col("p"), F.col("f")).alias("v"), rules.large_enough(F.col("w"), F.col("h")).alias("l"), rules.clip_range(F.col("s"), F.col("e")).alias("c"), rules.reply_text(F.col("t"), F.col("parts")).alias("r"),
        rules.resized(F.col("w"), F.col("h"), 50).alias("z"), rules.distinct_scales(F.array(F.lit(1.0), F.lit(1.5), F.lit(1.0))).alias("d"), rules.clip_key(F.lit("vid"), F.lit(0)).alias("k"), rules.is_video(F.lit(None), F.lit(None)).alias("n"),
    ).first()
    assert (got.v, got.l, got.c, got.r, got.d, got.k, got.n) == (True, False, False, "ab", [1.0, 1.5], "vid/0.mp4", False)
    assert (got.z.width, got.z.height) == (24, 50)


def test_fallback_agents(spark):
    agents = spark.createDataFrame([(1, 7, "rag"), (2, 7, "translation"), (3, 7, "translation"), (4, 8, "rag")], "id long, owner_id long, agent_type string")
    jobs = spark.createDataFrame([(7, 1), (7, None), (7, 4), (8, None)], "user_id long, agent_id long")
    got = sorted((r.user_id, r.agent_id or 0, r.chosen_agent) for r in rules.with_fallback_agent(jobs, agents).collect())
    assert got == [(7, 0, 2), (7, 1, 1), (7, 4, 2), (8, 0, None)]


def test_settings():
    assert rules.merged_settings({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"b": 3}, "e": 4}) == {"a": {"b": 3, "c": 2}, "d": 1, "e": 4}
    assert rules.prompt_library({"x": 1}, {"p": "q"}) == {"p": "q"} and rules.prompt_library({"x": "y"}, {"p": "q"}) == {"x": "y"}
    assert rules.handler_of("a", {"b": print}, len) is len
