"""States of jobs on a stream: order, refusals, expiry and restarts."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from quillspark.operators import entities, knowledge
from quillspark.streaming import jobs


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, jobs.STATE_STORE)
    yield spark
    spark.conf.set(key, before)


class Feed:
    """A folder that a stream reads: each batch is a file and a run of the query from its checkpoint."""

    def __init__(self, spark, folder, keep_ms=24 * 3600 * 1000):
        self.spark, self.folder, self.keep_ms, self.n = spark, folder, keep_ms, 0

    def run(self, rows):
        """Verdicts of one batch, by a query that is started anew."""
        self.n += 1
        batch = self.spark.createDataFrame([(j, float(t), s) for j, t, s in rows], "job_id string, t double, status string").select("job_id", F.timestamp_seconds("t").alias("ts"), "status")
        batch.coalesce(1).write.mode("append").parquet(f"file://{self.folder}/in")
        out = f"file://{self.folder}/out{self.n}"
        source = self.spark.readStream.schema(batch.schema).parquet(f"file://{self.folder}/in")
        each = lambda df, _: df.withColumn("t", F.unix_seconds("ts")).write.mode("append").parquet(out)
        q = jobs.job_steps(source, self.keep_ms).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"file://{self.folder}/ck").trigger(once=True).start()
        assert q.awaitTermination(60)
        return sorted((r.job_id, r.t, r.status, r.before, r.verdict) for r in self.spark.read.parquet(out).collect())


def test_job_steps_over_batches_and_restarts(rocks, tmp_path):
    feed = Feed(rocks, tmp_path)
    assert feed.run([("a", 2, "crawling"), ("a", 1, "queued"), ("b", 1, "queued"), ("b", 2, "dancing")]) == [
        ("a", 1, "queued", None, "taken"), ("a", 2, "crawling", "queued", "taken"), ("b", 1, "queued", None, "taken"), ("b", 2, "dancing", "queued", "unknown")]
    assert feed.run([("a", 1.5, "extracting"), ("a", 5, "completed"), ("a", 6, "storing"), ("b", 3, "failed")]) == [
        ("a", 1, "extracting", "crawling", "late"), ("a", 5, "completed", "crawling", "taken"), ("a", 6, "storing", "completed", "after end"), ("b", 3, "failed", "queued", "taken")]
    assert feed.run([("b", 9, "queued"), ("c", 1, "queued")]) == [("b", 9, "queued", "failed", "after end"), ("c", 1, "queued", None, "taken")]


def test_job_steps_expire(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, keep_ms=2000)
    assert feed.run([("a", 5, "completed")])[0][4] == "taken"
    time.sleep(4)
    assert feed.run([("a", 1, "queued")]) == [("a", 1, "queued", None, "taken")]


def test_job_steps_need_a_store_that_expires(spark):
    source = spark.readStream.format("rate").load().select(F.lit("a").alias("job_id"), F.col("timestamp").alias("ts"), F.lit("queued").alias("status"))
    with pytest.raises(ValueError, match="RocksDB"):
        jobs.job_steps(source)


@pytest.mark.parametrize("typed", [False, True])
def test_a_graph_grows_by_batches(spark, tmp_path, typed):
    """Thirteen batches equal one build, in a few folders; an epoch run again counts once."""
    names = ["NASA", "IBM", "ESA", "John Smith", "Acme Corp", "Paris, TX"]
    rows = [(i, " met ".join(names[(i * k) % 6] for k in (1, 2, 5)) + ".") for i in range(26)]
    for i in range(13):
        part = spark.createDataFrame(rows[2 * i:2 * i + 2], "doc_id long, text string")
        part.coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
    at = f"file://{tmp_path}/pairs"
    source = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    jobs.growing_pairs(source, at, f"file://{tmp_path}/ck", typed).awaitTermination()
    found = entities.entities(spark.createDataFrame(rows, "doc_id long, text string"))
    want = knowledge.cooccurrence_edges(found) if typed else entities.pair_counts(found)
    of = lambda df: sorted((str(r.src), str(r.dst), int(r.weight)) for r in df.collect())
    assert of(jobs.merged_pairs(spark, at)) == of(want)
    assert jobs.epoch_ranges(spark, at) == [(0, 7), (8, 11), (12, 12)]
    # left by a merge that broke off, and by an epoch that was run again: both lie within a larger range
    spark.read.parquet(f"{at}/epochs=8-11").write.parquet(f"{at}/epochs=9-10")
    assert of(jobs.merged_pairs(spark, at)) == of(want)
