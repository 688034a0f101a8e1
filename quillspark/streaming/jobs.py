"""Structured Streaming: job states, overlapping windows, pauses, growing pair counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.entities import entities, pair_counts
from ..operators.knowledge import cooccurrence_edges

WATERMARK = "10 seconds"


def window_counts(events: DataFrame, length: str = "4 seconds", step: str = "3 seconds", by: list[str] | None = None, late: str = WATERMARK) -> DataFrame:
    """Events in overlapping windows; rows later than ``late`` are dropped from open windows' state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, step), *(by or [])).agg(F.count("*").alias("n")).select("window.start", "window.end", *(by or []), "n")


def spoken_spells(levels: DataFrame, least: float = 20.0, silence: str = "2 seconds", late: str = WATERMARK) -> DataFrame:
    """Spells of sound of each stream: levels above ``least`` no more than ``silence`` apart."""
    loud = levels.where(F.col("level") > least).withWatermark("ts", late)
    return loud.groupBy("stream_id", F.session_window("ts", silence)).agg(F.count("*").alias("n")).select("stream_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def latest_status(updates: DataFrame) -> DataFrame:
    """job_id with its last status (by ts); complete or update mode."""
    return updates.groupBy("job_id").agg(F.max(F.struct("ts", "status")).alias("m")).select("job_id", F.col("m.status").alias("status"), F.col("m.ts").alias("ts"))


def live_jobs(updates: DataFrame, keep: str = "24 hours") -> DataFrame:
    """Last status of jobs heard of within ``keep``: state older than that goes."""
    return updates.withWatermark("ts", keep).groupBy("job_id", F.session_window("ts", keep)).agg(F.max(F.struct("ts", "status")).alias("m")).select("job_id", F.col("m.status").alias("status"), F.col("m.ts").alias("ts"))


def dispatched(tasks: DataFrame, handlers: dict[str, Callable[[DataFrame], None]], checkpoint: str):
    """Starts a query that hands the rows of each micro-batch to the handler of their
    task_name; unknown names are left out."""
    def each(batch: DataFrame, epoch: int) -> None:
        for name, handle in handlers.items():
            handle(batch.where(F.col("task_name") == name))

    return tasks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: States of a job in order; the last three end it.
STATES = ["queued", "crawling", "extracting", "partitioning", "embedding", "storing", "completed", "failed", "cancelled"]
ENDED = ["completed", "failed", "cancelled"]


def status_fields(updates: DataFrame) -> DataFrame:
    """job_id and, of every other field, its last value that was given (by ts): a null changes nothing."""
    fields = [c for c in updates.columns if c not in ("job_id", "ts")]
    return updates.groupBy("job_id").agg(F.max("ts").alias("ts"), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in fields))


def transitions(updates: DataFrame) -> DataFrame:
    """job_id, ts, status, before, valid: whether a known state follows one that has not ended (batch)."""
    from pyspark.sql.window import Window

    rows = updates.withColumn("before", F.lag("status").over(Window.partitionBy("job_id").orderBy("ts")))
    return rows.select("job_id", "ts", "status", "before", (F.col("status").isin(*STATES) & ~F.coalesce(F.col("before").isin(*ENDED), F.lit(False))).alias("valid"))


#: What becomes of an update: it is the job's new state; the state is not known; the job has
#: ended; a later update has been taken before.
TAKEN, UNKNOWN, AFTER_END, LATE = "taken", "unknown", "after end", "late"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobSteps(StatefulProcessor):
    """Keeps the last state of every job and judges each update against it."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "status string, ts timestamp", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get()
        status, at = (held[0], pd.Timestamp(held[1])) if held is not None else (None, None)
        for part in [pd.concat(rows)]:  # the updates of one job in one batch
            out = []
            for ts, new in part.sort_values(["ts", "status"], kind="stable")[["ts", "status"]].itertuples(index=False):
                verdict = UNKNOWN if new not in STATES else LATE if at is not None and ts < at else AFTER_END if status in ENDED else TAKEN
                out.append((key[0], ts, new, status, verdict))
                if verdict == TAKEN:
                    status, at = new, ts
            if any(o[4] == TAKEN for o in out):
                self.last.update((status, at))
            yield pd.DataFrame(out, columns=["job_id", "ts", "status", "before", "verdict"])

    def close(self) -> None:
        pass


def job_steps(updates: DataFrame, keep_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """job_id, ts, status, before, verdict of every update (job_id, ts, status) of a stream.

    ``before`` is the job's state so far; a known state is taken unless the job has ended or a
    later update was taken.  State lives in the state store (the session must use ``STATE_STORE``)
    and goes when a job has not been heard of for ``keep_ms``; then its id begins anew.  As
    state expires by the clock, a trigger of all that is available never ends; one batch or an interval does.
    """
    if updates.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != STATE_STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STATE_STORE}")
    return updates.select("job_id", "ts", "status").groupBy("job_id").transformWithStateInPandas(JobSteps(keep_ms), "job_id string, ts timestamp, status string, before string, verdict string", outputMode="Update", timeMode="ProcessingTime")


# --- a graph that grows ----------------------------------------------------------------------------

def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def epoch_ranges(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """Ranges (first, last) of epochs whose counts are at ``path``, whole folders only; one that
    lies within another has been merged into it and counts no more."""
    at, fs = _folder(spark, path)
    if not fs.exists(at):
        return []
    found = []
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if name.startswith("epochs=") and fs.exists(_folder(spark, f"{path}/{name}/_SUCCESS")[0]):
            first, last = name.removeprefix("epochs=").split("-")
            found.append((int(first), int(last)))
    out: list[tuple[int, int]] = []
    for first, last in sorted(found, key=lambda r: (r[0], -r[1])):
        if not out or last > out[-1][1]:
            out.append((first, last))
    return out


def _summed(spark: SparkSession, path: str, ranges: list[tuple[int, int]]) -> DataFrame:
    rows = spark.read.parquet(*(f"{path}/epochs={a}-{b}" for a, b in ranges))
    return rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def merged_pairs(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, weight over all epochs that ``growing_pairs`` has written."""
    return _summed(spark, path, epoch_ranges(spark, path))


def growing_pairs(texts: DataFrame, path: str, checkpoint: str, typed: bool = False):
    """Starts a query that adds every micro-batch's entity pairs (of structs of name and type
    if ``typed``) to a table of counts.

    Each epoch is a folder; the last two are merged while the older holds no more epochs than
    the newer, so n epochs are log2(n) folders and a count is rewritten log2(n) times.  An epoch
    that is run again replaces its own folder, or lies within one that holds it already; a
    merge that breaks off leaves the folders it was made of.
    """
    def each(batch: DataFrame, epoch: int) -> None:
        spark, found = batch.sparkSession, entities(batch)
        pairs = cooccurrence_edges(found).select("src", "dst", F.col("weight").cast("long").alias("weight")) if typed else pair_counts(found)
        if not any(a <= epoch <= b for a, b in epoch_ranges(spark, path) if a < b):
            pairs.write.mode("overwrite").parquet(f"{path}/epochs={epoch}-{epoch}")
        while len(ranges := epoch_ranges(spark, path)) > 1:
            (a, b), (c, d) = ranges[-2:]
            if b - a > d - c:
                break
            _summed(spark, path, [(a, b), (c, d)]).write.mode("overwrite").parquet(f"{path}/epochs={a}-{d}")
            for old in ((a, b), (c, d)):
                at, fs = _folder(spark, f"{path}/epochs={old[0]}-{old[1]}")
                fs.delete(at, True)

    return texts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
