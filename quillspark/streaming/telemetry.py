"""Figures of a run, counted while it runs: rows, errors and durations of each stage.

``Run`` hangs an ``Observation`` on what a stage writes, so its counts come from the same
scan that does the work.  ``Progress`` gathers what streaming queries report of themselves.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = "stage string, ok boolean, error string, started double, seconds double, rows long, figures map<string,double>"


@dataclass
class Run:
    """Stages of one run in the order in which they were written."""

    spark: SparkSession
    stages: list[tuple] = field(default_factory=list)

    def written(self, stage: str, df: DataFrame, path: str, **figures: Column) -> DataFrame:
        """Writes ``df`` as Parquet to ``path`` and reads it again; notes its rows, its time and
        ``figures`` (aggregates over its columns).  A failure is noted and raised."""
        seen = Observation(f"{stage}-{len(self.stages)}")
        watched = df.observe(seen, F.count(F.lit(1)).alias("__rows"), *(c.cast("double").alias(n) for n, c in figures.items()))
        began = time.time()
        try:
            watched.write.parquet(path)
        except Exception as e:
            self.stages.append((stage, False, str(e).split("\n", 1)[0][:500], began, time.time() - began, None, {}))
            raise
        got = dict(seen.get)
        self.stages.append((stage, True, None, began, time.time() - began, got.pop("__rows"), {n: None if x is None else float(x) for n, x in got.items()}))
        return self.spark.read.schema(df.schema).parquet(path)

    def report(self) -> DataFrame:
        """stage, ok, error, started, seconds, rows, figures: a row for each stage written."""
        return self.spark.createDataFrame(self.stages, SCHEMA)


class Progress(StreamingQueryListener):
    """Batches of streaming queries (name, batch, rows read, milliseconds), as they are reported."""

    def __init__(self) -> None:
        self.batches: list[tuple[str | None, int, int, int]] = []
        self.ended: list[str | None] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append((p.name, p.batchId, p.numInputRows, p.durationMs.get("triggerExecution", 0)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append(event.exception)
