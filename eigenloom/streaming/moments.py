"""Moments of a stream of vectors: each micro-batch is reduced and merged once.

A batch's state is written under its number and read back for the total, so a
batch that is run again after a failure replaces itself (exactly once). Merging
is commutative, so late rows need no watermark. States are one small row a
source and batch.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenloom.operators.moments import Moments, collect_moments
from eigenloom.session import path_exists

_STATE = "source string, n long, mean array<double>, m2 array<double>"


class MomentStream:
    """Keeps moments by source in a folder of shared storage."""

    def __init__(self, spark: SparkSession, folder: str, vector: str, source: str | None = None):
        self.spark, self.folder, self.vector, self.source = spark, folder.rstrip("/"), vector, source

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        rows = [(k, m.n, m.mean.tolist(), m.m2.ravel().tolist()) for k, m in collect_moments(batch, self.vector, self.source).items()]
        self.spark.createDataFrame(rows, _STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def moments(self) -> dict[str, Moments]:
        """All batches merged, in order of their numbers."""
        if not path_exists(self.spark, self.folder):
            return {}
        out: dict[str, Moments] = {}
        for r in self.spark.read.schema(_STATE + ", batch long").parquet(self.folder).orderBy("batch").collect():
            d = len(r.mean)
            m = Moments(r.n, np.array(r.mean), np.array(r.m2).reshape(d, d))
            out[r.source] = out[r.source].merge(m) if r.source in out else m
        return out


def event_windows(events: DataFrame, *, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(window start, event_type, n, mean, m2) of a stream or table of events: scalar moments by tumbling window, late rows within ``delay``."""
    timed = events.withWatermark("ts", delay) if events.isStreaming else events
    grouped = timed.groupBy(F.window("ts", window).alias("w"), "event_type")
    sums = grouped.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("v"))
    return sums.select(F.col("w.start").alias("start"), "event_type", "n", "mean", (F.col("v") * F.col("n")).alias("m2"))


def moments_json(moments: dict[str, Moments]) -> str:
    """Counts and traces, for logs."""
    return json.dumps({k: {"n": m.n, "trace": float(np.trace(m.m2))} for k, m in moments.items()})
