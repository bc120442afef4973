"""Verification of shipments as they arrive, and windowed counts of events.

Both reuse the batch functions: a micro-batch of shipments is verified like any table, and events are counted in
event-time windows whose state is dropped behind the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import checks, verdict


def verify_stream(arrivals: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Scores of each micro-batch, in a Parquet folder of its own (written again if the batch is)."""

    def each(batch: DataFrame, number: int) -> None:
        scored = verdict.scores(verdict.facts(checks.prepare(batch)))
        scored.withColumn("risk", verdict.risk_level()).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their mean value by window and type; rows later than ``late`` are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("window.start").alias("start"), "event_type", "n", "mean_value")
