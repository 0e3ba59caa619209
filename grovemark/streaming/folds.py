"""Streaming forms of the event fold and of windowed counts; over a finished input each equals its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovemark.operators.curation import last_event


def fold_stream(events: DataFrame, name: str, checkpoint: str):
    """Runs the fold over a streaming DataFrame into the memory table `name`; state is one row per key."""
    return last_event(events).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", size: str = "1 hour", late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Events per tumbling window and kind; on a stream, windows older than the watermark are dropped from state."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, late) if events.isStreaming else timed
    return timed.groupBy(F.window(ts, size).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")
