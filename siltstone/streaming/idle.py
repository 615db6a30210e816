"""Sessions that have gone quiet, on streams of file events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDLE = "10 minutes"


def ready_sessions(events: DataFrame, key: str = "user_id", idle: str = IDLE, late: str = "30 minutes") -> DataFrame:
    """(key, start, end, events) of runs of events with no gap of `idle`; on a stream a run is emitted once the watermark has passed its end, so the last ones wait for later events. The same expression serves a batch."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(key, F.session_window("ts", idle).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def only_new(ready: DataFrame, processed: DataFrame, key: str = "session_id") -> DataFrame:
    """Ready sessions that were not processed before: a stream-static join."""
    return ready.join(processed.select(key), key, "left_anti") if not ready.isStreaming else ready.join(processed.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_outer").filter("_k is null").drop("_k")


def run(ready: DataFrame, handle, checkpoint: str, trigger: dict | None = None):
    """Start a query that hands each batch of ready sessions to handle(df, epoch)."""
    return ready.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(handle).trigger(**(trigger or {"availableNow": True})).start()
