"""Sessions that have gone quiet, found by the clock: a timer per session that every event resets, so that the last session of a stream comes out too, with no event after it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltstone.sources import fs

#: Milliseconds without an event after which a session is ready. Fixed value.
IDLE_MS = 10 * 60 * 1000
#: What a query of this module needs of its session: state that holds timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
READY = "{key} string, start timestamp, last timestamp, events long"


class Idle(StatefulProcessor):
    """Of each key: the first and the last event's time, how many there were, and one timer."""

    def __init__(self, idle_ms: int, key: str):
        self.idle_ms, self.key = idle_ms, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "start timestamp, last timestamp, events long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start = last = None
        events = 0
        if self.seen.exists():
            start, last, events = self.seen.get()
        for part in rows:
            times = part["ts"].dropna()
            events += len(part)
            if len(times):
                low, high = times.min().to_pydatetime(), times.max().to_pydatetime()
                start, last = min(x for x in (start, low) if x is not None), max(x for x in (last, high) if x is not None)
        self.seen.update((start, last, events))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, last, events = self.seen.get()
        self.seen.clear()
        yield pd.DataFrame({self.key: [key[0]], "start": [start], "last": [last], "events": [events]})

    def close(self) -> None:
        pass


def ready_sessions(events: DataFrame, key: str = "session_id", idle_ms: int = IDLE_MS) -> DataFrame:
    """(key, start, last, events) of a stream of events (key string, ts): a session comes out once no event of it has arrived for idle_ms, by the cluster's clock. Every event resets its session's timer; events that come after are a session of their own. Null times count as events."""
    rows = events.select(F.col(key).cast("string").alias(key), F.col("ts").cast("timestamp").alias("ts"))
    return rows.groupBy(key).transformWithStateInPandas(Idle(idle_ms, key), READY.format(key=key), "Append", "ProcessingTime")


class Processed:
    """Which sessions were handed on, under `path`: a folder a batch, written once per batch id, so that a batch that is run again changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, key: str = "session_id", before: int | None = None) -> DataFrame:
        """(key, start) of all batches, or of those before one."""
        names = [n for n in fs.names(self.spark, self.path) if n.startswith("batch=") and (before is None or int(n[6:]) < before)]
        schema = f"{key} string, start timestamp"
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def once(self, handle: Callable[[DataFrame, int], None], key: str = "session_id") -> Callable[[DataFrame, int], None]:
        """A function for foreachBatch that hands a batch's sessions on if no earlier batch has, and then records them."""

        def run(batch: DataFrame, number: int) -> None:
            batch = batch.persist()
            try:
                known = self.table(key, number)
                new = batch.join(known, (batch[key] == known[key]) & batch["start"].eqNullSafe(known["start"]), "left_anti")
                handle(new, number)
                new.select(key, "start").write.mode("overwrite").parquet(f"{self.path}/batch={number}")
            finally:
                batch.unpersist()

        return run


def run(ready: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str = "10 seconds"):
    """Start a query that hands ready sessions to handle(df, batch); the clock is looked at `every` so often."""
    return ready.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(handle).trigger(processingTime=every).start()
