"""Stateful stream operators: rate limits whose rejected hits don't count, and duplicate events."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECISION = "key string, event_id long, at double, allowed boolean"


def admit(history: list[float], at: float, limit: int, window: float) -> tuple[bool, list[float]]:
    """Whether a request at a time is within the limit, and the admitted times of the window after it."""
    live = [t for t in history if t > at - window]
    return (True, [*live, at]) if len(live) < limit else (False, live)


def limit_stream(requests: DataFrame, *, limit: int, window: float = 60.0, delay: float = 600.0) -> DataFrame:
    """Decisions over a stream of (key, event_id, at seconds): at most ``limit`` admitted requests of a key per window.

    Requests of a key in one batch are taken in order of time, then id; a
    state holds at most ``limit`` times, and goes once the watermark, ``delay``
    seconds behind the newest request, has passed its last window.  Times are
    seconds from the epoch on; requests from before the watermark are dropped.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        history = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        allowed = []
        for at in rows["at"]:
            ok, history = admit(history, float(at), limit, window)
            allowed.append(ok)
        state.update((history,))
        if history:
            state.setTimeoutTimestamp(max(int(1000 * (history[-1] + 1 + window)), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "event_id": rows["event_id"], "at": rows["at"], "allowed": allowed})

    timed = requests.select("key", "event_id", "at", F.timestamp_seconds(F.col("at") + 1).alias("ts")).withWatermark("ts", f"{delay} seconds")
    return timed.groupBy("key").applyInPandasWithState(run, DECISION, "history array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def _decide(batches: Iterator[pa.RecordBatch], limit: int, window: float) -> Iterator[pa.RecordBatch]:
    current, live = object(), deque()
    for batch in batches:
        keys, times = batch.column("key").to_pylist(), batch.column("at").to_pylist()
        allowed = []
        for key, at in zip(keys, times, strict=True):
            if key != current:
                current, live = key, deque()
            while live and live[0] <= at - window:
                live.popleft()
            allowed.append(len(live) < limit)
            if allowed[-1]:
                live.append(at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.bool_())], names=[*batch.schema.names, "allowed"])


def limit_batch(requests: DataFrame, *, limit: int, window: float = 60.0) -> DataFrame:
    """The same decisions over a table: a pass over each task's requests in order of key, time and id, holding one key's window."""
    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.col("at").cast("double").alias("at"))
    return rows.repartition("key").sortWithinPartitions("key", "at", "event_id").mapInArrow(lambda it: _decide(it, limit, window), DECISION)


def distinct_events(events: DataFrame, *, delay: str = "10 minutes") -> DataFrame:
    """Events (event_id, observed_at) without repeats of an id within the watermark delay."""
    return events.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def drain(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Run a stream over what is there and write the result as Parquet."""
    query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
