"""Keyframes of a stream: the gate of the batch operator with the last kept frame as state, by video."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def keyframes(frames: DataFrame, change: float, least: float, most: float) -> DataFrame:
    """Of frames (video, seconds, frame, signal) the kept ones with their frame_id. Frames of a batch are sorted; a frame that comes
    after a later one of an earlier batch is compared as it comes. State: one row of numbers a video."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, value, n = state.get if state.exists else (None, None, 0)
        kept = []
        for row in pd.concat(list(batches)).sort_values(["seconds", "frame"]).itertuples(index=False):
            gap = None if n == 0 else row.seconds - at
            if n == 0 or gap >= most or (gap >= least and abs(row.signal - value) >= change):
                kept.append((key[0], row.seconds, row.frame, row.signal, n))
                at, value, n = float(row.seconds), float(row.signal), n + 1
        state.update((at, value, n))
        yield pd.DataFrame(kept, columns=["video", "seconds", "frame", "signal", "frame_id"])

    return frames.groupBy("video").applyInPandasWithState(step, "video long, seconds double, frame long, signal double, frame_id long", "at double, value double, n long", "append", GroupStateTimeout.NoTimeout)


def persisted(results: DataFrame, path: str, checkpoint: str):
    """Appends results as they come; a restart goes on where it was."""
    return results.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """An extension: events and their mean value by window and kind, late ones dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
