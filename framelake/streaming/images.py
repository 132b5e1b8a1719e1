"""Keyframes of a stream of pictures: what the last kept picture of each video looked like is state, in RocksDB.

A trigger's frames of a video are compared in the order of their numbers. They are in memory together, so a trigger should be bounded (maxFilesPerTrigger
and the like). Frames that come late, or again, with a number that is not above all numbers of earlier triggers, are left out: what has
been kept stays as it is, and a source that repeats itself adds nothing.

A row without pixels says that its video has ended: its state is removed. A frame that comes in a later trigger begins the video anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framelake.functions import images
from framelake.operators.frames import LEAST_SECONDS, MOST_SECONDS, PIXELS, moved, pixels

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULTS = "video string, frame_id long, frame_index long, timestamp double, height int, width int, channels int, data binary"
LOOK = "height int, width int, gray binary, hash long, colours binary, emitted double"
COUNT = "frames long, last long"


class Gate(StatefulProcessor):
    def __init__(self, least: float, most: float):
        self.least, self.most = least, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.look = handle.getValueState("look", LOOK)
        self.count = handle.getValueState("count", COUNT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.look.get() if self.look.exists() else None
        look, emitted = (images.Look.restored(*held[:5]), held[5]) if held else (None, None)
        n, last = self.count.get() if self.count.exists() else (0, -1)
        batch, kept, before = pd.concat(list(rows)), [], n
        shown = batch["data"].notna()
        ended = not shown.all()
        # Rows without pixels turn whole numbers into others.
        shots = batch[shown].astype({"frame_index": "int64", "height": "int64", "width": "int64", "channels": "int64"})
        for row in shots.sort_values("frame_index", kind="stable").itertuples(index=False):
            if row.frame_index <= last:
                continue
            last = row.frame_index
            seconds = last / max(row.fps or 30.0, 1e-6)
            if look is not None and seconds - emitted < self.least:
                continue
            new = images.Look(pixels(row.height, row.width, row.channels, row.data))
            if look is None or seconds - emitted >= self.most or moved(look, new):
                kept.append((key[0], n, last, round(seconds, 3), row.height, row.width, row.channels, row.data))
                look, emitted, n = new, seconds, n + 1
        if ended:
            self.look.clear()
            self.count.clear()
        else:
            if n > before:
                self.look.update((*look.stored(), emitted))
            self.count.update((n, last))
        yield pd.DataFrame(kept, columns=[x.split()[0] for x in RESULTS.split(", ")])

    def close(self) -> None:
        pass


def with_state_in_rocksdb(spark: SparkSession) -> None:
    """Without it, state of this kind cannot be held."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def keyframes(frames: DataFrame, least: float = LEAST_SECONDS, most: float = MOST_SECONDS) -> DataFrame:
    """Of a stream of frames (video, frame_index, fps, height, width, channels, data) those that operators.frames.keyframes_of_images keeps. A fps
    that is missing or 0 is 30."""
    with_state_in_rocksdb(frames.sparkSession)
    rows = frames.select(F.col("video").cast("string").alias("video"), F.col("frame_index").cast("long").alias("frame_index"), F.coalesce(F.nullif(F.col("fps").cast("double"), F.lit(0.0)), F.lit(30.0)).alias("fps"), *PIXELS)
    return rows.groupBy("video").transformWithStateInPandas(Gate(least, most), RESULTS, "append", "None")
