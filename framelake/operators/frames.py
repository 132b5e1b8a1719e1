"""Selecting frames: strides, gates that look back at the last frame kept, dense ids.

What is kept depends on the last frame kept. Where signals are numbers, the frame that would be kept next is found for every frame at once, and the
chain of these is followed (`jumps`). Pixels are compared by the kernels of `functions.images`, pair by pair, so there a video is folded in order,
in a stream (`folds`).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.functions import images
from framelake.functions.text import timestamp
from framelake.operators import jumps
from framelake.operators.folds import folded
from framelake.shared import kept

#: Thresholds of a change, and seconds between frames.
SSIM, PHASH, HISTOGRAM, AREA = 0.97, 8, 0.90, 0.02
LEAST_SECONDS, MOST_SECONDS = 0.5, 4.0
DUPLICATE_SSIM = 0.992


def fixed_step(fps: float, target: float) -> int:
    return max(1, int(fps / target))


def dense_step(fps: float, target: float) -> int:
    return max(1, int(round(fps / max(target, 0.01))))


def strided(frames: DataFrame, step: int, index: str = "frame_index") -> DataFrame:
    return frames.where(F.col(index) % step == 0)


def changed(ssim: Column, area: Column, phash_distance: Column, histogram: Column) -> Column:
    return ((ssim < SSIM) & (area >= AREA)) | (phash_distance >= PHASH) | (histogram <= HISTOGRAM)


def gate(elapsed: Column, change: Column, least: float = LEAST_SECONDS, most: float = MOST_SECONDS) -> Column:
    return ((elapsed >= least) & change) | (elapsed >= most)


def indexed(rows: DataFrame, video: str, *order: str) -> DataFrame:
    return rows.withColumn("frame_index", F.row_number().over(Window.partitionBy(video).orderBy(*order)) - 1)


def _chained(nexts: DataFrame, video: str, names: list[str]) -> DataFrame:
    """The rows that the chain from each video's first row leads to, with their dense frame_id."""
    nexts = kept(nexts)
    return nexts.join(jumps.chain(nexts), ["g", "pos"]).select("row.*", F.col("nth").cast("int").alias("frame_id")).select(video, "frame_id", *names)


def _differs(a: Column, b: Column, least: float) -> Column:
    """By at least so much; a signal that is missing, or no number, differs from none."""
    number = lambda x: F.nanvl(x.cast("double"), F.lit(None).cast("double"))
    return F.coalesce(F.abs(number(b) - number(a)) >= least, F.lit(False))


def _gated(rows: DataFrame, video: str, names: list[str], keep: Callable[[Column, Column], Column]) -> DataFrame:
    """The same for videos of few frames: rows for which keep(last kept row, row) holds, the first always."""
    row_type = T.StructType([rows.schema[c] for c in names])
    begin = F.struct(F.lit(None).cast(row_type).alias("last"), F.lit(0).alias("n"), F.lit(-1).alias("frame_id"))

    def step(now: Column, row: Column) -> Column:
        kept_ = (now["n"] == 0) | keep(now["last"], row)
        return F.struct(F.when(kept_, row).otherwise(now["last"]).alias("last"), (now["n"] + kept_.cast("int")).alias("n"), F.when(kept_, now["n"]).otherwise(-1).alias("frame_id"))

    return jumps.walked(rows, video, names, begin, step, "frame_id").where("frame_id >= 0").select(video, "frame_id", *names)


def keyframes(frames: DataFrame, video: str, order: tuple[str, ...], seconds: str, signal: str | None = None, change: float = 0.0, least: float = LEAST_SECONDS, most: float = MOST_SECONDS) -> DataFrame:
    """The gate over time alone, or with a change of `signal` by at least `change`. A missing signal has not changed.

    Times do not fall in `order`. They are compared by the microsecond.
    """
    names = [*order, *dict.fromkeys(x for x in (seconds, signal) if x and x not in order)]
    scale = 1 if isinstance(frames.schema[seconds].dataType, T.IntegralType) else 1_000_000
    longest, shortest = round(most * scale), round(least * scale)
    at = lambda x: F.round(x * scale).cast("long")
    rows = frames.select(video, *names)

    def keep(last: Column, row: Column) -> Column:
        gap = at(row[seconds]) - at(last[seconds])
        return (gap >= longest) | ((gap >= shortest) & (F.lit(True) if signal is None else _differs(last[signal], row[signal], change)))

    def follow(large: DataFrame) -> DataFrame:
        stood, now = jumps.placed(large, video, names), at(F.col("row")[seconds])
        if signal is None:
            reach = min(longest, shortest)
            return _chained(jumps.beyond(stood, now, now + reach, reach, reached=True), video, names)
        early = jumps.beyond(stood, now, now + shortest, shortest, reached=True).withColumnRenamed("next", "early")
        both = kept(jumps.beyond(early, now, now + longest, longest, reached=True).withColumnRenamed("next", "late"))
        return _chained(jumps.changed(both, "early", F.col("row")[signal], change).withColumn("next", F.least("late", F.coalesce("turned", "late"))), video, names)

    return jumps.by_size(rows, video, lambda small: _gated(small, video, names, keep), follow)


def without_static(frames: DataFrame, video: str, order: tuple[str, ...], signal: str, least: float) -> DataFrame:
    """Drops rows whose signal differs from the last kept one's by less than `least`."""
    names = [*order, *(() if signal in order else (signal,))]
    rows = frames.select(video, *names)

    def follow(large: DataFrame) -> DataFrame:
        stood = jumps.placed(large, video, names).withColumn("start", F.col("pos") + 1)
        return _chained(jumps.changed(stood, "start", F.col("row")[signal], least).withColumnRenamed("turned", "next"), video, names)

    return jumps.by_size(rows, video, lambda small: _gated(small, video, names, lambda last, row: _differs(last[signal], row[signal], least)), follow)


#: Columns of an image of a frame: bytes in rows of blue, green and red.
PIXELS = ("height", "width", "channels", "data")


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    image = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return image[..., :3] if channels >= 3 else np.repeat(image[..., :1], 3, axis=2)


def keyframes_of_images(frames: DataFrame, video: str = "video", index: str = "frame_index", fps: str = "fps", least: float = LEAST_SECONDS, most: float = MOST_SECONDS) -> DataFrame:
    """Frames (video, frame_index, fps and PIXELS) that differ from the last kept one by structure, hash or colours, with frame_id, timestamp and
    size. A fps that is missing or 0 is 30. Pixels of the frames kept are results, so that they can be written."""
    rows = frames.select(video, index, fps, *PIXELS)
    kind = T.StructType([rows.schema[video], T.StructField("frame_id", T.IntegerType()), T.StructField(index, T.LongType()), T.StructField("timestamp", T.DoubleType()), *(rows.schema[c] for c in PIXELS)])

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple | None]:
        last, emitted, n = state
        seconds = row[1] / max(row[2] or 30.0, 1e-6)
        look = images.Look(pixels(*row[3:]))
        if last is not None:
            gap = seconds - emitted
            if not (gap >= most or (gap >= least and moved(last, look))):
                return state, None
        return (look, seconds, n + 1), (row[0], n, row[1], round(seconds, 3), *row[3:])

    return folded(rows, video, [index], lambda: (None, 0.0, 0), step, kind)


def moved(last: images.Look, look: images.Look) -> bool:
    if last.gray.shape != look.gray.shape:
        ssim, area = 1.0, 0.0
    else:
        ssim, parts = images.similarity(last.gray, look.gray)
        area = images.changed_area(parts)
    return (ssim < SSIM and area >= AREA) or (last.hash ^ look.hash).bit_count() >= PHASH or images.histogram_match(last.colours, look.colours) <= HISTOGRAM


def without_static_images(frames: DataFrame, video: str = "video", index: str = "frame_index", fps: str = "fps", step_frames: int = 1, least: float = DUPLICATE_SSIM) -> DataFrame:
    """Every step_frames-th frame, but those of the size of the last kept one that resemble it by at least `least`."""
    rows = strided(frames.select(video, index, fps, *PIXELS), step_frames, index)
    kind = T.StructType([rows.schema[video], T.StructField("frame_id", T.IntegerType()), T.StructField(index, T.LongType()), T.StructField("timestamp", T.DoubleType()), *(rows.schema[c] for c in PIXELS)])

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple | None]:
        last, n = state
        gray = images.gray_small(pixels(*row[3:]))
        if last is not None and last.shape == gray.shape and images.similarity(last, gray)[0] >= least:
            return state, None
        return (gray, n + 1), (row[0], n, row[1], round(row[1] / max(row[2] or 30.0, 1e-6), 3), *row[3:])

    return folded(rows, video, [index], lambda: (None, 0), step, kind)


def frame_table(kept: DataFrame, seconds: str = "seconds", kind: str = "jpg") -> DataFrame:
    """File names and printed times of kept frames."""
    return kept.withColumns({"file": F.format_string(f"frame_%06d.{kind}", "frame_id"), "timestamp": F.bround(seconds, 3), "timestamp_str": timestamp(F.col(seconds))})
