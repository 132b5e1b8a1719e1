"""Reuse of earlier results: joins with caches, guards and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.text import is_error


def last_record(cache: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of records with the same key the last one."""
    rest = [c for c in cache.columns if c not in keys]
    return cache.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def usable(cache: DataFrame, value: str, keep_errors: bool = False) -> DataFrame:
    """Entries with a value. keep_errors: error markers count as values and are never tried again."""
    found = cache.where(F.coalesce(F.col(value), F.lit("")) != "")
    return found if keep_errors else found.where(~is_error(F.col(value)))


def attached(frames: DataFrame, cache: DataFrame, keys: list[str], value: str) -> DataFrame:
    return frames.join(cache.select(*keys, value), keys, "left")


def pending(frames: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Only these rows reach a model."""
    return frames.join(cache, keys, "left_anti")


def completed(frames: DataFrame, cache: DataFrame, keys: list[str], value: str, make) -> DataFrame:
    """Cached rows and freshly made ones: make(pending rows) returns them with `value`."""
    held = frames.join(cache.select(*keys, value), keys)
    return held.unionByName(make(pending(frames, cache, keys)).select(held.columns))


def guarded(meta: DataFrame, video: str, size: int | None, config: Column | None = None) -> DataFrame:
    """Metadata that is of this video, size and configuration; a missing size or configuration is accepted."""
    same = F.col("video") == video
    if size is not None:
        same &= F.coalesce(F.col("video_size") == size, F.lit(True))
    return meta.where(same if config is None else same & F.coalesce(config, F.lit(True)))


def newest(runs: DataFrame, stem: str, marker: str) -> DataFrame:
    """The newest run of a stem, by name, that has the marker."""
    return runs.where((F.col("stem") == stem) & F.col(marker)).agg(F.max_by("path", "name").alias("path"), F.max("name").alias("name"))


def put(cache: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The cache with fresh entries in the place of older ones."""
    return cache.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def rebuild_needed(vectors: DataFrame, total: int) -> bool:
    """A store is complete or built anew."""
    return vectors.count() < total


def reusable(videos: DataFrame, runs: DataFrame, stem: str, marker: str, same: Column, fresh: Column) -> DataFrame:
    """videos with `path` and `reused`: the newest run of the same stem that has the marker, if `same` holds for its metadata, else a fresh path.

    runs: stem, name, path, the marker and what `same` looks at.
    """
    rest = [c for c in runs.columns if c != stem]
    last = runs.where(F.col(marker)).groupBy(stem).agg(F.max_by(F.struct(*rest), "name").alias("run"))
    found = videos.join(last, stem, "left").select(*videos.columns, "run.*")
    fits = F.col("path").isNotNull() & F.coalesce(same, F.lit(False))
    return found.select(*videos.columns, F.when(fits, F.col("path")).otherwise(fresh).alias("path"), fits.alias("reused"))


def transcript_is_of(video: Column, size: Column, meta_video: Column, meta_size: Column) -> Column:
    """Whether a transcript is of this video. Missing metadata, and a size that was not noted, are accepted."""
    return meta_video.isNull() | ((meta_video == video) & F.coalesce(meta_size == size, F.lit(True)))


def left_over(results: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    return results.join(taken.select(*keys), keys, "left_anti")
