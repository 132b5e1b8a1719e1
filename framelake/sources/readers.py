"""Readers of run folders, as DataFrames. Missing or broken files give empty tables, not errors, where results are optional."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake import schemas
from framelake.functions import text
from framelake.sources import datasource


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array; empty if it is absent."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def json_records(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame:
    """One record a file; files that are no JSON are left out."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", pattern).json(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def preferred(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first table, or the second where the first is empty."""
    return second if first.isEmpty() else first


def captions(spark: SparkSession, run: str) -> DataFrame:
    return preferred(json_array(spark, f"{run}/captions/all_captions.json", schemas.CAPTIONED), json_records(spark, f"{run}/captions", "caption_*.json", schemas.CAPTIONED))


def ocr(spark: SparkSession, run: str) -> DataFrame:
    return preferred(json_array(spark, f"{run}/ocr/all_ocr.json", schemas.OCR), json_records(spark, f"{run}/ocr", "ocr_*.json", schemas.OCR))


def frames(spark: SparkSession, run: str, video: str, size: int | None = None, extraction: dict[str, str] | None = None) -> DataFrame:
    """Frames of a run whose metadata is of this video, size and extraction; else none."""
    meta = json_array(spark, f"{run}/frames/frames_meta.json", schemas.FRAMES_META).where(F.col("video") == video)
    if size is not None:
        meta = meta.where(F.coalesce(F.col("video_size") == size, F.lit(True)))
    for key, value in (extraction or {}).items():
        meta = meta.where(F.col("extraction")[key] == value)
    return meta.select("video", F.explode("frames").alias("f")).select("video", "f.*")


def notes(spark: SparkSession, run: str, captions_sha1: str) -> DataFrame:
    """pos, note: kept notes that belong to these captions."""
    return json_array(spark, f"{run}/output/segment_notes.json", schemas.NOTES).where(F.col("captions_sha1") == captions_sha1).select(F.posexplode("notes").alias("pos", "note"))


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored Parquet table; empty if it is absent."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def vectors(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    rows = table(spark, path, schemas.VECTORS)
    return (rows if collection is None else rows.where(F.col("collection") == collection)).orderBy("timestamp")


def mapping_override(spark: SparkSession, path: str) -> DataFrame:
    """Mappings written by hand: rows need folder, src_rel and dst_rel; the rest is filled in."""
    rows = json_array(spark, path, schemas.MAPPINGS).where("folder IS NOT NULL AND src_rel IS NOT NULL AND dst_rel IS NOT NULL")
    return rows.withColumns({"confidence": F.coalesce("confidence", F.lit("manual")), "reasoning": F.coalesce("reasoning", F.lit("manual"))})


def files(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """path (below root), size, modified and, if wanted, content of all files under a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.regexp_replace("path", f"^.*?{root.rstrip('/').split('://')[-1]}/", "")
    return rows.select(below.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))


def runs(spark: SparkSession, data: str) -> DataFrame:
    """Folders with at least one of a run's folders, newest first; hidden ones are left out."""
    parts = F.split("path", "/")
    found = files(spark, data, content=False).where(F.size(parts) > 2).select(parts[0].alias("run"), parts[1].alias("folder"), "modified")
    found = found.where(~F.startswith("run", F.lit(".")) & F.col("folder").isin(*schemas.RUN_FOLDERS))
    flags = [F.bool_or(F.col("folder") == f).alias(f"has_{f}") for f in schemas.RUN_FOLDERS]
    return found.groupBy("run").agg(F.max("modified").alias("modified"), *flags).orderBy(F.desc("modified"), F.desc("run"))


def heads(spark: SparkSession, root: str, most: int, begins: str = "", ends: str = "") -> DataFrame:
    """path (below root), size, modified and the first `most` bytes of the files under a folder whose paths begin and end so: no more of them is read."""
    return datasource.heads(spark, root, most, begins=begins, ends=ends)


def frames_of_videos(spark: SparkSession, root: str, names: list[str] | None = None, first: int = 0, last: int | None = None, share_bytes: int = datasource.SHARE_BYTES) -> DataFrame:
    """Frames of the uncompressed videos (Y4M) under a folder, as frame_images has them: of the videos named, from frame `first` to before `last`. No
    other video is opened, and no other frame of a large one read."""
    return datasource.videos(spark, root, share_bytes, names=names, low=first, high=last)


def artifacts(spark: SparkSession, data: str, snippet: int = 400) -> DataFrame:
    """Files of all runs' output folders but their metadata, with the first characters, for which the first bytes are read."""
    # A character has four bytes at most; one that is cut off at the end is left out of the snippet.
    return _outputs(heads(spark, data, 4 * snippet)).select("folder", "src_rel", "size", F.substring(F.try_validate_utf8(_whole_characters(F.col("content"))), 1, snippet).alias("snippet"))


def sources(spark: SparkSession, data: str) -> DataFrame:
    """The same files with all their text; null for those that are no text."""
    return _outputs(files(spark, data)).select("folder", "src_rel", F.try_validate_utf8(F.col("content").cast("string")).alias("source"))


def _outputs(rows: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    found = rows.where((F.size(parts) > 2) & (parts[1] == "output") & (text.basename(F.col("path")) != "reconstruction_meta.json"))
    return found.withColumns({"folder": parts[0], "src_rel": F.array_join(F.slice(parts, F.lit(3), F.size(parts)), "/")})


def _whole_characters(content: Column) -> Column:
    """Bytes as text, without the beginning of a character at their end."""
    cut = F.regexp_extract(F.hex(content), "([C-F].|[EF].[89AB].|F.[89AB].[89AB].)$", 1)
    return F.substring(content, F.lit(1), F.length(content) - F.length(cut) / 2).cast("string")


def has_suffix(path: Column, suffixes: tuple[str, ...]) -> Column:
    return F.element_at(F.split(F.lower(path), r"\."), -1).isin(*(s.lstrip(".") for s in suffixes))


def videos(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = schemas.VIDEO_SUFFIXES) -> DataFrame:
    return files(spark, folder, content=False).where(has_suffix(F.col("path"), suffixes))


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    return videos(spark, folder, schemas.RECORDING_SUFFIXES)


def frame_images(spark: SparkSession, root: str, fps: float = 30.0) -> DataFrame:
    """Frames decoded by another program: images in a folder for each video, named by their number. video, frame_index, fps and their pixels.

    There is no video decoder here; what it would yield comes as files. Images that cannot be read are left out.
    """
    rows = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root)
    parts = F.split("image.origin", "/")
    number = F.regexp_extract(F.element_at(parts, -1), r"(\d+)\.[A-Za-z]+$", 1)
    folder = F.when(F.element_at(parts, -2) == "frames", F.element_at(parts, -3)).otherwise(F.element_at(parts, -2))
    pixels = [F.col(f"image.{a}").alias(b) for a, b in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))]
    return rows.where(number != "").select(folder.alias("video"), number.cast("long").alias("frame_index"), F.lit(float(fps or 30.0)).alias("fps"), *pixels)


def video_metadata(paths: DataFrame, probe, path: str = "path") -> DataFrame:
    """paths with `meta`, a struct of schemas.VIDEO_META: what probe(path) says, a dictionary as ffprobe's; null where it fails or knows nothing."""
    kind = T.StructType([*paths.schema.fields, T.StructField("meta", schemas.VIDEO_META)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(meta=[_described(probe, p) for p in batch[path]])

    return paths.mapInPandas(run, kind)


def _described(probe, path: str) -> dict | None:
    try:
        found = probe(path) or {}
    except Exception:  # noqa: BLE001  a program that is missing or fails: nothing is known
        return None
    stream = next((s for s in found.get("streams", ()) if s.get("codec_type") == "video"), None)
    if stream is None:
        return None
    above, _, below = str(stream.get("r_frame_rate", "30/1")).partition("/")
    rate = float(above) / float(below or 1) if float(below or 1) else 30.0
    return {"duration": float(found.get("format", {}).get("duration", 0.0)), "fps": rate, "width": stream.get("width"), "height": stream.get("height"), "codec": stream.get("codec_name"), "total_frames": int(stream["nb_frames"]) if str(stream.get("nb_frames", "")).isdigit() else None}


def transcript_meta(spark: SparkSession, run: str) -> DataFrame:
    """The metadata of a finished transcript; no row if there is none."""
    return json_array(spark, f"{run}/output/transcribe_meta.json", schemas.TRANSCRIPT_META)


def frame_bytes(spark: SparkSession, run: str, name: str) -> DataFrame:
    """The content of one frame's file; none for names that lead elsewhere."""
    if "/" in name or ".." in name or not name:
        return files(spark, run).limit(0)
    return files(spark, f"{run}/frames").where(F.col("path") == name)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Mappings as sinks.manifest writes them, or a merge script's file: one JSON object a line."""
    return spark.read.schema(schemas.MAPPINGS).json(path)


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """The cache of summaries; none if it is absent."""
    return table(spark, path, schemas.SUMMARIES)


def bounded_text(rows: DataFrame, suffixes: tuple[str, ...], most: int = 400_000) -> DataFrame:
    """name, text, truncated, size of files (path, size, content or its first `most` bytes) with allowed suffixes and names that stay within their folder.

    Bytes that are no text become signs for it."""
    name: Column = F.col("path")
    fits = has_suffix(name, suffixes) & ~name.rlike(r"(^/)|(^|/)\.\.(/|$)")
    return rows.where(fits).select(name.alias("name"), F.make_valid_utf8(F.substring(F.col("content"), 1, most).cast("string")).alias("text"), (F.col("size") > most).alias("truncated"), "size")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images; those that can't be read are blank 224 x 224 ones."""
    rows = spark.read.format("image").option("dropInvalid", False).load(path)
    bad = F.col("image.height") <= 0
    blank = F.unhex(F.repeat(F.lit("00"), F.lit(224 * 224 * 3)))
    pick = lambda name, other: F.when(bad, other).otherwise(F.col(f"image.{name}")).alias(name)
    return rows.select(F.col("image.origin").alias("origin"), pick("height", F.lit(224)), pick("width", F.lit(224)), pick("nChannels", F.lit(3)), pick("data", blank))
