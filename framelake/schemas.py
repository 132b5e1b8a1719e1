"""Schemas of the stored tables. Fields that a producer may leave out are nullable; order is always a column."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fixed value: the names of a frame's fields in metadata files.
FRAME_FIELDS = "frame_id long, frame_index long, timestamp double, timestamp_str string, path string, width int, height int"
FRAMES = f"video string, {FRAME_FIELDS}"
CAPTIONED = f"{FRAMES}, caption string"
OCR = f"{FRAMES}, ocr string"
FRAMES_META = f"video string, video_size long, extraction map<string,string>, frames array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split() for x in FRAME_FIELDS.split(', ')))}>>"
TRANSCRIPT_META = "video string, video_size long, frames long, lines long, degenerate array<long>"
VECTORS = "collection string, id string, embedding array<float>, frame_id long, timestamp double, timestamp_str string, path string, document string"
NOTES = "captions_sha1 string, notes array<string>"
SUMMARIES = "key string, query string, summary string"
MAPPINGS = "folder string, src_rel string, dst_rel string, confidence string, reasoning string"
ARTIFACTS = "folder string, src_rel string, content_type string, classification_confidence double, description string, snippet string, size long"
VIDEO_META = T.StructType([T.StructField("duration", T.DoubleType()), T.StructField("fps", T.DoubleType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("codec", T.StringType()), T.StructField("total_frames", T.LongType())])
QA = "passed boolean, scores map<string,double>, overall double, feedback string, missing_elements array<string>"
ASSEMBLY_QA = "passed boolean, severity string, feedback string, specific_remappings array<string>"

#: Suffixes of videos in a folder given by a user, and in the folder of recordings.
VIDEO_SUFFIXES = (".mov", ".mp4", ".mkv", ".avi", ".webm", ".m4v", ".flv", ".wmv")
RECORDING_SUFFIXES = (".mov", ".mp4", ".mkv", ".avi", ".webm", ".m4v")
#: Fixed value: folders that make a folder a run.
RUN_FOLDERS = ("frames", "captions", "ocr", "chromadb", "output")
