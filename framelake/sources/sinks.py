"""Writers of results: Parquet tables by partition, text documents, JSON metadata."""

from __future__ import annotations

import json
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake import schemas
from framelake.functions import images, text, values
from framelake.operators import tree as trees


def append(rows: DataFrame, path: str, *partitions: str) -> None:
    rows.write.mode("append").partitionBy(*partitions).parquet(path)


def replace_partitions(rows: DataFrame, path: str, *partitions: str) -> None:
    """Only the partitions that rows hold are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def add_vectors(rows: DataFrame, path: str) -> None:
    append(rows, path, "collection")


def reset_collection(rows: DataFrame, path: str) -> None:
    replace_partitions(rows, path, "collection")


def put_keyed(fresh: DataFrame, path: str, key: str) -> None:
    """Cache entries at `path`: fresh ones replace held ones of the same key. The new table is written aside and then takes the place of the old one."""
    spark = fresh.sparkSession
    aside = f"{path.rstrip('/')}.{uuid4().hex}"
    held = _held(spark, path, fresh)
    (fresh if held is None else held.join(fresh.select(key), key, "left_anti").unionByName(fresh)).write.parquet(aside)
    old = f"{aside}.old"
    if held is not None:
        _moved(spark, path, old)
    _moved(spark, aside, path)
    _removed(spark, old)


def _held(spark: SparkSession, path: str, like: DataFrame) -> DataFrame | None:
    return spark.read.schema(like.schema).parquet(path) if _there(spark, path) else None


def _store(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _there(spark: SparkSession, path: str) -> bool:
    store, where = _store(spark, path)
    return store.exists(where)


def _moved(spark: SparkSession, path: str, to: str) -> None:
    store, where = _store(spark, path)
    if not store.rename(where, _store(spark, to)[1]):
        raise OSError(f"cannot move {path} to {to}")


def _removed(spark: SparkSession, path: str) -> None:
    store, where = _store(spark, path)
    store.delete(where, True)


def documents(lines: DataFrame, path: str, video: str = "video") -> None:
    """One text for each video from its stitched lines."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n")
    lines.groupBy(video).agg(F.concat(F.trim(text), F.lit("\n")).alias("value")).write.mode("overwrite").partitionBy(video).text(path)


def metadata(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(path)


def manifest(mappings: DataFrame, path: str) -> None:
    mappings.select("folder", "src_rel", "dst_rel", "confidence", "reasoning").write.mode("overwrite").json(path)


def frames_meta(frames: DataFrame, path: str, extraction: dict[str, str], size: int | None = None) -> None:
    """One row for each video: what it is, how its frames were chosen, and the frames in order."""
    fields = [x.split()[0] for x in schemas.FRAME_FIELDS.split(", ")]
    held = frames.groupBy("video").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("frames"))
    config = F.create_map(*(F.lit(x) for pair in sorted(extraction.items()) for x in pair)) if extraction else F.lit(None).cast("map<string,string>")
    metadata(held.select("video", F.lit(size).cast("long").alias("video_size"), config.alias("extraction"), "frames"), path)


def notes(found: list[str], captions_sha1: str, spark: SparkSession, path: str) -> None:
    """The notes of these captions, for the next run."""
    metadata(spark.createDataFrame([(captions_sha1, found)], schemas.NOTES), path)


def artifacts(made: DataFrame, root: str, verdicts: dict[str, object] | None = None) -> DataFrame:
    """Writes each run's (folder, filename, content) under its output folder, with one metadata file a run, and returns the paths."""
    bodies = made.select(F.concat("folder", F.lit("/output/"), "filename").alias("dst_rel"), "content")
    row = F.struct("filename", F.coalesce("description", F.lit("")).alias("description"))
    meta = made.groupBy("folder").agg(F.min("content_type").alias("content_type"), F.array_sort(F.collect_list(row)).alias("artifacts"))
    text_of = values.canonical_json(content_type=F.col("content_type"), artifacts=F.col("artifacts"), qa_scores=F.lit(json.dumps(verdicts or {}, sort_keys=True)))
    return tree(bodies.unionByName(meta.select(F.concat("folder", F.lit("/output/reconstruction_meta.json")).alias("dst_rel"), text_of.alias("content"))), root)


def report(found: dict[str, DataFrame], mappings: DataFrame, name: str, passed: bool, iterations: int, samples: int = 10) -> str:
    """What was assembled, for people: counts by root and confidence, findings with samples, and mappings to look at."""
    confidence = {r.confidence: r.n for r in found["confidences"].collect()}
    lines = [f"# Assembly {name}", "", f"- files: {values_of(mappings.count())}", "- confidence: " + ", ".join(f"{k} {confidence.get(k, 0)}" for k in trees.CONFIDENCES), f"- rounds of checks: {iterations}, {'passed' if passed else 'not passed'}", "", "## Roots", ""]
    lines += [f"- {r.root or '(root)'}: {r.files}" for r in found["clusters"].select("root", "files").orderBy("root").collect()]
    for key, title in (("unresolved", "Imports that lead nowhere"), ("orphans", "Files that no import leads to"), ("collisions", "Paths with several sources")):
        if key in found:
            rows = found[key].orderBy(*found[key].columns[:1])
            lines += ["", f"## {title}: {rows.count()}", ""] + [f"- {' '.join(str(x) for x in r)}" for r in rows.limit(samples).collect()]
    lines += ["", "## To look at", ""] + [f"- {r.confidence}: {r.folder}/{r.src_rel} as {r.dst_rel} {r.reasoning or ''}".rstrip() for r in trees.unsure(mappings).orderBy("dst_rel", "folder").toLocalIterator()]
    return "\n".join(lines) + "\n"


def values_of(n: int) -> str:
    return f"{n:,}"


def text_file(spark: SparkSession, body: str, path: str) -> None:
    """One text, such as a summary or a report, as a file of this name."""
    store, where = _store(spark, path)
    out = store.create(where, True)
    try:
        out.write(body.encode())
    finally:
        out.close()


def console_table(rows: DataFrame, most: int = 20, width: int = 60) -> str:
    """The first rows as a table for a console; longer values are cut with a mark."""
    found = rows.limit(most).collect()
    cut = lambda x: (lambda t: t if len(t) <= width else t[: width - 3] + "...")("" if x is None else str(x).replace("\n", " "))
    lines = [rows.columns, *([cut(x) for x in r] for r in found)]
    wide = [max(len(line[k]) for line in lines) for k in range(len(rows.columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, wide, strict=True)).rstrip() for line in lines)


def merged_tree(artifacts_: DataFrame, mappings: DataFrame, root: str) -> DataFrame:
    """Empties a folder and fills it with the artifacts (folder, src_rel, content), each where its mapping leads, or at its own path."""
    _removed(artifacts_.sparkSession, root)
    return tree(trees.placed(artifacts_, mappings, ["folder", "src_rel"]).select("dst_rel", "content"), root)


def frame_images(frames: DataFrame, root: str, most: int = 1280) -> DataFrame:
    """Writes the pixels of frames (video, frame_id, timestamp, height, width, channels, data), within `most`, as PNG files by their tasks; returns their rows of metadata."""
    from framelake.operators.frames import pixels as pixels_of

    kind = "video string, frame_id long, timestamp double, path string, width int, height int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            rows = []
            for video, frame, at, *pixels in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                image = pixels_of(*pixels)
                width, height = images.fit(image.shape[1], image.shape[0], most)
                if (height, width) != image.shape[:2]:
                    image = images.shrink(image, height, width).round().astype("uint8")
                path = f"{base}/{video}/frames/frame_{frame:06d}.png"
                _whole(store, path, images.png(image))
                rows.append((video, frame, at, path, width, height))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.float64(), pa.string(), pa.int32(), pa.int32()))], [x.split()[0] for x in kind.split(", ")])

    found = frames.select(F.col("video").cast("string").alias("video"), F.col("frame_id").cast("long").alias("frame_id"), "timestamp", "height", "width", "channels", "data").mapInArrow(run, kind)
    return found.withColumn("timestamp_str", text.timestamp(F.col("timestamp")))


def y4m(frames: DataFrame, root: str) -> DataFrame:
    """Writes frames (video, frame_index, fps, height, width, channels, data) as one uncompressed video each, in order, and returns video, frames.

    A video streams through one task, a frame at a time. All its frames must be of the first one's size.
    """
    from framelake.sources import datasource

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        now, out, part, n, shape, done = None, None, "", 0, None, []

        def close() -> None:
            if out is not None:
                out.close()
                store.move(part, f"{base}/{now}.y4m")
                done.append((now, n))

        for batch in batches:
            for video, _, fps, *pixels in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or video != now:
                    close()
                    now, n, shape, part = video, 0, pixels[:3], f"{base}/{video}.{uuid4().hex}.part"
                    store.create_dir(part.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(part)
                    out.write(datasource.y4m_header(pixels[1], pixels[0], pixels[2], fps or 30.0))
                if pixels[:3] != shape:
                    raise ValueError(f"frames of {video} differ in size")
                out.write(datasource.y4m_frame(*pixels))
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["video", "frames"])
            done.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["video", "frames"])

    rows = frames.select(F.col("video").cast("string").alias("video"), "frame_index", "fps", "height", "width", "channels", "data").where(trees.safe_path(F.col("video")).isNotNull())
    return rows.repartition("video").sortWithinPartitions("video", "frame_index").mapInArrow(run, "video string, frames long")


def _whole(store, path: str, body: bytes) -> None:
    """A file appears under its name only when it is whole, so that a repeated task does no harm."""
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(body)
    store.move(part, path)


def tree(files: DataFrame, root: str) -> DataFrame:
    """Writes (dst_rel, content) as files under a folder and returns what was written; paths that lead out of it are not. Of several files for one path any may stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _whole(store, f"{base}/{path}", content.as_buffer() if content.is_valid else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["dst_rel"])

    return files.select(trees.safe_path(F.col("dst_rel")).alias("dst_rel"), F.col("content").cast("binary").alias("content")).where("dst_rel IS NOT NULL").mapInArrow(run, "dst_rel string")
