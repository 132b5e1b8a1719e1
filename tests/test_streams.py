"""Streams of pictures and of results: restarts, late frames, ends, batches that fail halfway."""

import time

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from framelake.functions import images
from framelake.operators import frames
from framelake.streaming import images as live
from framelake.streaming import results

FRAMES = "video string, frame_index long, fps double, height int, width int, channels int, data binary"


def shots(n=16):
    draw = np.random.default_rng(2)
    looks = [draw.integers(0, 256, (12, 16, 3)).astype(np.uint8).repeat(4, 0).repeat(4, 1) for _ in range(4)]
    return [(v, k, [2.0, 0.0, None][i], 48, 64, 3, bytearray(looks[(k // 3 + i) % 4].tobytes())) for i, v in enumerate("abc") for k in range(n)]


def run(spark, folder):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    kept = live.keyframes(stream, 0.5, 4.0)
    query = kept.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    if not query.awaitTermination(120):
        query.stop()
        raise AssertionError("the stream did not end")
    return spark.read.schema(live.RESULTS).parquet(f"{folder}/out")


def put(spark, folder, rows):
    spark.createDataFrame(rows, FRAMES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    time.sleep(0.05)


def pick(df):
    return sorted((r.video, r.frame_id, r.frame_index, r.timestamp, bytes(r.data)) for r in df.collect())


@pytest.fixture
def partitions(spark):
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_keyframes_over_a_restart_equal_the_batch(spark, tmp_path, partitions):
    rows = shots()
    wanted = pick(frames.keyframes_of_images(spark.createDataFrame(rows, FRAMES), least=0.5, most=4.0))
    put(spark, tmp_path, [r for r in rows if r[1] < 5][::-1])
    put(spark, tmp_path, [r for r in rows if 5 <= r[1] < 9])
    first = pick(run(spark, tmp_path))
    assert first == [w for w in wanted if w[2] < 9]
    # Another run goes on from the state; frames that come late or again add nothing.
    put(spark, tmp_path, [r for r in rows if 7 <= r[1]])
    put(spark, tmp_path, [r for r in rows if r[1] % 2 == 0])
    assert pick(run(spark, tmp_path)) == wanted


def test_state_goes_when_a_video_has_ended(spark, tmp_path, partitions):
    same = bytearray(np.full((48, 64, 3), 90, np.uint8).tobytes())
    put(spark, tmp_path, [("a", k, 2.0, 48, 64, 3, same) for k in range(3)])
    put(spark, tmp_path, [("a", 3, 2.0, 48, 64, 3, same), ("a", None, None, None, None, None, None)])
    put(spark, tmp_path, [("a", k, 2.0, 48, 64, 3, same) for k in range(2)])
    assert sorted((r.frame_id, r.frame_index) for r in run(spark, tmp_path).collect()) == [(0, 0), (0, 0)]


def test_shrinking_is_an_area_average():
    draw = np.random.default_rng(1)
    for h, w, m, n in ((6, 8, 3, 4), (7, 9, 3, 5), (5, 5, 5, 2)):
        for image in (draw.integers(0, 256, (h, w)), draw.integers(0, 256, (h, w, 3))):
            big = image.repeat(m, 0).repeat(n, 1).astype(float)
            wanted = big.reshape(m, h, n, w, -1).mean(axis=(1, 3)).reshape(m, n, *image.shape[2:])
            assert np.allclose(images.shrink(image, m, n), wanted)
    began = time.time()
    assert images.shrink(draw.integers(0, 256, (2160, 3840, 3)).astype(np.uint8), 360, 640).shape == (360, 640, 3) and time.time() - began < 20


def test_looks_are_stored_whole():
    draw = np.random.default_rng(5)
    for size in ((48, 64, 3), (700, 900, 3), (9, 7, 3)):
        look = images.Look(draw.integers(0, 256, size).astype(np.uint8))
        again = images.Look.restored(*look.stored())
        assert (look.gray == again.gray).all() and look.hash == again.hash and (look.colours == again.colours).all()


def test_a_batch_that_fails_halfway_is_there_once(spark, tmp_path, monkeypatch):
    schema = "frame_id long, caption string"
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).select(F.col("id").alias("frame_id")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    source = lambda: spark.readStream.schema("frame_id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    make = lambda rows: rows.withColumn("caption", F.concat(F.lit("caption of "), "frame_id"))
    record, calls = results._record, []

    def torn(spark_, path, batch):
        calls.append(batch)
        if calls == [0, 1]:
            raise OSError("lost between the rows and the record")
        record(spark_, path, batch)

    monkeypatch.setattr(results, "_record", torn)
    go = lambda: results.persisted(source(), f"{tmp_path}/out", f"{tmp_path}/cp", make)
    with pytest.raises(StreamingQueryException):
        go().awaitTermination(120)
    # The rows of the second batch are written and not yet seen.
    assert results.results(spark, f"{tmp_path}/out", schema).count() == 10
    assert len(list((tmp_path / "out/data").glob("batch_id=*"))) == 2
    assert go().awaitTermination(120)
    assert calls == [0, 1, 1, 2]
    found = results.results(spark, f"{tmp_path}/out", schema)
    assert sorted((r.frame_id, r.caption, r.batch_id) for r in found.collect()) == [(k, f"caption of {k}", k // 10) for k in range(30)]
    # Repeated by hand, a batch adds nothing; another one's results take the place of earlier ones.
    results.write_batch(found.select("frame_id", "caption"), 1, f"{tmp_path}/out")
    assert results.results(spark, f"{tmp_path}/out", schema).count() == 30
    results.write_batch(spark.createDataFrame([(5, "better")], schema), 9, f"{tmp_path}/out")
    assert {r.frame_id: (r.caption, r.batch_id) for r in results.results(spark, f"{tmp_path}/out", schema, ["frame_id"]).collect()}[5] == ("better", 9)
    assert results.results(spark, f"{tmp_path}/none", schema).count() == 0
