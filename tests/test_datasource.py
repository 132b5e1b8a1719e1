"""The sources of frames and of file heads against plain loops over bytes."""

import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from framelake.operators import frames
from framelake.sources import datasource, readers, sinks


def y4m(path, colour, pictures, width, height, rate="25:1", words=b""):
    """A video of planes, each a list of bytes, as the format has it."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(f"YUV4MPEG2 W{width} H{height} F{rate} Ip{f' C{colour}' if colour else ''}\n".encode())
        for k, planes in enumerate(pictures):
            f.write(b"FRAME" + (b" I" + b"t" * k if words else b"") + b"\n" + b"".join(bytes(p) for p in planes))


def planes(seed, width, height, shared):
    draw = np.random.default_rng(seed)
    sizes = [width * height] + ([-(-width // shared[0]) * -(-height // shared[1])] * 2 if shared else [])
    return [draw.integers(0, 256, n).astype(np.uint8).tolist() for n in sizes]


def by_hand(picture, width, height, shared, full):
    if shared is None:
        return 1, bytes(picture[0])
    out = []
    for r in range(height):
        for c in range(width):
            at = (r // shared[1]) * -(-width // shared[0]) + c // shared[0]
            y, u, v = picture[0][r * width + c], picture[1][at] - 128, picture[2][at] - 128
            if not full:
                y, u, v = (y - 16) * 255 / 219, u * 255 / 224, v * 255 / 224
            out += [y + 1.772 * u, y - 0.344136 * u - 0.714136 * v, y + 1.402 * v]
    return 3, out


@pytest.mark.parametrize(("colour", "shared", "full"), [("420jpeg", (2, 2), True), ("", (2, 2), False), ("422", (2, 1), False), ("444", (1, 1), False), ("mono", None, False)])
@pytest.mark.parametrize("share", [64 << 20, 40])
@pytest.mark.parametrize("words", [b"", b"x"])
def test_frames_equal_a_loop(spark, tmp_path, colour, shared, full, share, words):
    pictures = [planes(k, 5, 3, shared) for k in range(7)]
    y4m(f"{tmp_path}/in/clip.y4m", colour, pictures, 5, 3, "30000:1001", words)
    found = {r.frame_index: r for r in readers.frames_of_videos(spark, str(tmp_path), share_bytes=share).collect()}
    assert sorted(found) == list(range(7))
    for k, picture in enumerate(pictures):
        r = found[k]
        channels, wanted = by_hand(picture, 5, 3, shared, full)
        assert (r.video, r.height, r.width, r.channels, round(r.fps, 3)) == ("in/clip", 3, 5, channels, 29.97)
        assert all(abs(a - min(max(b, 0), 255)) <= 0.51 for a, b in zip(r.data, wanted, strict=True))


def test_pruned_videos_are_not_opened(spark, tmp_path):
    y4m(f"{tmp_path}/good.y4m", "mono", [[[k] * 4] for k in range(50)], 2, 2)
    for name in ("broken.y4m", "other.y4m"):
        (tmp_path / name).write_bytes(b"not a video\n" * 20)
    (tmp_path / "notes.txt").write_text("no video at all")
    seen = lambda *a, **b: readers.frames_of_videos(spark, str(tmp_path), *a, share_bytes=30, **b)
    good = seen(["good"])
    assert good.count() == 50 and good.rdd.getNumPartitions() > 10
    some = seen(["good", "none"], first=40, last=43)
    assert [r.data[0] for r in some.orderBy("frame_index").collect()] == [40, 41, 42] and some.rdd.getNumPartitions() == 1
    assert seen(["absent"]).count() == 0 and seen([]).count() == 0 and seen(["good"], 60).count() == 0
    # Scans of one query do not get into each other's way.
    few, more = good.where("frame_index < 3"), good.where("frame_index > 45")
    assert sorted(r.frame_index for r in few.union(more).collect()) == [0, 1, 2, 46, 47, 48, 49]
    assert some.join(more.withColumnRenamed("frame_index", "other"), "video").count() == 12
    with pytest.raises(PySparkException):
        seen().count()


@pytest.mark.parametrize("body", [b"YUV4MPEG2 W2 H2 F1:1 Cmono\nFRAME\n123", b"YUV4MPEG2 W2 H2 F1:1 C420p10\nFRAME\n123456", b"YUV4MPEG2 W2 H2 F1:1 Cmono\nFRAME\n1234junk\n1234"])
def test_torn_videos_fail(spark, tmp_path, body):
    (tmp_path / "v.y4m").write_bytes(body)
    with pytest.raises(PySparkException):
        readers.frames_of_videos(spark, str(tmp_path)).collect()


def test_empty_folder_and_no_frames(spark, tmp_path):
    assert readers.frames_of_videos(spark, str(tmp_path)).count() == 0
    y4m(f"{tmp_path}/v.Y4M", "mono", [], 2, 2, "0:0")
    assert readers.frames_of_videos(spark, str(tmp_path)).count() == 0
    assert readers.heads(spark, str(tmp_path), 3).count() == 1


def test_videos_round_trip_into_keyframes(spark, tmp_path):
    draw = np.random.default_rng(3)
    looks = [draw.integers(0, 256, (24, 32, 3)).astype(np.uint8).repeat(2, 0).repeat(2, 1) for _ in range(3)]
    rows = [(v, k, 2.0, 48, 64, 3, bytearray(looks[(k // 4 + v) % 3].tobytes())) for v in range(2) for k in range(12)]
    table = spark.createDataFrame(rows, "video string, frame_index long, fps double, height int, width int, channels int, data binary")
    assert {tuple(r) for r in sinks.y4m(table, f"file://{tmp_path}").collect()} == {("0", 12), ("1", 12)}
    back = readers.frames_of_videos(spark, f"file://{tmp_path}")
    for r in back.collect():
        assert np.abs(np.frombuffer(r.data, np.uint8).astype(int) - looks[(r.frame_index // 4 + int(r.video)) % 3].ravel()).max() <= 2 and r.fps == 2.0
    kept = frames.keyframes_of_images(back).where("frame_index % 4 = 0")
    assert kept.count() == 6
    gray = table.where("video = '1'").withColumns({"channels": F.lit(1), "data": F.substring("data", 1, 48 * 64)})
    sinks.y4m(gray, f"file://{tmp_path}/gray").count()
    assert {(r.frame_index, bytes(r.data)) for r in readers.frames_of_videos(spark, f"{tmp_path}/gray").collect()} == {(r.frame_index, bytes(r.data)) for r in gray.collect()}


def test_sizes_must_agree(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 1.0, 1, 2, 1, b"12"), ("a", 1, 1.0, 2, 1, 1, b"12")], "video string, frame_index long, fps double, height int, width int, channels int, data binary")
    with pytest.raises(PySparkException):
        sinks.y4m(rows, f"file://{tmp_path}").collect()
    assert not list(tmp_path.glob("*.y4m"))


def test_heads(spark, tmp_path):
    bodies = {"a/x.txt": b"0123456789", "a/y.md": "éé".encode(), "z.bin": b"", "b/.hidden": b"no"}
    for path, body in bodies.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(body)
    rows = datasource.heads(spark, str(tmp_path), 3)
    assert {(r.path, r.size, bytes(r.content)) for r in rows.collect()} == {("a/x.txt", 10, b"012"), ("a/y.md", 4, "éé".encode()[:3]), ("z.bin", 0, b"")}
    assert [r.path for r in datasource.heads(spark, str(tmp_path), 3, begins="a/", low=5).collect()] == ["a/x.txt"]
    assert [r.path for r in readers.heads(spark, str(tmp_path), 3, ends=".md").collect()] == ["a/y.md"]
    shown = readers.bounded_text(rows, (".md", ".txt"), 3)
    assert {tuple(r) for r in shown.collect()} == {("a/x.txt", "012", True, 10), ("a/y.md", "éé".encode()[:3].decode(errors="replace"), True, 4)}


def test_artifacts_read_heads(spark, tmp_path):
    (tmp_path / "run/output/sub").mkdir(parents=True)
    bodies = {"a.md": "é" * 9, "sub/b.md": "日本語" * 5, "c.bin": b"\xff\xfe\x00" * 9, "d.md": "😀" * 4, "reconstruction_meta.json": "{}"}
    for path, body in bodies.items():
        (tmp_path / "run/output" / path).write_bytes(body if isinstance(body, bytes) else body.encode())
    for most in (1, 2, 3, 4, 5, 20):
        found = {r.src_rel: r.snippet for r in readers.artifacts(spark, str(tmp_path), most).collect()}
        assert found == {"a.md": "é" * min(9, most), "sub/b.md": ("日本語" * 5)[:most], "c.bin": None, "d.md": "😀" * min(4, most)}
    assert {r.src_rel: r.source for r in readers.sources(spark, str(tmp_path)).collect()}["a.md"] == "é" * 9
