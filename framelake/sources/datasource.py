"""Data sources of Spark in Python: frames of uncompressed videos, and the first bytes of files.

Files are listed and read through pyarrow's file systems, so a folder may be local, in HDFS or in a store. What is wanted (names, their beginnings and
ends, numbers from and to) is said when a source is opened, and files that are not wanted are neither opened nor dealt out. Spark's own push-down of
filters into Python sources is not used: in this version all scans of one relation share the filters of the last one planned, so a union
or a self-join of two filtered scans would lose rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Most bytes of one task's share of a video, files of one task, bytes of one batch of rows.
SHARE_BYTES = 64 << 20
FILES = 256
BATCH_BYTES = 8 << 20

#: Fixed values of the format: its first word, a frame's first word, and by colour space how many columns and rows share a colour (none: gray).
SIGNATURE, FRAME = b"YUV4MPEG2", b"FRAME"
COLOURS = {"420": (2, 2), "420jpeg": (2, 2), "420mpeg2": (2, 2), "420paldv": (2, 2), "422": (2, 1), "444": (1, 1), "mono": None}
#: Bytes within which a line of the format must end.
LINE = 4096


@dataclass
class Share(InputPartition):
    """Files of one task: path, size and what else is known of each; the frames from `first` to before `last` of them, of `stride` bytes each if that is known."""

    paths: list[tuple[str, int, object]]
    first: int = 0
    last: int | None = None
    stride: int | None = None


class Wanted:
    """Names (null: any), how they begin and end, and numbers from low to below high (null: without end), as options say."""

    def __init__(self, options):
        names = options.get("names")
        self.names = None if names is None else set(json.loads(names))
        self.begins, self.ends = options.get("begins", ""), options.get("ends", "")
        self.low, self.high = max(0, int(options.get("low", 0))), int(options["high"]) if "high" in options else None

    def named(self, name: str) -> bool:
        return (self.names is None or name in self.names) and name.startswith(self.begins) and name.endswith(self.ends)

    def numbered(self, number: int) -> bool:
        return number >= self.low and (self.high is None or number < self.high)


def wanted(names: list[str] | None = None, begins: str = "", ends: str = "", low: int = 0, high: int | None = None) -> dict[str, str]:
    """The options that say it."""
    said = {"names": None if names is None else json.dumps(list(names)), "begins": begins, "ends": ends, "low": str(low), "high": None if high is None else str(high)}
    return {k: v for k, v in said.items() if v is not None}


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _listed(path: str) -> tuple[object, str, list]:
    """The files below a folder (or the file itself), by name; those that are hidden or not yet whole are left out."""
    from pyarrow import fs

    store, base = _store(path)
    one = store.get_file_info(base)
    if one.type == fs.FileType.File:
        return store, base.rpartition("/")[0], [one]
    found = [x for x in store.get_file_info(fs.FileSelector(base, recursive=True)) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")) and not x.base_name.endswith(".part")]
    return store, base.rstrip("/"), sorted(found, key=lambda x: x.path)


class Heads(DataSource):
    """path (below the folder), size, modified and the first `bytes` bytes of files."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, size long, modified timestamp, content binary"

    def reader(self, schema) -> DataSourceReader:
        return HeadsReader(self.options)


class HeadsReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.bytes, self.files = options["path"], int(options.get("bytes", 400)), int(options.get("files", FILES))
        self.wanted = Wanted(options)

    def partitions(self) -> list[Share]:
        _, base, found = _listed(self.path)
        rows = [(x.path, x.size, (x.path[len(base) + 1 :], x.mtime)) for x in found]
        rows = [x for x in rows if self.wanted.named(x[2][0]) and self.wanted.numbered(x[1])]
        return [Share(rows[k : k + self.files]) for k in range(0, len(rows), self.files)] or [Share([])]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        kinds = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary()]
        rows, held = [], 0
        for path, size, (below, modified) in share.paths:
            with store.open_input_file(path) as f:
                rows.append((below, size, modified, f.read_at(min(size, self.bytes), 0)))
            held += len(rows[-1][-1])
            if held >= BATCH_BYTES:
                yield _batch(rows, kinds, ["path", "size", "modified", "content"])
                rows, held = [], 0
        yield _batch(rows, kinds, ["path", "size", "modified", "content"])


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


class Header:
    """The first line of a video: its size, rate, colours and where its frames begin."""

    def __init__(self, line: bytes):
        words = line.rstrip(b"\n").split(b" ")
        if words[0] != SIGNATURE:
            raise ValueError(f"not a {SIGNATURE.decode()} file")
        told = {w[:1].decode(): w[1:].decode() for w in words[1:] if w and w[:1] != b"X"}
        self.begin, self.width, self.height = len(line), int(told["W"]), int(told["H"])
        above, _, below = told.get("F", "30:1").partition(":")
        self.fps = int(above) / int(below) if below not in ("", "0") and above != "0" else 30.0
        colour = told.get("C", "420")
        if colour not in COLOURS:
            raise ValueError(f"colour space {colour} is not supported")
        self.shared = COLOURS[colour]
        self.full = b"XCOLORRANGE=FULL" in words or colour == "420jpeg"
        self.chroma = (0, 0) if self.shared is None else (-(-self.height // self.shared[1]), -(-self.width // self.shared[0]))
        self.size = self.height * self.width + 2 * self.chroma[0] * self.chroma[1]

    def pixels(self, body: bytes) -> tuple[int, bytes]:
        """Channels and the bytes of a frame, in rows of blue, green and red, or gray. Gray stays as it is stored."""
        n = self.height * self.width
        if self.shared is None:
            return 1, body
        y = np.frombuffer(body, np.uint8, n).reshape(self.height, self.width).astype(np.float64)
        planes = np.frombuffer(body, np.uint8, offset=n).reshape(2, *self.chroma).astype(np.float64) - 128
        u, v = (np.repeat(np.repeat(c, self.shared[1], 0), self.shared[0], 1)[: self.height, : self.width] for c in planes)
        # BT.601; without a full range black is 16 and white 235, and colours have 224 steps.
        if self.full:
            y_scale, y_zero, c_scale = 1.0, 0.0, 1.0
        else:
            y_scale, y_zero, c_scale = 255 / 219, 16.0, 255 / 224
        light, u, v = (y - y_zero) * y_scale, u * c_scale, v * c_scale
        bgr = np.stack([light + 1.772 * u, light - (0.114 * 1.772 * u + 0.299 * 1.402 * v) / 0.587, light + 1.402 * v], axis=-1)
        return 3, np.clip(np.rint(bgr), 0, 255).astype(np.uint8).tobytes()


def _line(f, at: int) -> bytes:
    head = f.read_at(LINE, at)
    end = head.find(b"\n")
    if end < 0:
        raise ValueError(f"no line ends within {LINE} bytes at {at}")
    return head[: end + 1]


class Videos(DataSource):
    """video (the path below the folder, without its suffix), frame_index, fps, height, width, channels and data of Y4M videos, as
    operators.frames takes them.

    A video that is larger than `share_bytes`, and whose frames are of one length, is read by several tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return "video string, frame_index long, fps double, height int, width int, channels int, data binary"

    def reader(self, schema) -> DataSourceReader:
        return VideosReader(self.options)


class VideosReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.share = options["path"], int(options.get("share_bytes", SHARE_BYTES))
        self.wanted = Wanted(options)

    def partitions(self) -> list[Share]:
        store, base, found = _listed(self.path)
        shares, few, held = [], [], 0
        for x in found:
            video, _, suffix = x.path[len(base) + 1 :].rpartition(".")
            if suffix.lower() != "y4m" or not self.wanted.named(video):
                continue
            if x.size > self.share:
                shares += self._parts(store, x, video)
                continue
            # Small videos are not opened here, and share tasks.
            few.append((x.path, x.size, video))
            held += x.size
            if held > self.share or len(few) >= FILES:
                shares.append(Share(few, self.wanted.low, self.wanted.high))
                few, held = [], 0
        return [*shares, Share(few, self.wanted.low, self.wanted.high)] if few or not shares else shares

    def _parts(self, store, x, video: str) -> list[Share]:
        with store.open_input_file(x.path) as f:
            header = Header(_line(f, 0))
            stride = len(FRAME) + 1 + header.size
            one = [(x.path, x.size, video)]
            if (x.size - header.begin) % stride or _line(f, header.begin) != FRAME + b"\n":
                # Frames with words of their own: their lengths are known only in order.
                return [Share(one, self.wanted.low, self.wanted.high)]
        total = (x.size - header.begin) // stride
        last, step = total if self.wanted.high is None else min(total, self.wanted.high), max(1, self.share // stride)
        return [Share(one, k, min(k + step, last), stride) for k in range(self.wanted.low, last, step)]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        kinds = [pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        names = ["video", "frame_index", "fps", "height", "width", "channels", "data"]
        rows, held = [], 0
        for path, size, video in share.paths:
            with store.open_input_file(path) as f:
                header = Header(_line(f, 0))
                for index, body in self._frames(f, header, size, share):
                    channels, data = header.pixels(body)
                    rows.append((video, index, header.fps, header.height, header.width, channels, data))
                    held += len(data)
                    if held >= BATCH_BYTES:
                        yield _batch(rows, kinds, names)
                        rows, held = [], 0
        yield _batch(rows, kinds, names)

    @staticmethod
    def _frames(f, header: Header, size: int, share: Share) -> Iterator[tuple[int, bytes]]:
        """Number and bytes of the frames of this share; those before it are passed over."""
        index, at = (share.first, header.begin + share.first * share.stride) if share.stride else (0, header.begin)
        while at < size and (share.last is None or index < share.last):
            line = _line(f, at)
            if not line.startswith(FRAME):
                raise ValueError(f"no frame begins at byte {at}")
            at += len(line)
            if at + header.size > size:
                raise ValueError(f"frame {index} is cut off")
            if index >= share.first:
                yield index, f.read_at(header.size, at)
            at, index = at + header.size, index + 1


def _read(spark: SparkSession, source: type[DataSource], path: str, **options) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load(path)


def heads(spark: SparkSession, path: str, most: int, **what) -> DataFrame:
    """what: as wanted() takes it, of paths and sizes."""
    return _read(spark, Heads, path, bytes=most, **wanted(**what))


def videos(spark: SparkSession, path: str, share_bytes: int = SHARE_BYTES, **what) -> DataFrame:
    """what: as wanted() takes it, of videos and frame numbers."""
    return _read(spark, Videos, path, share_bytes=share_bytes, **wanted(**what))


def y4m_header(width: int, height: int, channels: int, fps: float) -> bytes:
    rate = (round(fps), 1) if fps == round(fps) else (round(fps * 1001), 1001)
    return SIGNATURE + f" W{width} H{height} F{rate[0]}:{rate[1]} Ip A1:1 C{'mono' if channels == 1 else '444'} XCOLORRANGE=FULL\n".encode()


def y4m_frame(height: int, width: int, channels: int, data: bytes) -> bytes:
    """A frame's line and bytes: gray as it is, colours in full range and full size."""
    if channels == 1:
        return FRAME + b"\n" + data
    b, g, r = np.frombuffer(data, np.uint8).reshape(height, width, channels)[..., :3].astype(np.float64).transpose(2, 0, 1)
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = np.stack([y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128])
    return FRAME + b"\n" + np.clip(np.rint(planes), 0, 255).astype(np.uint8).tobytes()
