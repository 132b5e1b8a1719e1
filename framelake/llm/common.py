"""Shared plumbing of the training-data operators: checkpoints, Arrow batches and text hashing.

Texts are handled as the UTF-8 buffers that Arrow hands over; every kernel works on whole slices of a
batch with NumPy, so the cost a document is a few vector operations and memory is bounded by the slice.
"""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
MASK = (1 << 64) - 1
#: Bytes of text that one kernel call takes at a time; a longer single document forms a slice of its own.
SLICE_BYTES = 1 << 20

BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95
WORD_BASE_2 = 0xAF251AF3B0F025B5


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is set, one is made for a session of one machine (tests); a cluster must name one."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='framelake-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return spark.conf.get("spark.checkpoint.dir", None) or where


#: Tables and archives written to the shared folder by this session that are not yet removed.
_HELD: list[tuple[SparkSession, str]] = []


def new_folder(spark: SparkSession, kind: str) -> str:
    """A name in the shared folder, removed by release() or at the end of the program."""
    where = f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _HELD.append((spark, where))
    return where


def mark() -> int:
    """What is written from now on can be removed alone: release(mark)."""
    return len(_HELD)


def release(since: int = 0) -> None:
    """Removes the folders written since; only for results that are consumed or written elsewhere."""
    while len(_HELD) > since:
        spark, where = _HELD.pop()
        jvm = spark.sparkContext._jvm
        if jvm is not None:
            path = jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _release_at_exit() -> None:
    try:
        release()
    except Exception:  # the session is gone: its folder goes with it
        _HELD.clear()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that later steps neither recompute nor depend on executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64 bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 4096)
        seed = np.full(size, base & MASK, dtype=U)
        seed[0] = 1
        have = np.multiply.accumulate(seed)
        if size <= 4 * SLICE_BYTES:
            _POWERS[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Rolling:
    """Rabin-Karp over a sequence: hash of any [i, j) from one prefix sum, modulo 2 ** 64."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self.back = powers(inverse(base), n + 1)
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum(values * powers(base, n), out=self.sums[1:])

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.sums[j] - self.sums[i]) * self.back[i]


#: A fixed 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(BYTE_BASE))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows with about `most` bytes; null is empty."""
    if pa.types.is_string_view(texts.type) if hasattr(pa.types, "is_string_view") else False:
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if len(buffers) > 2 and buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at, n = 0, len(texts)
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def spaced_table() -> np.ndarray:
    """True for the bytes of words `[^\\x20\\x09-\\x0D]+`."""
    t = np.ones(256, dtype=bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


SPACED = spaced_table()


def find_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in a slice, and for each document the first word's number (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = kind[data]
    head, tail = inside[:n].copy(), inside[:n].copy()
    head[1:] &= ~inside[: n - 1]
    tail &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    head[cuts] = inside[cuts]
    tail[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return starts, ends, np.searchsorted(starts, offsets)


P61 = U((1 << 61) - 1)
#: Bases of the polynomials modulo 2 ** 61 - 1: of bytes in a word, and two of words in a window.
BASE_61 = (0x0F3C9A1D5E7B2468 & int(P61), 0x1B56C4E9A8D3F107 & int(P61), 0x07A5D2B94C6E81F3 & int(P61))


def fold61(x: np.ndarray) -> np.ndarray:
    """x modulo 2 ** 61 - 1, for any 64-bit x."""
    x = (x & P61) + (x >> U(61))
    return np.where(x >= P61, x - P61, x)


def times61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2 ** 61 - 1, both reduced."""
    low = U((1 << 31) - 1)
    a1, a0, b1, b0 = a >> U(31), a & low, b >> U(31), b & low
    middle = a1 * b0 + a0 * b1
    return fold61(((a1 * b1) << U(1)) + (middle >> U(30)) + ((middle & U((1 << 30) - 1)) << U(31)) + a0 * b0)


_POWERS_61: dict[int, np.ndarray] = {}


def powers61(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 61 - 1."""
    have = _POWERS_61.get(base)
    if have is None:
        have = np.array([1], dtype=U)
    while len(have) < n:
        next_power = U(pow(base, len(have), int(P61)))
        have = np.concatenate([have, times61(have, np.full(len(have), next_power, dtype=U))])
        if len(have) <= 4 * SLICE_BYTES:
            _POWERS_61[base] = have
    return have[:n]


def inverse61(base: int) -> int:
    return pow(base, -1, int(P61))


class Rolling61:
    """Rabin-Karp like Rolling, modulo the prime 2 ** 61 - 1: no family of sequences collides for all bases."""

    def __init__(self, values: np.ndarray, base: int):
        self.back = powers61(inverse61(base), len(values) + 1)
        terms = times61(fold61(values), powers61(base, len(values)))
        high, low = (np.concatenate([np.zeros(1, U), np.cumsum(x)]) for x in (terms >> U(31), terms & U((1 << 31) - 1)))
        high = fold61(high)
        self.sums = fold61((((high << U(31)) & P61) | (high >> U(30))) + fold61(low))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return times61(fold61(self.sums[j] + (P61 - self.sums[i])), self.back[i])


@cache
def _byte_powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The powers of the bytes' base, high and low 32 bits, and those of its inverse."""
    power = powers61(BASE_61[0], SLICE_BYTES)
    return power >> U(32), power & U((1 << 32) - 1), powers61(inverse61(BASE_61[0]), SLICE_BYTES)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits a word: a polynomial of its bytes modulo 2 ** 61 - 1, and its length. Words over SLICE_BYTES are digested."""
    out, at = np.empty(len(starts), dtype=U), 0
    while at < len(starts):
        begin = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, begin + SLICE_BYTES, side="right")))
        part, s, e = data[begin : ends[to - 1]], starts[at:to] - begin, ends[at:to] - begin
        if len(part) > SLICE_BYTES:
            out[at] = int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little")
        else:
            values, (power_high, power_low, back) = part.astype(U) + U(1), _byte_powers()
            high, low = np.zeros(len(part) + 1, dtype=U), np.zeros(len(part) + 1, dtype=U)
            np.cumsum(values * power_high[: len(part)], out=high[1:])
            np.cumsum(values * power_low[: len(part)], out=low[1:])

            def before(i: np.ndarray) -> np.ndarray:
                h = fold61(high[i])  # noqa: B023
                return fold61((((h << U(32)) & P61) | (h >> U(29))) + fold61(low[i]))  # noqa: B023

            h = times61(fold61(before(e) + (P61 - before(s))), back[s])
            out[at:to] = mix(h + (e - s).astype(U) * U(WORD_BASE))
        at = to
    return out


def word_slices(texts: pa.Array, overlap: int, kind: np.ndarray | None = None, most: int = SLICE_BYTES) -> Iterator[tuple]:
    """(rows, numbers, data, offsets, starts, ends, first): slices with their words, where long texts come in several pieces.

    rows: the row of each text of the slice; numbers: the number, in its text, of its first word here. A text over 4 * most bytes is
    cut between words into pieces that share `overlap` words with the one before, so each window of overlap + 1 words is in one.
    """
    kind = SPACED if kind is None else kind
    for at, to, data, offsets in slices(texts, most):
        if len(data) <= 4 * most:
            yield np.arange(at, to), np.zeros(to - at, np.int64), data, offsets, *find_words(data, offsets, kind)
            continue
        begin, number, size = 0, 0, 4 * most
        while True:
            end = min(len(data), begin + size)
            if end < len(data):
                gaps = np.flatnonzero(~kind[data[begin:end]])
                end = begin + int(gaps[-1]) + 1 if len(gaps) else end
                if not len(gaps):
                    size *= 2
                    continue
            part = data[begin:end]
            starts, ends, first = find_words(part, np.array([0, len(part)]), kind)
            if end < len(data) and len(starts) <= overlap:
                size *= 2
                continue
            yield np.array([at]), np.array([number]), part, np.array([0, len(part)]), starts, ends, first
            if end == len(data):
                break
            number += len(starts) - overlap
            begin, size = (begin + int(starts[-overlap]) if overlap else end), 4 * most


def byte_slices(texts: pa.Array, overlap: int, most: int = SLICE_BYTES) -> Iterator[tuple]:
    """(rows, numbers, data, offsets): as word_slices, by bytes."""
    for at, to, data, offsets in slices(texts, most):
        if len(data) <= 4 * most:
            yield np.arange(at, to), np.zeros(to - at, np.int64), data, offsets
            continue
        for begin in range(0, max(1, len(data) - overlap), 4 * most - overlap):
            part = data[begin : begin + 4 * most]
            yield np.array([at]), np.array([begin]), part, np.array([0, len(part)])


def rolling_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = np.full(-(-n // width) * width, MASK, dtype=U)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_key(col: str = "text"):
    """Tells apart rows that share an id."""
    return F.coalesce(F.xxhash64(F.col(col)), F.lit(0))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def keep(df: DataFrame) -> DataFrame:
    """Like cut(), for larger tables: a compressed Parquet table in the shared folder."""
    where = new_folder(df.sparkSession, "kept")
    df.write.option("compression", "zstd").parquet(where)
    found = df.sparkSession.read.schema(df.schema).parquet(where)
    found.kept_at = where
    return found


def discard(kept: DataFrame) -> None:
    """Removes a table that keep() returned, once nothing will read it any more."""
    remove(kept.kept_at)


def remove(folder: str) -> None:
    """Removes a folder that new_folder() named."""
    at = next(k for k, (_, where) in enumerate(_HELD) if where == folder)
    _HELD.append(_HELD.pop(at))
    release(len(_HELD) - 1)
