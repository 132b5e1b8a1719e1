"""Image kernels in NumPy: shrinking, perceptual hash, histogram correlation, structural similarity."""

from __future__ import annotations

import numpy as np


def fit(width: int, height: int, most: int, nearest: bool = False) -> tuple[int, int]:
    """Size within `most`, the longer side first to reach it; the other one's fraction is dropped, or rounded if `nearest`."""
    longer = max(width, height)
    if longer <= most:
        return width, height
    other = (lambda x: int(round(x * (most / longer)))) if nearest else (lambda x: int(x * most / longer))
    return (most, other(height)) if width >= height else (other(width), most)


def shrink(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area average to a smaller size."""
    def axis(n: int, m: int) -> np.ndarray:
        edge = np.linspace(0, n, m + 1)
        cell = np.arange(n)
        return np.clip(np.minimum(edge[1:, None], cell + 1) - np.maximum(edge[:-1, None], cell), 0, None) * (m / n)

    rows, cols = axis(image.shape[0], height), axis(image.shape[1], width)
    # One side after the other: the work is that of two products of matrices.
    return np.moveaxis(np.tensordot(cols, np.tensordot(rows, image.astype(np.float64), axes=(1, 0)), axes=(1, 1)), 0, 1)


def gray(bgr: np.ndarray) -> np.ndarray:
    """Brightness, rounded to whole numbers."""
    return np.rint(bgr[..., 0] * 0.114 + bgr[..., 1] * 0.587 + bgr[..., 2] * 0.299)


def gray_small(bgr: np.ndarray, side: int = 512) -> np.ndarray:
    w, h = fit(bgr.shape[1], bgr.shape[0], side)
    return gray(shrink(bgr, h, w) if (h, w) != bgr.shape[:2] else bgr)


def blurred(x: np.ndarray) -> np.ndarray:
    p = np.pad(x, 1, mode="reflect")
    p = (p[:-2] + 2 * p[1:-1] + p[2:]) / 4
    return (p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]) / 4


def perceptual_hash(x: np.ndarray) -> int:
    """64 bits: the low 8 x 8 cosine coefficients of a 32 x 32 image against their median, without the first row and column."""
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64) * np.where(k[:, None] == 0, np.sqrt(1 / 32), np.sqrt(2 / 32))
    low = (basis @ shrink(x, 32, 32) @ basis.T)[:8, :8]
    bits = (low > np.median(low[1:, 1:])).ravel()
    return int(np.packbits(bits).view(">u8")[0].astype(np.int64)) if bits.size == 64 else 0


def histogram(bgr: np.ndarray) -> np.ndarray:
    """24 x 32 counts over hue and saturation, of unit length."""
    b, g, r = (bgr[..., k].astype(np.float64) for k in range(3))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    span = top - low
    safe = np.where(span == 0, 1, span)
    hue = np.where(top == r, (g - b) / safe % 6, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4)) * 30
    sat = np.where(top == 0, 0, span / np.where(top == 0, 1, top)) * 255
    h = np.histogram2d(np.where(span == 0, 0, hue).ravel(), sat.ravel(), bins=(24, 32), range=((0, 180), (0, 256)))[0]
    return h / max(np.linalg.norm(h), 1e-12)


def histogram_match(a: np.ndarray, b: np.ndarray) -> float:
    """Correlation rescaled to 0 .. 1."""
    x, y = a.ravel() - a.mean(), b.ravel() - b.mean()
    base = np.sqrt((x @ x) * (y @ y))
    return float(np.clip(((x @ y / base if base else 1.0) + 1) / 2, 0, 1))


def similarity(a: np.ndarray, b: np.ndarray, window: int = 7, span: float = 255.0) -> tuple[float, np.ndarray]:
    """Mean structural similarity and its map, over square windows, with sample covariance."""
    def mean(x: np.ndarray) -> np.ndarray:
        p = np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
        return (p[window:, window:] - p[:-window, window:] - p[window:, :-window] + p[:-window, :-window]) / window**2

    a, b = a.astype(np.float64), b.astype(np.float64)
    fix = window**2 / (window**2 - 1)
    ma, mb = mean(a), mean(b)
    va, vb, vab = fix * (mean(a * a) - ma * ma), fix * (mean(b * b) - mb * mb), fix * (mean(a * b) - ma * mb)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    s = (2 * ma * mb + c1) * (2 * vab + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))
    return float(s.mean()), s


class Look:
    """What frames are compared by: the blurred brightness and the colours of the picture within 640, and its hash."""

    def __init__(self, bgr: np.ndarray, side: int = 640):
        w, h = fit(bgr.shape[1], bgr.shape[0], side, nearest=True)
        small = np.rint(shrink(bgr, h, w)) if (h, w) != bgr.shape[:2] else bgr.astype(np.float64)
        self.gray = np.rint(blurred(gray(small)))
        self.hash = perceptual_hash(self.gray) & ((1 << 64) - 1)
        self.colours = histogram(small)

    def stored(self) -> tuple[int, int, bytes, int, bytes]:
        """Height, width, brightness, hash and colours, as a state or a file may hold them."""
        return *self.gray.shape, self.gray.astype(np.uint8).tobytes(), self.hash - (1 << 64 if self.hash >> 63 else 0), self.colours.tobytes()

    @classmethod
    def restored(cls, height: int, width: int, gray: bytes, hash_: int, colours: bytes) -> Look:
        look = cls.__new__(cls)
        look.gray = np.frombuffer(gray, np.uint8).reshape(height, width).astype(np.float64)
        look.hash = hash_ & ((1 << 64) - 1)
        look.colours = np.frombuffer(colours).reshape(24, 32)
        return look


def png(bgr: np.ndarray) -> bytes:
    """An image file of these pixels, without loss."""
    import struct
    import zlib

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    height, width = bgr.shape[:2]
    lines = np.zeros((height, 1 + 3 * width), dtype=np.uint8)
    lines[:, 1:] = bgr[..., ::-1].reshape(height, -1)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + part(b"IEND", b"")


def changed_area(map_: np.ndarray, least: float = 0.15) -> float:
    return float((1 - map_ > least).mean())
