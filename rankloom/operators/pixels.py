"""Pixels: windows within black borders, crops, and colours of parts of images.

Images are rows of Spark's image source: height, width, nChannels and data, bytes in rows of blue, green, red (and alpha).
All functions take arrays of height x width x 3 in red, green, blue; they run over Arrow batches.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import ready
from ..config import Constants, RgbBounds, WindowDetection

Rect = tuple[int, int, int, int]  # left, top, right, bottom, half open
RECT = "struct<left:int,top:int,right:int,bottom:int>"
#: How pixels are packed. Screens shrink to a few hundredths, so that tables of many images can be stored, sorted and joined.
CODEC = "zstd"
PACKED = {"height": pa.int32(), "width": pa.int32(), "nChannels": pa.int32(), "packed": pa.binary(), "hash": pa.string()}
PACKED_FIELDS = "height int, width int, nChannels int, packed binary, hash string"


def as_array(height: int | None, width: int | None, channels: int | None, data: bytes | None) -> np.ndarray | None:
    """The pixels of an image row; None if it couldn't be decoded or its size doesn't fit its bytes."""
    if not data or not height or not width or height < 0 or width < 0:
        return None
    channels = channels or 3
    if len(data) != height * width * channels:
        return None
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(a, 3, axis=2)
    return a[:, :, 2::-1]


def as_bytes(pixels: np.ndarray) -> bytes:
    return np.ascontiguousarray(pixels[:, :, ::-1]).tobytes()


def packed_row(pixels: np.ndarray) -> tuple[int, int, int, bytes, str]:
    """Height, width, channels, packed bytes, and the hash of size and pixels of an image."""
    data = as_bytes(pixels)
    h, w = pixels.shape[:2]
    return h, w, 3, pa.compress(data, CODEC, asbytes=True), hashlib.sha256(f"{h}x{w}/".encode() + data).hexdigest()


def unpacked(height: int | None, width: int | None, channels: int | None, packed: bytes | None) -> np.ndarray | None:
    """The pixels of a packed row; None if it has none."""
    if not packed:
        return None
    return as_array(height, width, channels, pa.decompress(packed, height * width * channels, CODEC, asbytes=True))


def _border(lines: np.ndarray, c: WindowDetection, samples: int) -> np.ndarray:
    """For each line (lines x places x 3) whether enough of the sampled places are nearly black."""
    at = (np.arange(samples) * (lines.shape[1] - 1)) // max(samples - 1, 1)
    dark = (lines[:, at] <= c.near_black_max_channel).all(axis=2).sum(axis=1)
    return dark >= int(samples * c.border_coverage_threshold)


def black_border_window(pixels: np.ndarray, c: WindowDetection = WindowDetection()) -> Rect | None:
    """The part within black borders; None if there are none, or if it is too small to be a window."""
    h, w = pixels.shape[:2]
    if h == 0 or w == 0:
        return None
    edges = []
    for lines, n in ((pixels.transpose(1, 0, 2), w), (pixels, h)):
        border = _border(lines, c, c.sample_count)
        inner = np.flatnonzero(~border)
        low = int(inner[0]) if len(inner) else n
        high = max(int(inner[-1]), low) if len(inner) else n - 1
        edges.append((low, high + 1))
    (left, right), (top, bottom) = edges
    if right - left < int(w * c.min_window_fraction) or bottom - top < int(h * c.min_window_fraction):
        return None
    if right - left == w and bottom - top == h:
        return None
    return left, top, right, bottom


def crop(pixels: np.ndarray, rect: Rect) -> np.ndarray:
    """The part of an image; ValueError if the part isn't within it."""
    left, top, right, bottom = rect
    h, w = pixels.shape[:2]
    if not (0 <= left < right <= w and 0 <= top < bottom <= h):
        raise ValueError(f"{rect} is not within {w} x {h}")
    return pixels[top:bottom, left:right]


def crop_top_bottom(pixels: np.ndarray, top: float, bottom: float) -> np.ndarray:
    """Without a share of the height at the top and at the bottom."""
    h = pixels.shape[0]
    return pixels[int(h * top) : h - int(h * bottom)]


def part(pixels: np.ndarray, left: int, top: int, right: int, bottom: int, pad: int) -> np.ndarray:
    """A padded box, as far as it is within the image."""
    h, w = pixels.shape[:2]
    return pixels[max(0, top - pad) : max(0, min(h, bottom + pad)), max(0, left - pad) : max(0, min(w, right + pad))]


def average_rgb(pixels: np.ndarray) -> tuple[int, int, int]:
    """The mean of each channel, rounded down; black for no pixels."""
    n = pixels.shape[0] * pixels.shape[1]
    if n == 0:
        return 0, 0, 0
    r, g, b = (int(x) // n for x in pixels.reshape(-1, 3).sum(axis=0, dtype=np.int64))
    return r, g, b


def sample_colour(pixels: np.ndarray, x: float, y: float, size: int = 10) -> tuple[float, float, float]:
    """The mean colour of a small square around a place given in shares of width and height."""
    h, w = pixels.shape[:2]
    cx, cy, half = int(w * x), int(h * y), size // 2
    box = part(pixels, cx - half, cy - half, cx + half, cy + half, 0)
    return tuple(float(v) for v in box.reshape(-1, 3).mean(axis=0)) if box.size else (0.0, 0.0, 0.0)


def white_fraction(pixels: np.ndarray, least: int = Constants().white_min_channel) -> float:
    """The share of pixels of which every channel is above ``least``; 0 for no pixels."""
    return float((pixels > least).all(axis=2).mean()) if pixels.size else 0.0


def is_orange_rgb(rgb: tuple[int, int, int], c: RgbBounds = RgbBounds()) -> bool:
    r, g, b = rgb
    return r > c.r_min and c.g_min <= g <= c.g_max and b < c.b_max


def enhance(pixels: np.ndarray, cutoff: float = 1.0) -> np.ndarray:
    """Contrast stretched in each channel so that a percentage of the pixels at either end becomes black or full."""
    out = pixels.copy()
    for k in range(3):
        channel = pixels[:, :, k]
        low, high = np.percentile(channel, [cutoff, 100 - cutoff], method="nearest")
        if high > low:
            out[:, :, k] = np.clip((channel.astype(float) - low) * 255 / (high - low), 0, 255).astype(np.uint8)
    return out


def png(pixels: np.ndarray) -> bytes:
    """The image as a PNG file."""
    h, w = pixels.shape[:2]

    def chunk(kind: bytes, body: bytes) -> bytes:
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(pixels).reshape(h, w * 3)], axis=1).tobytes()
    out = io.BytesIO()
    out.write(b"\x89PNG\r\n\x1a\n")
    out.write(chunk(b"IHDR", w.to_bytes(4, "big") + h.to_bytes(4, "big") + b"\x08\x02\x00\x00\x00"))
    out.write(chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b""))
    return out.getvalue()


def from_png(content: bytes | None) -> np.ndarray | None:
    """The pixels of a PNG file of eight bits a channel (grey, colour, either with alpha, or a palette); None for anything else."""
    try:
        if not content or content[:8] != b"\x89PNG\r\n\x1a\n":
            return None
        at, body, palette = 8, b"", None
        while at < len(content):
            n, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
            part_ = content[at + 8 : at + 8 + n]
            if kind == b"IHDR":
                w, h = int.from_bytes(part_[:4], "big"), int.from_bytes(part_[4:8], "big")
                if part_[8] != 8 or part_[12]:
                    return None
                channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[part_[9]]
            elif kind == b"PLTE":
                palette = np.frombuffer(part_, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                body += part_
            at += n + 12
        rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * channels)
        out, above = np.empty((h, w * channels), np.uint8), np.zeros(w * channels, np.uint8)
        for y in range(h):
            above = out[y] = _unfilter(int(rows[y, 0]), rows[y, 1:], above, channels)
        a = out.reshape(h, w, channels)
        if palette is not None and channels == 1:
            return palette[a[:, :, 0]]
        return np.repeat(a[:, :, :1], 3, axis=2) if channels < 3 else a[:, :, :3]
    except (ValueError, KeyError, IndexError, UnboundLocalError, zlib.error):
        return None


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    if kind == 2:
        return row + above
    given, up, out = row.tolist(), above.tolist(), [0] * len(row)
    for i, v in enumerate(given):
        left, over, corner = (out[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
        if kind == 3:
            out[i] = (v + (left + over) // 2) & 255
        else:
            near = left + over - corner
            a, b, c = abs(near - left), abs(near - over), abs(near - corner)
            out[i] = (v + (left if a <= b and a <= c else over if b <= c else corner)) & 255
    return np.array(out, np.uint8)


def stack(images: list[np.ndarray], separator: int) -> np.ndarray:
    """Images of one width below each other with black between them."""
    w = images[0].shape[1]
    parts: list[np.ndarray] = []
    for i, a in enumerate(images):
        if i:
            parts.append(np.zeros((separator, w, 3), np.uint8))
        parts.append(a)
    return np.concatenate(parts)


_IMAGE = ("height", "width", "nChannels", "data")


def packed_images(images: DataFrame, *keys: str) -> DataFrame:
    """(keys, height, width, nChannels, packed, hash) of images of the image source; images that are packed stay as they are.

    Images that couldn't be decoded keep their row, with null pixels.
    """
    if "packed" in images.columns:
        return images.select(*keys, *PACKED)
    ready(images.sparkSession)
    given = images.select(*keys, *_IMAGE)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):  # one image at a time is unpacked
                a = as_array(*(b.column(n + k)[i].as_py() for k in range(4)))
                rows.append((None,) * 5 if a is None else packed_row(a))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(PACKED.values())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(n)), *columns], names=[*keys, *PACKED])

    return given.mapInArrow(run, ", ".join(f"{k} {given.schema[k].dataType.simpleString()}" for k in keys) + f", {PACKED_FIELDS}")


def windows(images: DataFrame, c: WindowDetection = WindowDetection(), key: str = "image_id") -> DataFrame:
    """(image_id, window): the window within black borders, null where there is none or the image couldn't be decoded.

    ``images`` has the key and the fields of the image source.
    """
    ready(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rects = []
            for row in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                a = as_array(*row)
                r = black_border_window(a, c) if a is not None else None
                rects.append(dict(zip(("left", "top", "right", "bottom"), r)) if r else None)
            kind = pa.struct([(n, pa.int32()) for n in ("left", "top", "right", "bottom")])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rects, kind)], names=[key, "window"])

    given = images.select(F.col(key), *_IMAGE)
    return given.mapInArrow(run, f"{key} {given.schema[key].dataType.simpleString()}, window {RECT}")


def box_colours(images: DataFrame, boxes: DataFrame, key: str = "image_id") -> DataFrame:
    """``boxes`` (image_id, box, left_x, top_y, right_x, bottom_y, pad) with r, g, b, the mean colour of the padded box, and white.

    Each image's boxes go to its pixels as one small array, so an image is read once, and pixels are packed before they are
    shuffled. Boxes of images that aren't there or couldn't be decoded, and empty boxes, have no row.
    """
    ready(images.sparkSession)
    own = boxes.filter("left_x is not null").groupBy(key).agg(F.collect_list(F.struct("box", "left_x", "top_y", "right_x", "bottom_y", "pad")).alias("boxes"))
    given = packed_images(images, key).select(key, "height", "width", "nChannels", "packed").join(own, key)
    kinds = {"box": pa.string(), "r": pa.int32(), "g": pa.int32(), "b": pa.int32(), "white": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, (h, w, n, data, listed) in enumerate(zip(*(b.column(k).to_pylist() for k in range(1, 6)))):
                a = unpacked(h, w, n, data)
                for x in listed if a is not None else ():
                    p = part(a, x["left_x"], x["top_y"], x["right_x"], x["bottom_y"], x["pad"])
                    if p.size:
                        rows.append((i, x["box"], *average_rgb(p), white_fraction(p)))
            at = pa.array([r[0] for r in rows], pa.int64())
            columns = [b.column(0).take(at)] + [pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *kinds])

    return given.mapInArrow(run, f"{key} {images.schema[key].dataType.simpleString()}, box string, r int, g int, b int, white double")
