"""Pixels, in numpy, and their use on binary columns through Arrow.

An image is an array of shape (height, width) or (height, width, channels), bytes as unsigned 8 bit. All arithmetic is in integers,
so results are the same everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Planes and bytes per pixel of each format (the second plane of NV12 is counted by its rows).
FORMATS = {"Gray8": (1, 1), "Rgb8": (1, 3), "Bgr8": (1, 3), "Rgba8": (1, 4), "Bgra8": (1, 4), "Nv12": (2, 1)}
MOST_SIDE = 65535
_ORDER = {"Rgb8": (0, 1, 2), "Rgba8": (0, 1, 2), "Bgr8": (2, 1, 0), "Bgra8": (2, 1, 0)}


class UnsupportedFormat(ValueError):
    pass


def valid_image(width: Column, height: Column, stride: Column, fmt: Column, rotation: Column, n_bytes: Column) -> Column:
    """Known format, sides in range, rows long enough, quarter turns, and enough bytes."""
    pixel = F.when(fmt.isin("Rgb8", "Bgr8"), 3).when(fmt.isin("Rgba8", "Bgra8"), 4).when(fmt.isin("Gray8", "Nv12"), 1)
    need = stride * (height - 1) + width * pixel
    return pixel.isNotNull() & width.between(1, MOST_SIDE) & height.between(1, MOST_SIDE) & (stride >= width * pixel) & rotation.isin(0, 90, 180, 270) & (n_bytes >= need)


def unpack(data: bytes, width: int, height: int, stride: int, fmt: str) -> np.ndarray:
    """The packed primary plane."""
    n = FORMATS[fmt][1]
    rows = np.lib.stride_tricks.as_strided(np.frombuffer(data, np.uint8), (height, width * n), (stride, 1))
    return rows.copy() if n == 1 else rows.reshape(height, width, n).copy()


def to_gray(image: np.ndarray, fmt: str) -> np.ndarray:
    """Luma by whole-number weights; NV12 already holds it."""
    if fmt in ("Gray8", "Nv12"):
        return image.copy()
    r, g, b = (image[..., i].astype(np.int32) for i in _ORDER[fmt])
    return ((77 * r + 150 * g + 29 * b + 128) >> 8).astype(np.uint8)


def convert(image: np.ndarray, fmt: str, to: str, chroma: np.ndarray | None = None) -> np.ndarray:
    """Between formats; nothing but itself becomes NV12."""
    if fmt == to:
        return image.copy()
    if to == "Nv12":
        raise UnsupportedFormat("nothing converts to NV12")
    if to == "Gray8":
        return to_gray(image, fmt)
    if fmt == "Nv12":
        rgb = nv12_rgb(image, chroma)
    elif fmt == "Gray8":
        rgb = np.repeat(image[..., None], 3, 2)
    else:
        rgb = image[..., list(_ORDER[fmt])]
    out = rgb[..., list(_ORDER[to])]
    return np.concatenate([out, np.full((*out.shape[:2], 1), 255, np.uint8)], 2) if FORMATS[to][1] == 4 else np.ascontiguousarray(out)


def nv12_rgb(luma: np.ndarray, chroma: np.ndarray) -> np.ndarray:
    """From a luma plane and interleaved chroma pairs at half the size."""
    h, w = luma.shape
    pairs = chroma.reshape(-(-h // 2), -1, 2).astype(np.int32) - 128
    u, v = (pairs[np.arange(h) // 2][:, np.arange(w) // 2, k] for k in (0, 1))
    y = luma.astype(np.int32)
    return np.clip(np.stack([y + ((1436 * v) >> 10), y - ((352 * u + 731 * v) >> 10), y + ((1815 * u) >> 10)], 2), 0, 255).astype(np.uint8)


def crop(image: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    if x < 0 or y < 0 or w < 1 or h < 1 or x + w > image.shape[1] or y + h > image.shape[0]:
        raise ValueError("the part must lie in the image")
    return image[y : y + h, x : x + w].copy()


def _weights(source: int, target: int) -> np.ndarray:
    """Whole-number overlaps of each target cell (of size ``source``) with each source cell (of size ``target``)."""
    a, b = np.arange(target)[:, None] * source, np.arange(source)[None, :] * target
    return np.clip(np.minimum(a + source, b + target) - np.maximum(a, b), 0, None).astype(np.int64)


def resize_area(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Exact box filter, halves rounded up."""
    sh, sw = image.shape[:2]
    total = np.tensordot(_weights(sh, height), image.astype(np.int64), (1, 0))
    total = np.tensordot(_weights(sw, width), total, (1, 1))
    return np.swapaxes((total + sw * sh // 2) // (sw * sh), 0, 1).astype(np.uint8)


def letterbox(image: np.ndarray, width: int, height: int, pad: int = 114, resize: Callable = resize_area) -> tuple[np.ndarray, tuple[float, float, int, int]]:
    """Resized to fit, padded to size, with the (scale x, scale y, offset x, offset y) that was carried out."""
    sh, sw = image.shape[:2]
    s = min(width / sw, height / sh)
    w, h = (min(max(int(np.floor(n * s + 0.5)), 1), most) for n, most in ((sw, width), (sh, height)))
    x, y = (width - w) // 2, (height - h) // 2
    out = np.full((height, width, *image.shape[2:]), pad, np.uint8)
    out[y : y + h, x : x + w] = resize(image, w, h)
    return out, (w / sw, h / sh, x, y)


def resize_bilinear(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Between the four nearest pixels' centers, halves rounded up; beyond the outermost centers their values hold."""

    def spots(source: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(target) + 0.5) * source / target - 0.5, 0, source - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, source - 1), at - low

    (x0, x1, fx), (y0, y1, fy) = spots(image.shape[1], width), spots(image.shape[0], height)
    wide = image.astype(np.float64)
    extra = (None,) * (image.ndim - 2)
    fx, fy = fx[(None, slice(None), *extra)], fy[(slice(None), None, *extra)]
    top = wide[y0][:, x0] * (1 - fx) + wide[y0][:, x1] * fx
    low = wide[y1][:, x0] * (1 - fx) + wide[y1][:, x1] * fx
    return np.floor(top * (1 - fy) + low * fy + 0.5).astype(np.uint8)


def canvas(image: np.ndarray, multiple: int = 32, pad: int = 0) -> np.ndarray:
    """Padded to the right and below so that both sides are multiples of ``multiple``."""
    h, w = image.shape[:2]
    out = np.full((-(-h // multiple) * multiple, -(-w // multiple) * multiple, *image.shape[2:]), pad, np.uint8)
    out[:h, :w] = image
    return out


def unpadded(values: np.ndarray, width: int, height: int) -> np.ndarray:
    """The part of a map over a :func:`canvas` that belongs to the image."""
    return values[:height, :width].copy()


def nv12_crop(luma: np.ndarray, chroma: np.ndarray, x: int, y: int, w: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    """Part of an NV12 image: chroma pairs from half the origin on, half the size rounded up."""
    pairs = chroma.reshape(-(-luma.shape[0] // 2), -1, 2)
    return crop(luma, x, y, w, h), pairs[y // 2 : y // 2 + -(-h // 2), x // 2 : x // 2 + -(-w // 2)].reshape(-(-h // 2), -1).copy()


def yuv420_rgb(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """From three planes, the chroma ones at half the size."""
    return nv12_rgb(y, np.stack([u, v], 2).reshape(u.shape[0], -1))


def change_thumbnail(image: np.ndarray, fmt: str, side: int) -> np.ndarray:
    """Resized first, then gray."""
    return to_gray(resize_area(image, side, side), fmt)


def patch_thumbnail(image: np.ndarray, fmt: str, side: int) -> np.ndarray:
    """Gray first, then resized; not the same as :func:`change_thumbnail`."""
    return resize_area(to_gray(image, fmt), side, side)


def dhash(gray: np.ndarray) -> int:
    """Of a 9 x 8 gray image: bit row * 8 + col where the right neighbour is brighter."""
    bits = (gray[:, 1:9].astype(int) > gray[:, :8]).ravel()
    return int(sum(1 << i for i in np.flatnonzero(bits)))


def fingerprint(image: np.ndarray, fmt: str) -> int:
    return dhash(to_gray(resize_area(image, 9, 8), fmt))


def fnv1a(data: bytes, seed: int = 0xCBF29CE484222325) -> int:
    """64-bit FNV-1a."""
    h = seed
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def region_digest(image: np.ndarray, x: int, y: int, w: int, h: int) -> int:
    """Digest of the exact pixels of a part of an image."""
    return fnv1a(crop(image, x, y, w, h).tobytes())


def to_chw(image: np.ndarray, mean: tuple = (0, 0, 0), scale: tuple = (1 / 255,) * 3) -> np.ndarray:
    """Channels first, as normalised 32-bit floats."""
    return ((image.astype(np.float32) - np.array(mean, np.float32)) * np.array(scale, np.float32)).transpose(2, 0, 1)


def map_images(df: DataFrame, fn: Callable[[np.ndarray, str], bytes | int], schema: str, keys: list[str]) -> DataFrame:
    """``fn(image, format)`` of every image row (data, width, height, stride, format), next to its ``keys``. ``schema`` names keys and result."""
    cols = [*keys, "data", "width", "height", "stride", "format"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fn(unpack(*(batch.column(len(keys) + j)[i].as_py() for j in range(5))), batch.column(len(keys) + 4)[i].as_py()) for i in range(batch.num_rows)]
            kind = pa.binary() if out and isinstance(out[0], bytes) else pa.int64()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), pa.array(out, kind)], [*keys, "result"])

    return df.select(*cols).mapInArrow(run, schema)


def signed(x: int) -> int:
    """An unsigned 64-bit value as the signed one with the same bits."""
    return x - (1 << 64) if x >> 63 else x
