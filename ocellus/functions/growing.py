"""Line segments of a gray image: regions of alike gradients, fitted by their principal axis."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocellus.functions import image as I


@dataclass(frozen=True)
class Growing:
    """Gradient (sum of both differences) that counts, degrees it may differ from the first pixel's, distance from the axis,
    gap between neighbours along it, shortest segment, most segments, and bytes of a bit per pixel."""

    gradient: int = 32
    degrees: float = 15.0
    deviation: float = 1.5
    gap: float = 1.5
    shortest: float = 8.0
    most: int = 1024
    work_bytes: int = 4 << 20

    def __post_init__(self) -> None:
        if not (1 <= self.gradient <= 510 and 0 < self.degrees <= 90 and 0 < self.deviation <= 1e4 and 0 <= self.shortest <= 1e6 and 1 <= self.most <= 65535 and self.work_bytes >= 1024):
            raise ValueError("a parameter is out of its range")


class BudgetExceeded(RuntimeError):
    pass


def axis(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Center and unit direction of the principal axis of ``points`` (n, 2), by the larger eigenvalue of their covariance."""
    center = points.mean(0)
    (xx, xy), (_, yy) = np.cov(points.T, bias=True) if len(points) > 1 else np.zeros((2, 2))
    largest = (xx + yy) / 2 + math.sqrt((xx - yy) ** 2 / 4 + xy * xy)
    way = np.array([largest - yy, xy])
    if abs(way[0]) < 1e-12 and abs(way[1]) < 1e-12:
        way = np.array([1.0, 0.0]) if xx >= yy else np.array([0.0, 1.0])
    return center, way / math.hypot(*way)


def principal_axis(x: Column, y: Column) -> Column:
    """The same as an aggregate over rows: struct of mx, my, dx, dy."""
    xx, yy, xy = F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    largest = (xx + yy) / 2 + F.sqrt((xx - yy) * (xx - yy) / 4 + xy * xy)
    flat = (F.abs(largest - yy) < 1e-12) & (F.abs(xy) < 1e-12)
    dx = F.when(flat, F.when(xx >= yy, 1.0).otherwise(0.0)).otherwise(largest - yy)
    dy = F.when(flat, F.when(xx >= yy, 0.0).otherwise(1.0)).otherwise(xy)
    size = F.sqrt(dx * dx + dy * dy)
    return F.struct(F.avg(x).alias("mx"), F.avg(y).alias("my"), (dx / size).alias("dx"), (dy / size).alias("dy"))


def along(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``points`` in order along their axis: center, direction, the points, places on the axis, distances from it."""
    center, way = axis(points)
    off = points - center
    place, away = off @ way, np.abs(off[:, 0] * way[1] - off[:, 1] * way[0])
    order = np.lexsort((points[:, 1], points[:, 0], place))
    return center, way, points[order], place[order], away[order]


class Regions:
    """Regions of an image's inner pixels, each grown from its first pixel in reading order."""

    def __init__(self, gray: np.ndarray, p: Growing, roi: tuple[int, int, int, int] | None = None):
        h, w = gray.shape
        x, y, rw, rh = roi or (0, 0, w, h)
        if rw < 1 or rh < 1 or x < 0 or y < 0 or x + rw > w or y + rh > h:
            raise ValueError("the ROI must lie in the image")
        if (w * h + 7) // 8 > p.work_bytes:
            raise BudgetExceeded("the image needs more than the work budget")
        wide = gray.astype(np.int32)
        self.gx, self.gy = np.zeros((h, w), np.int32), np.zeros((h, w), np.int32)
        self.gx[:, 1:-1] = wide[:, 2:] - wide[:, :-2]
        self.gy[1:-1] = wide[2:] - wide[:-2]
        self.free = np.abs(self.gx) + np.abs(self.gy) >= p.gradient  # pixels that may still join a region
        inner = np.zeros((h, w), bool)
        inner[max(y, 1) : min(y + rh, h - 1), max(x, 1) : min(x + rw, w - 1)] = True
        self.free &= inner
        self.sine = math.sin(math.radians(p.degrees)) ** 2

    def __iter__(self) -> Iterator[np.ndarray]:
        for y, x in np.argwhere(self.free).tolist():
            if self.free[y, x]:
                yield self._grown(x, y)

    def _grown(self, x: int, y: int) -> np.ndarray:
        """Points of the connected pixels whose gradient points about the way of the first one's. Each ring of new pixels is found at once."""
        gx, gy = int(self.gx[y, x]), int(self.gy[y, x])
        square = gx * gx + gy * gy
        self.free[y, x] = False
        ring, found = np.array([[y, x]]), [np.array([[y, x]])]
        steps = np.array([(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
        while len(ring):
            near = (ring[:, None] + steps).reshape(-1, 2)
            near = near[self.free[near[:, 0], near[:, 1]]]  # inner pixels have all their neighbours
            near = np.unique(near, axis=0)
            ox, oy = self.gx[near[:, 0], near[:, 1]].astype(np.int64), self.gy[near[:, 0], near[:, 1]].astype(np.int64)
            cross, dot = gx * oy - gy * ox, gx * ox + gy * oy
            ring = near[(dot >= 0) & ((cross * cross).astype(float) <= float(square) * (ox * ox + oy * oy).astype(float) * self.sine)]
            self.free[ring[:, 0], ring[:, 1]] = False
            found.append(ring)
        return np.concatenate(found)[:, ::-1].astype(float)


def segments(gray: np.ndarray, p: Growing | None = None, min_confidence: float = 0.0, roi: tuple[int, int, int, int] | None = None) -> list[tuple[float, float, float, float, float]]:
    """(x0, y0, x1, y1, confidence) of every segment, in the order of their regions. A region's pixels near its axis are cut where they leave
    a gap; each run is fitted anew. Confidence falls with the run's mean distance from its axis."""
    p = p or Growing()
    out = []
    for region in Regions(gray, p, roi):
        if len(region) < 2:
            continue
        _, _, points, place, away = along(region)
        fine = away <= p.deviation
        starts = fine & ~np.concatenate([[False], fine[:-1] & (np.diff(place) <= p.gap)])
        number = np.cumsum(starts)
        for k in range(1, int(number[-1]) + 1):
            run = points[fine & (number == k)]
            if len(run) < 2:
                continue
            center, way, _, at, off = along(run)
            confidence = min(1.0, max(0.0, 1 - float(off.mean()) / p.deviation))
            if at[-1] - at[0] < p.shortest or confidence < min_confidence:
                continue
            if len(out) == p.most:
                raise BudgetExceeded("more segments than the budget has room for")
            (x0, y0), (x1, y1) = center + way * at[0], center + way * at[-1]
            out.append((float(x0), float(y0), float(x1), float(y1), confidence))
    return out


def detect(frames: DataFrame, p: Growing | None = None, min_confidence: float = 0.0) -> DataFrame:
    """Segments of gray frames (source_id, seq, data, width, height, stride, format), or one row with a status other than Ok: frames of other
    formats, and those beyond a budget, have none."""
    p = p or Growing()
    names = ["source_id", "seq", "status", "segment_id", "x0", "y0", "x1", "y1", "confidence"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), *[pa.float64()] * 5]
    none = (None,) * 6

    def look(row: tuple) -> list[tuple]:
        source, seq, data, width, height, stride, fmt = row
        if fmt != "Gray8":
            return [(source, seq, "UnsupportedFormat", *none)]
        try:
            found = segments(I.unpack(data, width, height, stride, fmt), p, min_confidence)
        except BudgetExceeded:
            return [(source, seq, "BudgetExceeded", *none)]
        return [(source, seq, "Ok", i, *s) for i, s in enumerate(found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                if rows := look(tuple(c[i].as_py() for c in batch.columns)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    cols = frames.select(F.col("source_id").cast("long"), F.col("seq").cast("long"), "data", "width", "height", "stride", "format")
    return cols.mapInArrow(run, "source_id long, seq long, status string, segment_id long, x0 double, y0 double, x1 double, y1 double, confidence double")
