"""Rectangles, transforms and segments as Column expressions.

A rectangle is any four columns (x, y, w, h), half-open: [x, x + w) by [y, y + h). All arithmetic is in doubles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(value: Column | str | float) -> Column:
    return F.col(value).cast("double") if isinstance(value, str) else (value if isinstance(value, Column) else F.lit(float(value)))


@dataclass(frozen=True)
class Rect:
    """Four columns; ``Rect.of("a.")`` takes a.x, a.y, a.w and a.h."""

    x: Column
    y: Column
    w: Column
    h: Column

    @staticmethod
    def of(prefix: str = "", suffix: str = "") -> Rect:
        return Rect(*(_d(f"{prefix}{c}{suffix}") for c in "xywh"))

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def area(self) -> Column:
        return self.w * self.h

    @property
    def center(self) -> tuple[Column, Column]:
        return self.x + self.w / 2, self.y + self.h / 2

    @property
    def diagonal(self) -> Column:
        return F.sqrt(self.w * self.w + self.h * self.h)

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.w.alias("w"), self.h.alias("h"))


def is_valid(r: Rect) -> Column:
    """Sizes not negative, far edges within 32 bits."""
    return (r.w >= 0) & (r.h >= 0) & (r.right <= 2**31 - 1) & (r.bottom <= 2**31 - 1)


def contains_point(r: Rect, x: Column, y: Column) -> Column:
    return (x >= r.x) & (x < r.right) & (y >= r.y) & (y < r.bottom)


def contains(outer: Rect, inner: Rect) -> Column:
    return (inner.x >= outer.x) & (inner.y >= outer.y) & (inner.right <= outer.right) & (inner.bottom <= outer.bottom)


def overlaps(a: Rect, b: Rect) -> Column:
    """A positive area in common; plain comparisons, so that joins can use them as range conditions."""
    return (a.x < b.right) & (b.x < a.right) & (a.y < b.bottom) & (b.y < a.bottom)


def intersection(a: Rect, b: Rect) -> Rect:
    """The common part; sizes are 0 where there is none."""
    x, y = F.greatest(a.x, b.x), F.greatest(a.y, b.y)
    return Rect(x, y, F.greatest(F.least(a.right, b.right) - x, F.lit(0.0)), F.greatest(F.least(a.bottom, b.bottom) - y, F.lit(0.0)))


def iou(a: Rect, b: Rect) -> Column:
    """Intersection over union; 0 if the union has no area."""
    both = intersection(a, b).area
    union = a.area + b.area - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def detection_iou(a: Rect, b: Rect) -> Column:
    """As :func:`iou`, but 0 as soon as either has no area."""
    return F.when((a.area <= 0) | (b.area <= 0), F.lit(0.0)).otherwise(iou(a, b))


def containment(a: Rect, b: Rect) -> Column:
    """Intersection over the smaller area; 0 if that is 0."""
    smaller = F.least(a.area, b.area)
    return F.when(smaller > 0, intersection(a, b).area / smaller).otherwise(F.lit(0.0))


def size_ratio(a: Rect, b: Rect) -> Column:
    larger = F.greatest(a.area, b.area)
    return F.when(larger > 0, F.least(a.area, b.area) / larger).otherwise(F.lit(0.0))


def center_distance(a: Rect, b: Rect) -> Column:
    (ax, ay), (bx, by) = a.center, b.center
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def center_inside(outer: Rect, inner: Rect) -> Column:
    return contains_point(outer, *inner.center)


def corners(r: Rect) -> Column:
    """Top left, top right, bottom right, bottom left."""
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((r.x, r.y), (r.right, r.y), (r.right, r.bottom), (r.x, r.bottom))))


def bounding_rect(points: Column) -> Column:
    """Of an array of points; no points give an empty rectangle at 0."""
    low = lambda v: F.coalesce(F.array_min(v), F.lit(0.0))
    span = lambda v: F.coalesce(F.array_max(v) - F.array_min(v), F.lit(0.0))

    def box(points: Column) -> Column:
        xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
        return F.struct(low(xs).alias("x"), low(ys).alias("y"), span(xs).alias("w"), span(ys).alias("h"))

    return _let(points, box)


def enclosing(r: Rect) -> Rect:
    """The smallest rectangle of whole numbers around ``r``."""
    x, y = F.floor(r.x), F.floor(r.y)
    return Rect(x, y, F.ceil(r.right) - x, F.ceil(r.bottom) - y)


def expanded(r: Rect, ratio: float, frame_w: Column, frame_h: Column) -> Rect:
    """``r`` grown by ``ratio`` times half its diagonal on every side and clipped to the frame: where to look for it again."""
    by = r.diagonal * ratio / 2
    x, y = F.greatest(r.x - by, F.lit(0.0)), F.greatest(r.y - by, F.lit(0.0))
    return Rect(x, y, F.greatest(F.least(r.right + by, frame_w) - x, F.lit(0.0)), F.greatest(F.least(r.bottom + by, frame_h) - y, F.lit(0.0)))


def unclipped(r: Rect, ratio: float, frame_w: Column, frame_h: Column) -> Rect:
    """``r`` grown by area * ratio / perimeter on every side and clipped to the frame."""
    by = F.when(r.w + r.h > 0, r.area * ratio / (2 * (r.w + r.h))).otherwise(F.lit(0.0))
    x, y = F.greatest(r.x - by, F.lit(0.0)), F.greatest(r.y - by, F.lit(0.0))
    return Rect(x, y, F.least(r.right + by, frame_w) - x, F.least(r.bottom + by, frame_h) - y)


def context_bounds(r: Rect, ratio: float, least: float, most: float) -> Rect:
    """``r`` with a margin of floor(ratio * extent) a side, within bounds."""
    px, py = (F.floor(F.least(F.greatest(e * ratio, F.lit(least)), F.lit(most))) for e in (r.w, r.h))
    return Rect(r.x - px, r.y - py, r.w + 2 * px, r.h + 2 * py)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` in the expression once: uses of a column are copies, and copies of copies grow without bound."""
    return F.element_at(F.transform(F.array(value), then), 1)


# -- transforms: an array of 9 doubles, row by row ------------------------------------------------------------------


def matrix(*values: Column | float) -> Column:
    return F.array(*(v if isinstance(v, Column) else F.lit(float(v)) for v in values))


def identity() -> Column:
    return matrix(1, 0, 0, 0, 1, 0, 0, 0, 1)


def scale(sx: Column | float, sy: Column | float) -> Column:
    return matrix(sx, 0, 0, 0, sy, 0, 0, 0, 1)


def translation(dx: Column | float, dy: Column | float) -> Column:
    return matrix(1, 0, dx, 0, 1, dy, 0, 0, 1)


def crop(x: Column, y: Column) -> Column:
    """From a frame to a crop with this origin."""
    return translation(-x, -y)


def mirror(w: Column, h: Column, horizontal: bool) -> Column:
    return matrix(-1, 0, w, 0, 1, 0, 0, 0, 1) if horizontal else matrix(1, 0, 0, 0, -1, h, 0, 0, 1)


def rotation(degrees: Column, w: Column, h: Column) -> Column:
    """From a raw frame of size (w, h) to the upright one; null for anything but quarter turns."""
    return F.when(degrees == 0, identity()).when(degrees == 90, matrix(0, -1, h, 1, 0, 0, 0, 0, 1)).when(degrees == 180, matrix(-1, 0, w, 0, -1, h, 0, 0, 1)).when(degrees == 270, matrix(0, 1, 0, -1, 0, w, 0, 0, 1))


def oriented_size(degrees: Column, w: Column, h: Column) -> Column:
    turned = degrees.isin(90, 270)
    return F.struct(F.when(turned, h).otherwise(w).alias("w"), F.when(turned, w).otherwise(h).alias("h"))


def letterbox(w: Column, h: Column, to_w: Column, to_h: Column) -> Column:
    s = F.least(to_w / w, to_h / h)
    return matrix(s, 0, (to_w - s * w) / 2, 0, s, (to_h - s * h) / 2, 0, 0, 1)


def compose(first: Column, second: Column) -> Column:
    """Apply ``first``, then ``second``."""

    def product(p: Column) -> Column:
        a, b = p["second"], p["first"]
        return F.array(*(a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)))

    return _let(F.struct(first.alias("first"), second.alias("second")), product)


def determinant(m: Column) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def inverse(m: Column) -> Column:
    """Null where the determinant is below 1e-12 in size."""
    minors = ((4, 8, 5, 7), (2, 7, 1, 8), (1, 5, 2, 4), (5, 6, 3, 8), (0, 8, 2, 6), (2, 3, 0, 5), (3, 7, 4, 6), (1, 6, 0, 7), (0, 4, 1, 3))
    adjugate = lambda m, det: F.array(*((m[a] * m[b] - m[c] * m[d]) / det for a, b, c, d in minors))
    return _let(m, lambda m: _let(determinant(m), lambda det: F.when(F.abs(det) >= 1e-12, adjugate(m, det))))


def map_point(m: Column, x: Column, y: Column) -> Column:
    def mapped(p: Column) -> Column:
        m, x, y = p["m"], p["x"], p["y"]
        w = m[6] * x + m[7] * y + m[8]
        return F.struct(((m[0] * x + m[1] * y + m[2]) / w).alias("x"), ((m[3] * x + m[4] * y + m[5]) / w).alias("y"))

    return _let(F.struct(m.alias("m"), x.alias("x"), y.alias("y")), mapped)


def map_rect(m: Column, r: Rect) -> Column:
    """The bounding rectangle of the mapped corners."""
    return _let(m, lambda m: bounding_rect(F.transform(corners(r), lambda p: map_point(m, p["x"], p["y"]))))


# -- segments --------------------------------------------------------------------------------------------------------


def segment_length(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def segment_angle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Degrees in [0, 180)."""
    a = F.degrees(F.atan2(y1 - y0, x1 - x0))
    a = F.when(a < 0, a + 180).otherwise(a)
    return F.when(a >= 180, a - 180).otherwise(a)


def angle_difference(a: Column, b: Column) -> Column:
    """Of two orientations, in [0, 90]."""
    d = F.abs(a - b)
    return F.when(d > 90, 180 - d).otherwise(d)


# -- grids -----------------------------------------------------------------------------------------------------------


def grid_cells(width: Column, height: Column, cell: int) -> Column:
    """All cells of a grid, row by row: index, col, row and clipped bounds."""
    cols, rows = F.ceil(width / cell), F.ceil(height / cell)
    at = lambda i: (F.pmod(i, cols), F.floor(i / cols))

    def one(i: Column) -> Column:
        c, r = at(i)
        return F.struct(i.alias("cell"), c.alias("col"), r.alias("row"), (c * cell).alias("x"), (r * cell).alias("y"), F.least(F.lit(cell), width - c * cell).alias("w"), F.least(F.lit(cell), height - r * cell).alias("h"))

    return F.transform(F.sequence(F.lit(0).cast("long"), cols * rows - 1), one)


def grid_locate(x: Column, y: Column, width: Column, cell: int) -> Column:
    """Index of the cell that holds a point."""
    return F.floor(y / cell) * F.ceil(width / cell) + F.floor(x / cell)


def grid_image_point(column: Column, row: Column, local_x: Column, local_y: Column, cell: int) -> Column:
    """Where a place within a cell is in the image."""
    return F.struct((column * cell + local_x).alias("x"), (row * cell + local_y).alias("y"))
