"""Marks on a frame: numbered boxes with label chips, as a table and as pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ocellus.functions import image as I
from ocellus.operators.grouping import map_groups

COLORS = 8
#: Pixels of a label chip: per digit, and besides.
DIGIT_W, CHIP_H, CHIP_PAD = 6, 9, 2


def marks(regions: DataFrame, frame_w: int, frame_h: int, frame: str = "frame_id", id_col: str = "region_id") -> DataFrame:
    """``regions`` as marks: number from 1 within a frame, whole-number bounds (each of x, y, w, h rounded, then clipped), color. Regions without
    any part in the frame get none."""
    near = lambda c: F.floor(F.col(c) + 0.5)
    x, y = F.greatest(near("x"), F.lit(0)), F.greatest(near("y"), F.lit(0))
    w = F.least(near("x") + near("w"), F.lit(frame_w)) - x
    h = F.least(near("y") + near("h"), F.lit(frame_h)) - y
    told = regions.select(frame, id_col, x.alias("mx"), y.alias("my"), w.alias("mw"), h.alias("mh")).where("mw > 0 and mh > 0")
    number = F.row_number().over(Window.partitionBy(frame).orderBy(id_col))
    return told.withColumn("mark", number.cast("long")).withColumn("color", F.pmod(F.col(id_col), F.lit(COLORS)))


def chips(marked: DataFrame, frame_w: int, frame_h: int, frame: str = "frame_id") -> DataFrame:
    """Where each mark's label goes: above, below, inside at the top or inside at the bottom, the first place that is in the frame and free of
    earlier labels; place is none if there is no such."""

    def run(rows: list[tuple]) -> list[tuple]:
        placed: list[tuple] = []
        out = []
        for f, mark, x, y, w, h in rows:
            cw = DIGIT_W * len(str(mark)) + CHIP_PAD
            spots = (("above", y - CHIP_H), ("below", y + h), ("insideTop", y), ("insideBottom", y + h - CHIP_H))
            for name, top in spots:
                box = (x, top, cw, CHIP_H)
                clear = all(x + cw <= a or a + c <= x or top + CHIP_H <= b or b + d <= top for a, b, c, d in placed)
                if top >= 0 and top + CHIP_H <= frame_h and x + cw <= frame_w and clear:
                    placed.append(box)
                    out.append((f, mark, name, *box))
                    break
            else:
                out.append((f, mark, "none", 0, 0, 0, 0))
        return out

    cols = marked.select(F.col(frame).cast("long").alias(frame), "mark", *(F.col(c).cast("long").alias(c) for c in ("mx", "my", "mw", "mh")))
    return map_groups(cols, [frame], ["mark"], run, f"{frame} long, mark long, place string, cx long, cy long, cw long, ch long")


# Digits of 3 x 5 pixels, a row of three bits each.
DIGITS = ["75557", "26227", "71747", "71717", "55711", "74717", "74757", "71111", "75757", "75717"]


def _label(out: np.ndarray, x: int, y: int, mark: int, color: tuple[int, int, int]) -> None:
    """A chip in ``color`` with the mark's number in white; what lies outside the image is cut."""
    w = DIGIT_W * len(str(mark)) + CHIP_PAD
    chip = np.empty((CHIP_H, w, 3), np.uint8)
    chip[:] = color
    for i, digit in enumerate(str(mark)):
        for row, bits in enumerate(DIGITS[int(digit)]):
            for col in range(3):
                if int(bits) >> (2 - col) & 1:
                    chip[2 + row, CHIP_PAD + i * DIGIT_W + col] = 255
    h, w = min(CHIP_H, out.shape[0] - y), min(w, out.shape[1] - x)
    if x >= 0 and y >= 0 and h > 0 and w > 0:
        out[y : y + h, x : x + w] = chip[:h, :w]


PALETTE = [(230, 25, 75), (60, 180, 75), (0, 130, 200), (245, 130, 48), (145, 30, 180), (70, 240, 240), (240, 50, 230), (128, 128, 0)]


def marked(frames: DataFrame, marks_: DataFrame, chips_: DataFrame, frame: str = "frame_id") -> DataFrame:
    """RGB frames (``frame``, data, width, height, stride, format) with outlines and labels of their marks: ``frame``, width, height, data
    (packed RGB). Frames without marks come as they are."""
    own = marks_.join(chips_, [frame, "mark"], "left").groupBy(frame).agg(F.array_sort(F.collect_list(F.struct("mark", "mx", "my", "mw", "mh", "color", "place", "cx", "cy"))).alias("marks"))
    cols = [frame, "data", "width", "height", "stride", "format", "marks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, data, w, h, stride, fmt, found = (c[i].as_py() for c in batch.columns)
                picture = I.convert(I.unpack(data, w, h, stride, fmt), fmt, "Rgb8")
                found = found or []
                picture = draw(picture, [(m["mx"], m["my"], m["mw"], m["mh"]) for m in found], [PALETTE[m["color"] % COLORS] for m in found])
                for m in found:
                    if m["place"] not in (None, "none"):
                        _label(picture, m["cx"], m["cy"], m["mark"], PALETTE[m["color"] % COLORS])
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([picture.tobytes()], pa.binary())], [frame, "width", "height", "data"])

    return frames.join(own, frame, "left").select(F.col(frame).cast("long").alias(frame), *cols[1:]).mapInArrow(run, f"{frame} long, width int, height int, data binary")


def draw(image: np.ndarray, boxes: list[tuple[int, int, int, int]], colors: list[tuple[int, int, int]]) -> np.ndarray:
    """A copy of an RGB image with outlines, two pixels wide."""
    out = image.copy()
    for (x, y, w, h), color in zip(boxes, colors, strict=True):
        part = out[y : y + h, x : x + w]
        part[:2], part[-2:], part[:, :2], part[:, -2:] = color, color, color, color
    return out
