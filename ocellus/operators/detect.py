"""Detections: filters, suppression, decoding, and boxes from probability maps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.functions import geometry as G
from ocellus.operators.grouping import map_groups


def filter_detections(df: DataFrame, min_confidence: float = 0.0, classes: list[int] | None = None, labels: list[str] | None = None) -> DataFrame:
    """Sure enough and of a wanted class and label; no list means any."""
    keep = F.col("confidence") >= min_confidence
    if classes:
        keep = keep & F.col("class_id").isin(classes)
    if labels:
        keep = keep & F.col("label").isin(labels)
    return df.where(keep)


def _suppress(rows: list[tuple], threshold: float, most: int) -> list[tuple]:
    box = np.array([r[-4:] for r in rows], float)
    area = box[:, 2] * box[:, 3]
    far = box[:, :2] + box[:, 2:]
    open_, out = np.ones(len(rows), bool), []
    for i, row in enumerate(rows):  # from the surest on
        if not open_[i] or (most and len(out) >= most):
            continue
        out.append(row[:-4])
        both = np.clip(np.minimum(far[i], far[i + 1 :]) - np.maximum(box[i, :2], box[i + 1 :, :2]), 0, None).prod(1)
        union = area[i] + area[i + 1 :] - both
        some = (area[i] > 0) & (area[i + 1 :] > 0)
        open_[i + 1 :] &= ~(some & (both > threshold * union))
    return out


def nms(df: DataFrame, threshold: float = 0.5, class_aware: bool = True, most: int = 0, frame: str = "frame_id", id_col: str = "evidence_id") -> DataFrame:
    """Detections that no surer one kept of their frame (and class) overlaps by more than ``threshold``."""
    keys = [frame, *(["class_id"] if class_aware else [])]
    cols = df.select(*keys, "confidence", id_col, *(F.col(c).cast("double").alias(c) for c in "xywh")).withColumn("confidence", -F.col("confidence"))
    ddl = ", ".join(f"{k} {t}" for k, t in cols.dtypes[: len(keys) + 2])
    kept = map_groups(cols, keys, ["confidence", id_col], lambda rows: _suppress(rows, threshold, 0 if class_aware else most), ddl).withColumn("confidence", -F.col("confidence"))
    if most and class_aware:
        kept = kept.withColumn("n", F.row_number().over(Window.partitionBy(frame).orderBy(F.desc("confidence"), id_col))).where(F.col("n") <= most).drop("n")
    return kept.select(frame, id_col)


def decode_yolo(candidates: DataFrame, min_confidence: float = 0.25) -> DataFrame:
    """Rows of cx, cy, w, h, objectness and scores (array) as detections: best class (the first of equals), product of scores."""
    best = F.array_max("scores")
    told = candidates.withColumn("class_id", (F.array_position("scores", best) - 1).cast("int")).withColumn("confidence", F.col("objectness") * best)
    box = [(F.col("cx") - F.col("w") / 2).alias("x"), (F.col("cy") - F.col("h") / 2).alias("y")]
    return told.where(F.col("confidence") >= min_confidence).select(*(c for c in candidates.columns if c not in ("cx", "cy", "w", "h", "objectness", "scores")), *box, "w", "h", "class_id", "confidence")


def _label(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected components of a mask, numbered from 1 in scan order, by spreading smallest positions until nothing changes."""
    h, w = mask.shape
    if not mask.any():
        return np.zeros((h, w), int), 0
    big = h * w
    place = np.where(mask, np.arange(big).reshape(h, w), big)
    while True:
        wide = np.pad(place, 1, constant_values=big)
        low = np.minimum.reduce([wide[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)])
        low = np.where(mask, low, big)
        flat = np.append(low.ravel(), big)
        low = np.where(mask, flat[low], big)  # follow the pointers
        if (low == place).all():
            break
        place = low
    names, inverse = np.unique(place[mask], return_inverse=True)
    out = np.zeros((h, w), int)
    out[mask] = inverse + 1
    return out, len(names)


def map_components(px: list[int], width: int, threshold: int) -> list[tuple]:
    """Of pixels at or above ``threshold``: component number, box, pixels and sum, in scan order."""
    image = np.array(px).reshape(-1, width)
    marks, n = _label(image >= threshold)
    out = []
    for k in range(1, n + 1):
        ys, xs = np.nonzero(marks == k)
        out.append((k - 1, int(xs.min()), int(ys.min()), int(xs.max() - xs.min() + 1), int(ys.max() - ys.min() + 1), len(xs), int(image[ys, xs].sum())))
    return out


def components_of_maps(maps: DataFrame, width: int, threshold: int) -> DataFrame:
    """map_id, component, x, y, w, h, pixels and value_sum of every component of every map (map_id, px)."""
    fn = lambda rows: [(i, *c) for i, px in rows for c in map_components(px, width, threshold)]
    return map_groups(maps.select(F.col("map_id").cast("long").alias("map_id"), "px"), ["map_id"], [], fn, "map_id long, component int, x int, y int, w int, h int, pixels long, value_sum long")


def text_boxes(found: DataFrame, width: int, height: int, min_pixels: int = 3, min_mean: float = 0.0, ratio: float = 1.5) -> DataFrame:
    """Components as boxes: large and sure enough, grown by area * ratio / perimeter, clipped, with their mean value as score."""
    mean = F.col("value_sum") / F.col("pixels") / 255.0
    keep = found.where((F.col("pixels") >= min_pixels) & (mean >= min_mean))
    r = G.unclipped(G.Rect.of(), ratio, F.lit(float(width)), F.lit(float(height)))
    return keep.select("map_id", "component", r.x.alias("x"), r.y.alias("y"), r.w.alias("w"), r.h.alias("h"), mean.alias("score"))


def needs_refinement(df: DataFrame, min_confidence: float, min_area: float, frame_area: Column, most: int = 32, frame: str = "frame_id", id_col: str = "evidence_id") -> DataFrame:
    """Unsure or small detections, the unsurest first, ``most`` a frame: those worth a second look at a larger scale."""
    small = (F.col("w") * F.col("h") / frame_area < min_area) if min_area > 0 else F.lit(False)
    rank = F.row_number().over(Window.partitionBy(frame).orderBy("confidence", id_col))
    return df.where((F.col("confidence") < min_confidence) | small).withColumn("rank", rank).where(F.col("rank") <= most)


def replace_refined(df: DataFrame, refined: DataFrame, frame: str = "frame_id", id_col: str = "evidence_id") -> DataFrame:
    """``df`` with each refined detection in place of its original, at its original position; others as they are. ``refined`` may
    hold none, one or several boxes (numbered by n) for an original that was looked at."""
    looked = refined.select(frame, id_col).distinct()
    cols = [c for c in df.columns]
    kept = df.join(looked, [frame, id_col], "left_anti").withColumn("n", F.lit(0))
    return kept.unionByName(refined.where("x is not null").select(*cols, "n"))
